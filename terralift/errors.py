"""Errors that name what is wrong and what to do about it."""

from __future__ import annotations


class ValidationError(ValueError):
    """Input that can't be used; ``remediation`` says how to mend it."""

    def __init__(self, message: str, remediation: str = "") -> None:
        super().__init__(f"{message} {remediation}".strip())
        self.remediation = remediation


class EstimationError(RuntimeError):
    """An estimate that the data can't support."""


class MDEComputationError(RuntimeError):
    """A minimum detectable effect that can't be computed."""


class OptionalDependencyError(ImportError):
    """A backend that needs a package which isn't installed."""
