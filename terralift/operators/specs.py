"""Configuration of roadmaps and completed tests, checked when read."""

from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, model_validator
from pyspark.sql import SparkSession

from terralift.functions.metrics import MetricCatalog
from terralift.operators.design import Design


class Strict(BaseModel):
    """Unknown keys are errors."""

    model_config = ConfigDict(extra="forbid")


class Universe(BaseModel):
    """Markets to choose from; further keys are allowed and kept."""

    model_config = ConfigDict(extra="allow")
    eligible: list[str] = Field(default_factory=list)
    excluded: list[str] = Field(default_factory=list)


class PolicySpec(Strict):
    kind: Literal["complete", "stratified", "matched_pairs", "supergeo", "fixed"] = "complete"
    strata_columns: list[str] = Field(default_factory=list)
    pairs: list[tuple[str, str]] = Field(default_factory=list)
    min_volume: float | None = None
    max_markets_per_unit: int | None = None
    max_abs_smd: float | None = None


class Blackout(Strict):
    start: date
    end: date

    def overlaps(self, start: date, end: date) -> bool:
        """Inclusive windows that meet."""
        return self.start <= end and start <= self.end


class TestSpec(Strict):
    __test__ = False
    name: str
    metrics: list[str]
    primary_metrics: list[str] = Field(default_factory=list)
    priority: float = 1.0
    treatment_count: int = Field(gt=0)
    min_controls: int = Field(2, gt=0)
    durations: list[int] = Field(default_factory=lambda: [28])
    earliest_start: date
    latest_end: date
    step_days: int = Field(7, gt=0)
    universe: Universe = Field(default_factory=Universe)
    policy: PolicySpec = Field(default_factory=PolicySpec)
    required_treatment: list[str] = Field(default_factory=list)
    forbidden_treatment: list[str] = Field(default_factory=list)
    fixed_controls: list[str] = Field(default_factory=list)
    blackouts: list[Blackout] = Field(default_factory=list)
    mde_penalty: float = 1.0
    alpha: float = 0.05
    power: float = 0.8

    @model_validator(mode="after")
    def fits(self) -> TestSpec:
        if self.latest_end < self.earliest_start + timedelta(days=min(self.durations) - 1):
            raise ValueError(f"{self.name}: no duration fits between {self.earliest_start} and {self.latest_end}")
        if both := {*self.required_treatment} & {*self.forbidden_treatment}:
            raise ValueError(f"{self.name}: {sorted(both)} are required and forbidden")
        if unknown := {*self.primary_metrics} - {*self.metrics}:
            raise ValueError(f"{self.name}: primary metrics {sorted(unknown)} aren't among its metrics")
        return self


class EstimatorSuiteSpec(Strict):
    """Estimators of a test, and which one decides, for all metrics or by metric."""

    estimators: list[str] = Field(default_factory=lambda: ["did", "ratio_delta", "block_bootstrap", "cuped", "synthetic_control"])
    primary_estimator: str = "did"
    primary_estimators: dict[str, str] = Field(default_factory=dict)
    optional_backend_policy: Literal["error", "skip"] = "error"
    include_experimental: bool = False
    backend_overrides: dict[str, str] = Field(default_factory=dict)
    parameters: dict[str, dict[str, Any]] = Field(default_factory=dict)

    def primary_for(self, metric: str) -> str:
        return self.primary_estimators.get(metric, self.primary_estimator)


class InferenceEngineSpec(Strict):
    methods: list[str] = Field(default_factory=lambda: ["estimator_default"])
    primary_method: str | None = None
    confidence: float = Field(0.95, gt=0, lt=1)
    randomization_samples: int = Field(5000, gt=0)
    bootstrap_samples: int = Field(1000, gt=0)
    multiplicity: Literal["none", "bonferroni", "holm", "benjamini_hochberg"] = "holm"
    seed: int = 2027

    @model_validator(mode="after")
    def primary_is_listed(self) -> InferenceEngineSpec:
        if self.primary_method is not None and self.primary_method not in self.methods:
            raise ValueError(f"primary method {self.primary_method!r} isn't among {self.methods}")
        return self


class CalibrationSpec(Strict):
    """Checks of an estimator; of the effect shapes only the constant one is put in."""

    placebo_windows: int = Field(0, ge=0)
    injected_lifts: list[float] = Field(default_factory=list)
    effect_shapes: list[Literal["constant", "ramp", "decay"]] = Field(default_factory=lambda: ["constant"])
    target_false_positive_rate: float = Field(0.05, gt=0, lt=1)
    seed: int = 2027


class MonitoringPlanSpec(Strict):
    mode: Literal["none", "fixed_horizon", "group_sequential", "anytime_valid"] = "none"
    look_dates: list[date] = Field(default_factory=list)
    information_fractions: list[float] = Field(default_factory=list)
    lower_bound: float | None = None
    upper_bound: float | None = None
    alpha_spending: Literal["none", "obrien_fleming", "pocock"] = "none"

    @model_validator(mode="after")
    def both_bounds(self) -> MonitoringPlanSpec:
        if (self.lower_bound is None) != (self.upper_bound is None):
            raise ValueError("give both bounds or none")
        if self.lower_bound is not None and not self.lower_bound < self.upper_bound:
            raise ValueError("the bounds are out of order")
        if any(not 0 < f <= 1 for f in self.information_fractions):
            raise ValueError("information fractions lie above 0, up to 1")
        return self


class InterferenceSpec(Strict):
    mode: Literal["none", "adjacency", "distance", "exposure", "metadata"] = "none"
    adjacency_path: str | None = None
    distance_path: str | None = None
    exposure_path: str | None = None
    buffer_radius: float | None = Field(None, ge=0)
    exclude_buffer_controls: bool = True


class PortfolioDecisionSpec(Strict):
    metric_roles: dict[str, str] = Field(default_factory=dict)
    multiplicity_family: str | None = None
    success_metrics: list[str] = Field(default_factory=list)
    guardrail_metrics: list[str] = Field(default_factory=list)
    minimum_business_impact: dict[str, float] = Field(default_factory=dict)
    posterior_thresholds: dict[str, float] = Field(default_factory=dict)

    def role_of(self, metric: str) -> str:
        named = self.metric_roles.get(metric)
        return named or ("primary" if metric in self.success_metrics else "guardrail" if metric in self.guardrail_metrics else "diagnostic")


class FrameworkSpec(Strict):
    """The question a test answers; ``test_type`` and ``margin`` are older names of ``kind`` and ``default_margin``."""

    kind: Literal["superiority", "non_inferiority", "equivalence", "inferiority", "two_sided"] = "superiority"
    effect_scale: Literal["relative", "absolute"] = "relative"
    margins: dict[str, float] = Field(default_factory=dict)
    default_margin: float = 0.0
    alpha: float = Field(0.05, gt=0, lt=1)
    posterior_probability_threshold: float = Field(0.95, gt=0, lt=1)

    @model_validator(mode="before")
    @classmethod
    def older_names(cls, data: Any) -> Any:
        if isinstance(data, dict):
            data = {{"test_type": "kind", "margin": "default_margin"}.get(k, k): v for k, v in data.items()}
        return data

    def margin_of(self, metric: str) -> float:
        return self.margins.get(metric, self.default_margin)


class ObjectiveSpec(Strict):
    mode: Literal["mde", "learning", "balanced"] = "balanced"
    metric_weights: dict[str, float] = Field(default_factory=dict)
    mde_penalty: float = Field(1.0, ge=0)
    control_overuse_penalty: float = Field(0.0, ge=0)
    learning_value_weight: float = Field(0.0, ge=0)
    covariance_risk_penalty: float = Field(0.0, ge=0)
    calendar_overlap_penalty: float = Field(0.0, ge=0)


class PowerSpec(Strict):
    target_power: float = Field(0.8, gt=0, lt=1)
    alpha: float = Field(0.05, gt=0, lt=1)
    lift_grid: list[float] = Field(default_factory=lambda: [0.01, 0.02, 0.05, 0.1])
    placebo_windows: int = Field(20, gt=0)
    method: Literal["analytic", "replay"] = "analytic"
    replay_estimator: str = "did"


class RoadmapDefaults(Strict):
    overlap_policy: Literal["exclusive", "shared_controls"] = "shared_controls"
    min_control_markets: int = Field(5, gt=0)
    max_shared_control_usage: int = Field(3, gt=0)
    treatment_cooldown_days: int = Field(0, ge=0)
    min_treatment_share: float = Field(0.05, gt=0, lt=1)
    max_treatment_share: float = Field(0.20, gt=0, lt=1)
    candidates_per_test: int = Field(50, gt=0)

    def treatment_counts(self, markets: int) -> tuple[int, int]:
        """Least and most treated markets."""
        return max(1, round(self.min_treatment_share * markets)), max(1, round(self.max_treatment_share * markets))


class RoadmapSpec(Strict):
    name: str
    metrics: dict[str, dict[str, Any]]
    tests: list[TestSpec]
    allow_shared_controls: bool = True
    max_shared_control_usage: int | None = None
    control_overuse_penalty: float = 0.0
    pre_period_days: int = Field(56, gt=0)
    seed: int = 2027

    @model_validator(mode="after")
    def names(self) -> RoadmapSpec:
        if len({t.name for t in self.tests}) < len(self.tests):
            raise ValueError("test names repeat")
        for t in self.tests:
            if unknown := {*t.metrics} - {*self.metrics}:
                raise ValueError(f"{t.name}: unknown metrics {sorted(unknown)}")
        return self

    @property
    def catalog(self) -> MetricCatalog:
        return MetricCatalog.from_configs(self.metrics)

    @classmethod
    def from_file(cls, path: str) -> RoadmapSpec:
        return cls.model_validate(read_config(path))


class CompletedSpec(Strict):
    """A completed test: design, metrics, estimators and inference."""

    experiment_id: str
    metrics: dict[str, dict[str, Any]]
    treatment: list[str]
    control: list[str]
    start: date
    end: date
    pre_start: date | None = None
    pre_end: date | None = None
    estimators: list[str] = Field(default_factory=list)
    primary_estimator: str = "did"
    framework: Literal["superiority", "non_inferiority", "equivalence", "inferiority", "two_sided"] = "superiority"
    margin: float = 0.0
    alpha: float = 0.05
    multiplicity: Literal["none", "bonferroni", "holm", "benjamini_hochberg", "bh"] = "holm"
    inference: list[str] = Field(default_factory=list)
    placebo_windows: int = 0
    injected_lifts: list[float] = Field(default_factory=list)
    looks: list[float] = Field(default_factory=list)
    bounds: tuple[float, float] | None = None

    @model_validator(mode="after")
    def disjoint(self) -> CompletedSpec:
        if both := {*self.treatment} & {*self.control}:
            raise ValueError(f"{sorted(both)} are in both arms")
        if self.end < self.start:
            raise ValueError("the test ends before it starts")
        return self

    @property
    def design(self) -> Design:
        return Design.of(self.experiment_id, self.treatment, self.control, self.start, self.end, self.pre_start, self.pre_end)

    @property
    def catalog(self) -> MetricCatalog:
        return MetricCatalog.from_configs(self.metrics)

    @classmethod
    def from_file(cls, path: str) -> CompletedSpec:
        return cls.model_validate(read_config(path))


def read_config(path: str, spark: SparkSession | None = None) -> Any:
    """YAML or JSON from a local file, or through Spark from any store it reads."""
    text = Path(path).read_text() if spark is None else "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


#: What ``schema`` can describe.
MODELS: dict[str, type[BaseModel]] = {"roadmap": RoadmapSpec, "test": TestSpec, "completed": CompletedSpec, "suite": EstimatorSuiteSpec, "inference": InferenceEngineSpec, "calibration": CalibrationSpec, "monitoring": MonitoringPlanSpec, "interference": InterferenceSpec, "decision": PortfolioDecisionSpec, "framework": FrameworkSpec, "objective": ObjectiveSpec, "power": PowerSpec, "defaults": RoadmapDefaults}
