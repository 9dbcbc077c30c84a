"""Small shared contracts: formats, method records, evidence, covariance of estimates, hooks for caller's functions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import EstimationError, OptionalDependencyError, ValidationError
from terralift.operators import inference, portfolio
from terralift.operators.analysis import Estimand
from terralift.operators.estimators import ALIASES, ESTIMATORS, Estimate
from terralift.operators.reports import clean

# ---- formats and numbers -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MetricFormat:
    """How a metric is shown."""

    style: str = "number"
    decimals: int = 2
    scale: float = 1.0
    prefix: str = ""
    suffix: str = ""
    compact: bool = False
    axis_label: str | None = None
    currency: str | None = None

    def text(self, value: float | None) -> str:
        if value is None or not math.isfinite(value):
            return "n/a"
        v = value * self.scale * (100 if self.style == "percent" else 1)
        tail = "%" if self.style == "percent" else ""
        if self.compact:
            for step, name in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
                if abs(v) >= step:
                    v, tail = v / step, name + tail
                    break
        return f"{self.prefix}{self.currency or ''}{v:,.{self.decimals}f}{tail}{self.suffix}"


def inclusive_days(start: date, end: date) -> int:
    return (end - start).days + 1


def overlap_days(a: date, b: date, c: date, d: date) -> int:
    return max(0, (min(b, d) - max(a, c)).days + 1)


def safe_ratio(numerator: float, denominator: float) -> float:
    return numerator / denominator if denominator > 0 else 0.0


def finite(value: Any) -> float | None:
    try:
        v = float(value)
    except (TypeError, ValueError):
        return None
    return v if math.isfinite(v) else None


def confidence_alpha(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValidationError(f"confidence {confidence} isn't between 0 and 1.", "Use 0.95, say.")
    return 1 - confidence


def string_list(value: Any) -> list[str]:
    """A list from a list, JSON, or comma-separated text."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        value = json.loads(text) if text.startswith("[") else text.split(",")
    return [s for v in value if (s := str(v).strip())]


# ---- methods -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MethodRecord:
    """What is known of a method, whatever it is run on."""

    name: str
    family: str
    interval_kind: str = "frequentist"
    scale: str = "additive"
    needs: tuple[str, ...] = ()
    note: str = ""


FAMILIES = {
    "did": "difference", "ratio_delta": "difference", "block_bootstrap": "difference", "cuped": "regression", "tbr": "regression", "synthetic_control": "synthetic", "augmented_synthetic_control": "synthetic",
    "synthetic_did": "synthetic", "matrix_completion": "completion", "generalized_synthetic_control": "completion", "forecast": "forecast", "state_space": "forecast", "paired_iroas": "pairs",
}


class MethodRegistry:
    """Methods by name; estimators are there from the start."""

    def __init__(self) -> None:
        self.records = {n: MethodRecord(n, f, "predictive" if n == "state_space" else "conformal" if f in ("synthetic", "completion") else "frequentist") for n, f in FAMILIES.items()}

    def register(self, record: MethodRecord, fit: Callable[..., Estimate] | None = None, replace: bool = False) -> None:
        """Add a method; with ``fit`` it can be run by name like the built-in estimators."""
        if record.name in self.records and not replace:
            raise ValidationError(f"method {record.name!r} exists.", "Pass replace=True.")
        self.records[record.name] = record
        if fit is not None:
            ESTIMATORS[record.name] = fit

    def get(self, name: str) -> MethodRecord:
        key = ALIASES.get(name, name)
        return self.records.get(key, MethodRecord(key, key))

    def family(self, name: str) -> str:
        return self.get(name).family


def check_backend(name: str, package: str | None = None) -> str:
    """Version of an optional package, or an error that names it."""
    import importlib

    try:
        return getattr(importlib.import_module(name), "__version__", "unknown")
    except ImportError as e:
        raise OptionalDependencyError(f"{package or name} isn't installed.") from e


def interval_kind(interval_type: str, family: str = "") -> str:
    kinds = {"bca": "bootstrap", "percentile": "bootstrap", "basic": "bootstrap", "conformal": "conformal", "credible": "credible", "predictive": "predictive", "t": "frequentist", "normal": "frequentist"}
    return kinds.get(interval_type, "predictive" if family == "forecast" else "frequentist")


def estimand_from_label(label: str, metric_kind: str = "count") -> Estimand:
    """A structured estimand from a free label."""
    text = label.lower()
    scale = "ratio" if "ratio" in text or metric_kind == "ratio" else "relative" if "lift" in text or "relative" in text else "additive"
    aggregation = "cumulative_total" if "cumulative" in text else "total" if "total" in text else "mean"
    return Estimand(scale, "treated", "post", aggregation)


def default_inference(e: Estimate, confidence: float = 0.95) -> inference.Inference:
    return inference.Inference("native", e.estimate, e.interval, e.p_value, e.standard_error, confidence)


# ---- caller's functions --------------------------------------------------------------------------------------


def bootstrap_frames(df: DataFrame, unit: str, strata: str, statistic: Callable[[pd.DataFrame], float], draws: int = 200, seed: int = 0) -> DataFrame:
    """``draw, value``: a caller's statistic on resampled market blocks, one group a draw.

    Units come in with their multiplicity as copies named apart, so the statistic sees a panel of as many markets.
    """
    units = df.select(F.col(unit).cast("string").alias("geo"), F.col(strata).alias("stratum")).distinct()
    from terralift.operators.estimators import bootstrap_weights

    w = bootstrap_weights(units, draws, "stratum", seed)
    copies = w.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    rows = df.withColumn("__geo", F.col(unit).cast("string")).join(copies.select("draw", F.col("geo").alias("__geo"), "copy"), "__geo")
    rows = rows.withColumn(unit, F.concat_ws("#", "__geo", F.col("copy").cast("string"))).drop("__geo", "copy")

    def one(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], float(statistic(frame.drop(columns="draw"))))], columns=["draw", "value"])

    return rows.groupBy("draw").applyInPandas(one, "draw long, value double")


def randomize_with(outcomes: dict[Any, float], treated: Sequence[Any], assignments: Iterable[Sequence[Any]], statistic: Callable[[dict[Any, float], frozenset], float], alternative: str = "two-sided", exact: bool = True) -> inference.Inference:
    """Randomization test of a caller's statistic; without a model of effects there is no interval."""
    null = np.array([statistic(outcomes, frozenset(a)) for a in assignments])
    if not len(null):
        raise EstimationError("no assignments.")
    seen = statistic(outcomes, frozenset(treated))
    return inference.Inference("randomization_test", seen, None, inference.plus_one_p(seen, null, alternative, not exact))


# ---- evidence ------------------------------------------------------------------------------------------------

EVIDENCE = "test_id string, metric string, estimate double, standard_error double, variance double, effect_scale string, domain string, channel string, season string, region string, segment string, tags array<string>"


@dataclass(frozen=True)
class EvidenceRecord:
    """What one test found of one metric."""

    test_id: str
    metric: str
    estimate: float
    standard_error: float | None = None
    variance: float | None = None
    effect_scale: str = "relative"
    domain: str | None = None
    channel: str | None = None
    season: str | None = None
    region: str | None = None
    segment: str | None = None
    tags: tuple[str, ...] = ()

    def resolved_variance(self) -> float | None:
        return portfolio.resolved_variance(self.variance, self.standard_error, None)

    def group_value(self, key: str) -> str:
        return getattr(self, key, None) or "unknown"


@dataclass
class EvidenceStore:
    """Evidence with JSON for files and a table for plans."""

    records: list[EvidenceRecord] = field(default_factory=list)

    def add(self, record: EvidenceRecord) -> None:
        self.records.append(record)

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps([clean(asdict(r)) for r in self.records], indent=2))

    @classmethod
    def load(cls, path: str) -> EvidenceStore:
        return cls([EvidenceRecord(**{**r, "tags": tuple(r.get("tags") or ())}) for r in json.loads(Path(path).read_text())])

    def table(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in EVIDENCE.split(", ")]
        df = spark.createDataFrame([tuple(list(v) if isinstance(v := getattr(r, n), tuple) else v for n in names) for r in self.records], EVIDENCE)
        known = {n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("unknown")) for n in ("domain", "channel", "season", "region", "segment")}
        return df.withColumns({**known, "variance": F.coalesce("variance", F.col("standard_error") * F.col("standard_error"))})

    def pool(self, spark: SparkSession, by: list[str], min_records: int = 2) -> DataFrame:
        return portfolio.pooled(self.table(spark), by, min_records)

    def priors(self, spark: SparkSession, metric: str, by: list[str] | None = None, **equal: Any) -> DataFrame:
        """Prior mean and deviation of a new test's effect, from the pools of like tests."""
        rows = portfolio.query_evidence(self.table(spark), metric=metric, **equal)
        return portfolio.pooled(rows, by or ["domain"]).withColumn("prior_sd", F.sqrt(F.col("tau2") + F.col("variance")))


# ---- covariance of estimates ---------------------------------------------------------------------------------


@dataclass
class PortfolioCovariance:
    """Variances and correlations of tests' estimates."""

    ids: list[str]
    covariance: np.ndarray
    correlation: np.ndarray
    projected: bool
    source: str

    def frame(self, what: str = "covariance") -> pd.DataFrame:
        return pd.DataFrame(getattr(self, what), index=self.ids, columns=self.ids)


def estimate_covariance(variances: dict[str, float], pairs: DataFrame, most: float = 0.95, least_variance: float = 1e-12) -> PortfolioCovariance:
    """From ``a, b`` with ``correlation`` (draws) or ``proxy`` (overlap), one row a pair; made positive if it isn't."""
    ids = sorted(variances)
    at = {t: i for i, t in enumerate(ids)}
    source = "correlation" if "correlation" in pairs.columns else "proxy"
    c = np.eye(len(ids))
    for r in pairs.select("a", "b", source).collect():
        if r["a"] in at and r["b"] in at and r[source] is not None:
            c[at[r["a"]], at[r["b"]]] = c[at[r["b"]], at[r["a"]]] = float(np.clip(r[source], -most, most)) if source == "proxy" else r[source]
    whole = portfolio.nearest_correlation(c)
    sd = np.sqrt([max(variances[t], least_variance) for t in ids])
    return PortfolioCovariance(ids, whole * np.outer(sd, sd), whole, whole is not c, "draws" if source == "correlation" else "overlap")


@dataclass(frozen=True)
class ObjectiveWeights:
    """Weights of the parts of a candidate set's score; none below zero."""

    learning_value: float = 0.0
    covariance_risk: float = 0.0
    shared_control_risk: float = 0.0
    calendar_overlap_risk: float = 0.0
    covariance_threshold: float = 0.5
    learning_mde_floor: float = 0.01

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 0:
            raise ValidationError("a weight is below zero.", "Use weights of zero or more.")


def pair_penalties(candidates: DataFrame, weights: ObjectiveWeights, covariance: DataFrame | None = None) -> DataFrame:
    """``a, b, covariance_part, control_part, calendar_part, penalty`` of candidates of different tests.

    Each part is reported once. ``covariance`` has ``a, b, correlation`` of tests, the larger one of a pair counting.
    """
    side = lambda k: candidates.select(*[F.col(c).alias(f"{k}_{c}") for c in ("candidate_id", "test_name", "start_date", "end_date", "control_markets")])
    p = side("a").join(side("b"), (F.col("a_candidate_id") < F.col("b_candidate_id")) & (F.col("a_test_name") != F.col("b_test_name")))
    shared = F.size(F.array_intersect("a_control_markets", "b_control_markets")) / F.greatest(F.lit(1), F.least(F.size("a_control_markets"), F.size("b_control_markets")))
    days = F.greatest(F.lit(0), F.datediff(F.least("a_end_date", "b_end_date"), F.greatest("a_start_date", "b_start_date")) + 1)
    calendar = days / F.least(*[F.datediff(f"{k}_end_date", f"{k}_start_date") + 1 for k in "ab"])
    rho = F.lit(0.0)
    if covariance is not None:
        most = covariance.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.abs("correlation").alias("r")).groupBy("x", "y").agg(F.max("r").alias("rho"))
        p = p.join(most, (F.least("a_test_name", "b_test_name") == F.col("x")) & (F.greatest("a_test_name", "b_test_name") == F.col("y")), "left")
        rho = F.coalesce("rho", F.lit(0.0))
    parts = {"covariance_part": weights.covariance_risk * F.greatest(F.lit(0.0), rho - weights.covariance_threshold), "control_part": weights.shared_control_risk * shared, "calendar_part": weights.calendar_overlap_risk * calendar}
    p = p.withColumns(parts)
    return p.select(F.col("a_candidate_id").alias("a"), F.col("b_candidate_id").alias("b"), *parts, (F.col("covariance_part") + F.col("control_part") + F.col("calendar_part")).alias("penalty"))


def solve_portfolio(spark: SparkSession, candidates: list[portfolio.Candidate], weights: ObjectiveWeights, evidence: EvidenceStore | None = None, covariance: DataFrame | None = None, **limits: Any) -> dict[str, Any]:
    """Choice of candidates with learning values and pair penalties from plans."""
    return portfolio.solve(candidates, **optimizer_inputs(spark, candidates, weights, evidence, covariance), **limits)


def optimizer_inputs(spark: SparkSession, candidates: list[portfolio.Candidate], weights: ObjectiveWeights, evidence: EvidenceStore | None = None, covariance: DataFrame | None = None) -> dict[str, Any]:
    """Penalties of pairs and bonuses of candidates, as ``portfolio.solve`` takes them; candidates of a roadmap are few."""
    rows = [(c.candidate_id, c.test_name, c.start, c.end, sorted(c.treatment), sorted(c.control), {k[4:]: v for k, v in c.components.items() if k.startswith("mde:")}) for c in candidates]
    table = spark.createDataFrame(rows, "candidate_id string, test_name string, start_date date, end_date date, treatment_markets array<string>, control_markets array<string>, metric_mde map<string,double>")
    penalties = {tuple(sorted((r["a"], r["b"]))): r["penalty"] for r in pair_penalties(table, weights, covariance).where("penalty > 0").collect()}
    bonuses: dict[str, float] = {}
    if evidence is not None and weights.learning_value:
        values = portfolio.learning_values(table, evidence.table(spark), weights.learning_mde_floor)
        bonuses = {r["candidate_id"]: weights.learning_value * r["value"] for r in values.collect() if r["value"] is not None}
    return {"penalties": penalties, "bonuses": bonuses}


def score_portfolio(chosen: list[portfolio.Candidate], inputs: dict[str, Any]) -> dict[str, float]:
    """Score of a set: the candidates' own, what they teach, less the penalties of its pairs."""
    ids = sorted(c.candidate_id for c in chosen)
    pairs = sum(inputs["penalties"].get((a, b), 0.0) for i, a in enumerate(ids) for b in ids[i + 1 :])
    base, learning = sum(c.score for c in chosen), sum(inputs["bonuses"].get(c, 0.0) for c in ids)
    return {"base": base, "learning": learning, "penalty": pairs, "total": base + learning - pairs}


@dataclass(frozen=True)
class PortfolioSolution:
    """A chosen set of candidates with what was left out."""

    roadmap: str
    selected: list[portfolio.Candidate]
    objective: float = 0.0
    optimal: bool = True
    unselected: list[str] = field(default_factory=list)
    alternatives: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, roadmap: str, solution: dict[str, Any]) -> PortfolioSolution:
        return cls(roadmap, solution["selected"], solution["objective"], solution["optimal"], solution["unselected"], solution["alternatives"])

    def components(self) -> dict[str, float]:
        return portfolio.score_decomposition(self.selected)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Assignment rows of the chosen candidates."""
        return solution_assignments(spark, {"selected": self.selected}).df

    def items(self, status: str = "planned") -> list[dict[str, Any]]:
        return portfolio.roadmap_items({"selected": self.selected}, status)


@dataclass(frozen=True)
class PortfolioEstimate:
    """One test's estimate of one metric with its markets and dates."""

    test_id: str
    metric: str
    estimate: float
    variance: float | None
    treatment: tuple[str, ...]
    control: tuple[str, ...]
    start: date
    end: date
    family: str
    scale: str = "absolute"

    @classmethod
    def from_result(cls, result: Estimate, design: Any, test_id: str | None = None, scale: str = "absolute") -> PortfolioEstimate:
        """On the relative scale the lift and its interval stand for the effect."""
        relative = scale == "relative"
        if relative and result.relative_lift is None:
            raise EstimationError(f"{result.estimator} has no lift of {result.metric}.")
        value, interval = (result.relative_lift, result.relative_interval) if relative else (result.estimate, result.interval)
        variance = portfolio.resolved_variance(None, None if relative else result.standard_error, interval)
        return cls(test_id or design.experiment_id, result.metric, value, variance, design.treatment, design.control, design.start, design.end, MethodRegistry().family(result.estimator), scale)


def save_solution(solution: dict[str, Any], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(clean(solution), indent=2))


def load_solution(path: str) -> dict[str, Any]:
    raw = json.loads(Path(path).read_text())
    made = [portfolio.Candidate(c["candidate_id"], c["test_name"], date.fromisoformat(c["start"]), date.fromisoformat(c["end"]), frozenset(c["treatment"]), frozenset(c["control"]), c["score"], c["components"]) for c in raw["selected"]]
    return {**raw, "selected": made}


def solution_assignments(spark: SparkSession, solution: dict[str, Any]) -> Any:
    """The chosen candidates as an assignment matrix."""
    from terralift.operators.assignments import CONTROL, TREATMENT, AssignmentMatrix

    rows = [{"test_id": c.test_name, "geo_id": m, "role": role, "start_date": c.start, "end_date": c.end, "status": "planned"} for c in solution["selected"] for role, ms in ((TREATMENT, c.treatment), (CONTROL, c.control)) for m in sorted(ms)]
    return AssignmentMatrix.from_records(spark, rows)


# ---- Westfall-Young over stored draws ------------------------------------------------------------------------


def westfall_young(spark: SparkSession, results: list[Estimate]) -> dict[str, float]:
    """Adjusted p of several metrics from the joint draws that their estimates kept (``artifacts['draws']``), studentised.

    All must have as many draws; a draw's number ties them together.
    """
    kept = [(r, np.asarray(r.artifacts["draws"], float)) for r in results if r.artifacts.get("draws") is not None]
    if not kept or len({len(d) for _, d in kept}) != 1:
        raise EstimationError("the metrics keep no draws of one length.")
    observed, rows = [], []
    for r, d in kept:
        sd = float(d.std(ddof=1))
        if sd <= 0:
            continue
        observed.append((r.metric, r.estimate / sd))
        rows += [(i, r.metric, float(v)) for i, v in enumerate((d - d.mean()) / sd)]
    p = inference.max_t_stepdown(spark.createDataFrame(observed, "hypothesis string, statistic double"), spark.createDataFrame(rows, "draw long, hypothesis string, statistic double"))
    return {r["hypothesis"]: r["adjusted"] for r in p.collect()}


def business_ok(impact: float | None, least: float | None) -> bool | None:
    """Whether an impact reaches its minimum; None where nothing is asked."""
    return None if least is None else impact is not None and impact >= least


def posterior_ok(probability: float | None, threshold: float = 0.95) -> bool | None:
    return None if probability is None else probability >= threshold


def blocks_decision(role: str, passed: bool, conclusion: str) -> bool:
    """Whether a metric of this role stops a launch."""
    if role in ("guardrail", "cost", "quality", "validity"):
        return not passed
    return role == "deterioration" and conclusion == "detected"
