"""A completed test from panel to decision: estimates, configured inference, monitoring, calibration, multiplicity."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import EstimationError, ValidationError
from terralift.functions.metrics import Metric, RatioMetric
from terralift.operators import inference, power
from terralift.operators.design import Design, geo_periods, prepared
from terralift.operators.estimators import Estimate, fit_all
from terralift.operators.markets import ListedPolicy, Policy
from terralift.operators.panel import GeoPanel
from terralift.operators.reports import analysis_payload
from terralift.operators.specs import CompletedSpec

#: Names of inference methods and what else they go by.
METHODS = ("estimator_default", "randomization_inference", "market_bootstrap", "jackknife", "conformal_inference", "few_cluster_robust")
METHOD_NAMES = {"bootstrap": "market_bootstrap", "block_bootstrap": "market_bootstrap", "split_conformal": "conformal_inference", "randomization": "randomization_inference"}
#: Which inference goes first where several fit.
RANK = {"randomization_test": 100, "few_cluster_wild_bootstrap": 90, "jackknife": 80, "bootstrap": 70, "conformal_inversion": 65, "split_conformal": 60, "native": 55}


@dataclass(frozen=True)
class Estimand:
    """What an estimate is of; two are the same only if all of it is."""

    scale: str = "additive"
    population: str = "treated"
    time: str = "post"
    aggregation: str = "mean"

    def compatible(self, other: Estimand) -> bool:
        return self == other

    def lift_comparable(self, other: Estimand) -> bool:
        """Lifts may be set side by side if they are of the same markets and dates; scales don't matter."""
        return (self.population, self.time) == (other.population, other.time)


ESTIMANDS = {
    "did": Estimand(), "ratio_delta": Estimand(), "block_bootstrap": Estimand(), "cuped": Estimand(aggregation="total"),
    **{k: Estimand(aggregation="cumulative_mean_path") for k in ("synthetic_control", "augmented_synthetic_control")}, "synthetic_did": Estimand(aggregation="mean_path"),
    **{k: Estimand(aggregation="cumulative_total") for k in ("matrix_completion", "generalized_synthetic_control", "tbr", "forecast", "state_space")},
}


def estimand(name: str, metric: Metric) -> Estimand:
    base = ESTIMANDS.get(name, Estimand())
    return Estimand("ratio", base.population, base.time, base.aggregation) if isinstance(metric, RatioMetric) else base


def market_effects(panel: GeoPanel, design: Design, metric: Metric) -> list[tuple[str, int, float]]:
    """(market, treated, post mean less pre mean): one row a market."""
    rows = geo_periods(prepared(panel, design, metric)).select("geo", "treated", "delta").orderBy("geo").collect()
    if {r["treated"] for r in rows} != {0, 1}:
        raise EstimationError("an arm lacks markets with both periods.")
    return [(r["geo"], r["treated"], r["delta"]) for r in rows]


def configured_inference(method: str, effects: list[tuple[str, int, float]], estimate: Estimate, post_days: int, alpha: float = 0.05, alternative: str = "two-sided", null: float = 0.0, seed: int = 0) -> inference.Inference:
    """One of the named methods over market effects, or over an estimate's gaps."""
    method = METHOD_NAMES.get(method, method)
    if method not in METHODS:
        raise ValidationError(f"unknown inference {method!r}.", f"Use one of {METHODS}.")
    confidence = 1 - alpha
    t, c = [e for _, z, e in effects if z], [e for _, z, e in effects if not z]
    if method == "randomization_inference":
        outcomes = {g: e for g, _, e in effects}
        treated = [g for g, z, _ in effects if z]
        if math.comb(len(outcomes), len(treated)) <= 20_000:
            return inference.randomization_test(outcomes, treated, alternative=alternative, null=null, confidence=confidence)
        rng = np.random.default_rng(seed)
        names = list(outcomes)
        drawn = {frozenset(rng.choice(names, len(treated), replace=False).tolist()) for _ in range(2000)}
        return inference.randomization_test(outcomes, treated, drawn, exact=False, alternative=alternative, null=null, confidence=confidence)
    if method in ("market_bootstrap", "few_cluster_robust") and min(len(t), len(c)) < 2:
        raise EstimationError("each arm needs two markets at least.")
    gap = lambda rows: float(np.mean([e for _, z, e in rows if z]) - np.mean([e for _, z, e in rows if not z]))
    if method == "market_bootstrap":
        return inference.bootstrap(effects, gap, strata=[z for _, z, _ in effects], seed=seed, confidence=confidence, alternative=alternative, null=null)
    if method == "jackknife":
        return inference.jackknife(effects, gap, confidence, null, alternative)
    if method == "few_cluster_robust":
        return inference.wild_bootstrap(t, c, seed=seed, confidence=confidence)
    if method == "conformal_inference":
        gaps = estimate.artifacts.get("gaps")
        if not gaps or len(gaps) <= post_days:
            raise EstimationError(f"{estimate.estimator} leaves no gaps for conformal inference.")
        return inference.conformal_inversion(gaps[-post_days:], gaps[:-post_days], confidence, null, alternative)
    return inference.Inference("native", estimate.estimate, estimate.interval, estimate.p_value, estimate.standard_error, confidence)


def compatible_inference(estimate: Estimate, found: inference.Inference) -> bool:
    """Whether an interval is of the estimate's own point."""
    return found.interval is not None and math.isclose(found.estimate, estimate.estimate, rel_tol=1e-7, abs_tol=1e-9)


def inference_rank(found: inference.Inference) -> int:
    return RANK.get(found.method, 0)


def promote(estimate: Estimate, found: list[inference.Inference], preferred: str | None = None) -> Estimate:
    """Take the interval and p of the best method whose point is the estimate's; else the native ones stay, with a warning."""
    fitting = [i for i in found if compatible_inference(estimate, i)]
    if fitting:
        best = max(fitting, key=lambda i: (i.method == preferred, inference_rank(i)))
        estimate.interval, estimate.p_value = best.interval, best.p_value
        estimate.diagnostics["primary_inference"] = best.method
    elif found:
        estimate.warnings.append("no configured inference is of the same estimand; native inference stays")
    return estimate


def null_value(framework: str, margin: float, baseline: float | None = None, relative: bool = False) -> tuple[float, str]:
    """(value under the null, alternative) of a framework."""
    m = abs(margin) * (abs(baseline) if relative and baseline is not None else 1.0)
    return {"non_inferiority": (-m, "greater"), "inferiority": (m, "less"), "superiority": (0.0, "greater")}.get(framework, (0.0, "two-sided"))


def alternative_of(framework: str) -> str:
    return null_value(framework, 0.0)[1]


def assignment_policy(kind: str, design: Design, treatment_count: int | None = None, allowed: list[list[str]] | None = None) -> Policy:
    """The policy that a completed test was drawn by, over the markets of its design: a fixed number of treated markets,
    or one of listed assignments, of which those outside the design are left out."""
    if kind == "fixed_treatment_count":
        return Policy(tuple(sorted(design.geos)), treatment_count or len(design.treatment))
    if kind == "candidate_constrained":
        kept = [tuple(sorted(a)) for a in allowed or () if {*a} <= {*design.geos}]
        if not kept:
            raise ValidationError("no listed assignment lies within the design.", "List markets of the design.")
        return ListedPolicy(tuple(sorted(design.geos)), len(kept[0]), "listed", listed=tuple(dict.fromkeys(kept)))
    raise ValidationError(f"a completed test can't be of policy {kind!r}.", "Use fixed_treatment_count or candidate_constrained.")


def daily_gaps(panel: GeoPanel, design: Design, metric: Metric) -> DataFrame:
    """``time, gap``: the arms' daily gap after the start, less its mean before."""
    df = prepared(panel, design, metric)
    g = df.groupBy("time", "post").agg((F.avg(F.when(F.col("treated") == 1, F.col("outcome"))) - F.avg(F.when(F.col("treated") == 0, F.col("outcome")))).alias("gap")).where("gap is not null")
    before = g.where("post = 0").agg(F.avg("gap").alias("level"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    return g.where("post = 1").crossJoin(F.broadcast(before)).select("time", (F.col("gap") - F.col("level")).alias("gap"), (F.col("low") - F.col("level")).alias("low"), (F.col("high") - F.col("level")).alias("high"))


def monitoring_bounds(seen: tuple[float, float], bounds: tuple[float, float]) -> tuple[tuple[float, float], list[str]]:
    """Bounds that hold all observations: the given ones, widened with a warning where some left them."""
    low, high = bounds
    if seen[0] >= low and seen[1] <= high and low < high:
        return (low, high), []
    low = min(low, seen[0])
    return (low, max(high, seen[1], low + 1e-9)), ["observations left the bounds, which were widened"]


def planned_looks(n: int, shares: list[float]) -> list[int]:
    """Places of the looks among ``n`` dates: shares rounded up, or every date."""
    return sorted({min(n, max(1, math.ceil(x * n))) for x in shares}) or list(range(1, n + 1))


def monitoring(panel: GeoPanel, design: Design, metric: Metric, looks: list[float], bounds: tuple[float, float] | None = None, alpha: float = 0.05, widen: bool = True) -> dict[str, Any]:
    """Confidence sequence and e-values at the planned looks (shares of the post period), valid however often one looks.

    Observations outside the bounds end that guarantee, and a warning says so; ``widen`` then widens the bounds, else
    given ones stay as declared.
    """
    gaps = daily_gaps(panel, design, metric)
    r = gaps.agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("a"), F.max("gap").alias("b"), F.max("low").alias("low"), F.max("high").alias("high")).first()
    if not r["n"]:
        raise EstimationError("no post-period dates.")
    (low, high), warnings = monitoring_bounds((r["a"], r["b"]), bounds or (r["low"], r["high"]))
    if warnings and bounds and not widen:
        (low, high), warnings = bounds, ["observations left the declared bounds, which were kept"]
    rows = gaps.withColumn("k", F.lit(0))
    seq = inference.confidence_sequence(rows, ["k"], "time", "gap", low, high, alpha)
    e = inference.e_values(rows, ["k"], "time", "gap", low, high, bet=None, two_sided=True).select("look", "e_value", "p_value")
    at = planned_looks(r["n"], looks)
    found = seq.join(e, "look").where(F.col("look").isin(at)).orderBy("look").collect()
    return {"looks": [x.asDict() for x in found], "bounds": (low, high), "warnings": warnings}


def apply_multiplicity(spark: SparkSession, results: list[Estimate], primary: str, method: str) -> dict[str, float]:
    """Adjusted p of the primary estimator's metrics, as one family."""
    rows = [(r.metric, r.p_value) for r in results if r.estimator == primary and r.p_value is not None]
    if not rows:
        return {}
    df = spark.createDataFrame([("primary", *x) for x in rows], "family string, metric string, p double")
    out = {r["metric"]: r["adjusted"] for r in inference.adjusted(df, "p", ["family"], "metric", method).collect()}
    for r in results:
        if r.estimator == primary and r.metric in out:
            r.diagnostics["adjusted_p_value"] = out[r.metric]
    return out


@dataclass
class Analysis:
    """All that was found of a completed test."""

    results: list[Estimate]
    inference: dict[str, list[inference.Inference]] = field(default_factory=dict)
    monitoring: dict[str, Any] = field(default_factory=dict)
    calibration: dict[str, Any] = field(default_factory=dict)
    adjusted: dict[str, float] = field(default_factory=dict)
    payload: dict[str, Any] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


def analyze(panel: GeoPanel, spec: CompletedSpec, names: list[str] | None = None) -> Analysis:
    """Every estimator on every metric, then what the specification asks for of the primary one."""
    design, metrics = spec.design, list(spec.catalog.metrics.values())
    names = list(dict.fromkeys([spec.primary_estimator, *(names or spec.estimators or [])])) if (names or spec.estimators) else None
    out = Analysis(fit_all(panel, design, metrics, names))
    post_days = panel.slice(spec.start, spec.end).df.select(panel.time).distinct().count()
    null, alternative = null_value(spec.framework, spec.margin)
    for m in metrics:
        main = next((r for r in out.results if r.metric == m.name and r.estimator == spec.primary_estimator), None)
        if main is None or main.error:
            continue
        if spec.inference:
            effects, found = market_effects(panel, design, m), []
            for method in spec.inference:
                try:
                    found.append(configured_inference(method, effects, main, post_days, spec.alpha, alternative, null))
                except EstimationError as e:
                    out.errors.append(f"{m.name}, {method}: {e}")
            out.inference[m.name] = found
            promote(main, found)
        if spec.looks:
            out.monitoring[m.name] = monitoring(panel, design, m, spec.looks, spec.bounds, spec.alpha)
        checks: dict[str, Any] = {}
        if spec.placebo_windows:
            checks["placebo_in_time"] = power.placebo_in_time(panel, design, m, spec.primary_estimator, spec.placebo_windows, spec.alpha)
        if spec.injected_lifts:
            checks["injected_lift"] = power.injected_recovery(panel, design, m, spec.primary_estimator, spec.injected_lifts)
        if checks:
            out.calibration[m.name] = checks
    out.adjusted = apply_multiplicity(panel.df.sparkSession, out.results, spec.primary_estimator, spec.multiplicity)
    out.payload = analysis_payload(spec.experiment_id, out.results, spec.primary_estimator, spec.framework, spec.margin, spec.alpha)
    return out


def calibration_status_of(checks: dict[str, dict[str, Any]], requested: bool) -> str:
    """One word for all checks of a test: the worst that ran, not_applicable if none could, not_requested."""
    if not requested:
        return "not_requested"
    found = {c.get("status", "run") for c in checks.values()}
    return next((s for s in ("fail", "warning", "not_applicable") if s in found and (s != "not_applicable" or found == {s})), "run")


def joint_draws(results: list[Estimate]) -> tuple[dict[str, float], np.ndarray, list[str]]:
    """Observed statistics and null draws (draws x metrics) over their deviations, of the estimates that kept as many
    draws as the first that kept any; the others' names."""
    kept = [r for r in results if r.artifacts.get("draws") is not None and np.std(r.artifacts["draws"], ddof=1) > 0]
    n = len(kept[0].artifacts["draws"]) if kept else 0
    fit = [r for r in kept if len(r.artifacts["draws"]) == n]
    columns = [np.asarray(r.artifacts["draws"], float) for r in fit]
    scaled = [(c - c.mean()) / c.std(ddof=1) for c in columns]
    seen = {r.metric: r.estimate / float(c.std(ddof=1)) for r, c in zip(fit, columns, strict=True)}
    return seen, np.column_stack(scaled) if scaled else np.zeros((0, 0)), [r.metric for r in results if r not in fit]


def methodology_status(analysis: Analysis) -> dict[str, Any]:
    """What ran and what warned."""
    return {
        "estimates": sum(r.error is None for r in analysis.results), "failed": sum(r.error is not None for r in analysis.results),
        "inference": sorted({i.method for v in analysis.inference.values() for i in v}), "monitored": sorted(analysis.monitoring), "calibrated": sorted(analysis.calibration),
        "warnings": [f"{r.estimator}, {r.metric}: {w}" for r in analysis.results for w in r.warnings] + analysis.errors,
    }
