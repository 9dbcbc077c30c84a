"""Estimators of completed tests. Sums and means are plans over the panel; what stays small is solved in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralift.errors import EstimationError, OptionalDependencyError, ValidationError
from terralift.functions import linear
from terralift.functions.metrics import Metric, RatioMetric, ratio
from terralift.functions.stats import NORMAL, binomial_two_sided
from terralift.operators import inference
from terralift.operators.design import Design, geo_periods, observed_summary, prepared, wide_matrix
from terralift.operators.panel import GeoPanel


@dataclass
class Estimate:
    """What every estimator returns."""

    estimator: str
    metric: str
    estimate: float
    interval: tuple[float, float] | None = None
    p_value: float | None = None
    standard_error: float | None = None
    relative_lift: float | None = None
    relative_interval: tuple[float, float] | None = None
    diagnostics: dict[str, Any] = field(default_factory=dict)
    artifacts: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None

    def with_lift(self, observed_total: float | None) -> Estimate:
        """Lift against the observed total less the effect."""
        if observed_total is not None and math.isfinite(observed_total):
            one = lambda e: e / abs(observed_total - e) if abs(observed_total - e) > 1e-12 else None
            self.relative_lift = one(self.estimate)
            if self.interval and all(math.isfinite(x) for x in self.interval):
                ends = [one(e) for e in self.interval]
                self.relative_interval = tuple(sorted(ends)) if None not in ends else None
        return self


# ---- difference in differences -------------------------------------------------------------------------------


def two_by_two(df: DataFrame) -> DataFrame:
    """One row ``did, treatment_pre, ...``: differences of geo-period means of a prepared frame."""
    cell = lambda t, p: F.avg(F.when(F.col("treated") == t, F.col(p)))
    row = geo_periods(df).agg(cell(1, "pre").alias("treatment_pre"), cell(1, "post").alias("treatment_post"), cell(0, "pre").alias("control_pre"), cell(0, "post").alias("control_post"))
    return row.withColumn("did", (F.col("treatment_post") - F.col("treatment_pre")) - (F.col("control_post") - F.col("control_pre")))


def did(panel: GeoPanel, design: Design, metric: Metric, covariates: list[str] | None = None, select: bool = False, backend: str = "native") -> Estimate:
    """Two-way fixed effects. The plan gives each cell's mean; effects of markets and dates are taken out exactly by
    normal equations, so unbalanced panels are right too; errors are clustered by market."""
    if backend not in ("native", "auto"):
        raise OptionalDependencyError(f"backend {backend!r} isn't installed; use native.")
    df = prepared(panel, design, metric, extra=covariates)
    cells = df.groupBy("geo", "time", "treated", "post").agg(F.avg("outcome").alias("y"), *[F.avg(F.col(c).cast("double")).alias(c) for c in covariates or ()])
    rows = cells.orderBy("geo", "time").collect()
    geos, times = sorted({r["geo"] for r in rows}), sorted({r["time"] for r in rows})
    at_g, at_t = {g: i for i, g in enumerate(geos)}, {t: i for i, t in enumerate(times)}
    y = np.array([r["y"] for r in rows])
    g, t = np.array([at_g[r["geo"]] for r in rows]), np.array([at_t[r["time"]] for r in rows])
    x = np.column_stack([[r["treated"] * r["post"] for r in rows], *[[r[c] or 0.0 for r in rows] for c in covariates or ()]]).astype(float)
    if len({(r["treated"], r["post"]) for r in rows}) < 4:
        raise EstimationError("an arm lacks a period.")
    flat = demeaned(np.column_stack([y, x]), g, t)
    if select and covariates:
        before = np.array([not r["post"] for r in rows])
        kept = linear.forward_select(flat[before, 0], np.ones((int(before.sum()), 1)), {c: flat[before, 2 + i] for i, c in enumerate(covariates)})
        flat = flat[:, [0, 1, *[2 + i for i, c in enumerate(covariates) if c in kept]]]
    beta, e = linear.ols(flat[:, 1:], flat[:, 0])
    effect = float(beta[0])
    arms = [len({r["geo"] for r in rows if r["treated"] == k}) for k in (0, 1)]
    out = Estimate("did", metric.name, effect)
    if min(arms) >= 2:
        k = flat.shape[1] - 1 + len(geos) + len(times) - 1
        v = linear.clustered(flat[:, 1:], e, g)[0, 0]
        n = len(y)
        v *= (n - flat.shape[1] + 1) / max(1, n - k)  # all fixed effects count as parameters
        out.standard_error = math.sqrt(max(v, 0.0))
        df_ = len(geos) - 1
        if out.standard_error > 1e-12:
            out.interval = inference.t_interval(effect, out.standard_error, df_)
            out.p_value = inference.t_p_value(effect, out.standard_error, df_)
        else:
            out.interval, out.p_value = (effect, effect), 0.0 if abs(effect) > 1e-12 else 1.0
    else:
        out.warnings.append("an arm has a single market: no standard error")
    out.diagnostics = parallel_trends(df)
    if out.diagnostics.get("status") == "warning":
        out.warnings.append("pre-period trends of the arms differ")
    seen = observed_summary(panel, design, metric).first()
    if isinstance(metric, RatioMetric):
        d = df.where("treated = 1 and post = 1").agg(F.avg(F.col(metric.denominator).cast("double"))).first()[0]
        out.artifacts["ratio_effect"] = effect / d if d else None
    out.with_lift(seen["treatment_post"] if not isinstance(metric, RatioMetric) else None)
    return out


def demeaned(values: np.ndarray, g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values less their fit on market and date effects, by alternating means until they settle."""
    out = values - values.mean(0)
    ng, nt = np.bincount(g)[:, None], np.bincount(t)[:, None]
    for _ in range(2000):
        before = out
        for at, n in ((g, ng), (t, nt)):
            sums = np.zeros((len(n), out.shape[1]))
            np.add.at(sums, at, out)
            out = out - (sums / n)[at]
        if np.abs(out - before).max() < 1e-12 * max(1.0, np.abs(values).max()):
            break
    return out


def parallel_trends(df: DataFrame) -> dict[str, Any]:
    """Slopes of the arms' pre-period means, and of the gap between them over its spread."""
    day = F.datediff(F.to_date("time"), F.lit("1970-01-01"))
    pre = df.where("post = 0").groupBy("time").agg(F.avg(F.when(F.col("treated") == 1, F.col("outcome"))).alias("t"), F.avg(F.when(F.col("treated") == 0, F.col("outcome"))).alias("c")).where("t is not null and c is not null").withColumns({"day": day.cast("double"), "gap": F.col("t") - F.col("c")})
    r = pre.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("t", "day").alias("treatment_slope"), F.regr_slope("c", "day").alias("control_slope"), F.regr_slope("gap", "day").alias("gap_slope"), F.stddev_samp("gap").alias("gap_sd")).first().asDict()
    if r["n"] < 3:
        return {**r, "status": "insufficient"}
    relative = abs(r["gap_slope"] or 0.0) / r["gap_sd"] if r["gap_sd"] else 0.0
    return {**r, "relative_gap_slope": relative, "status": "warning" if relative > 0.1 else "ok"}


def ratio_cells(panel: GeoPanel, design: Design, metric: RatioMetric) -> DataFrame:
    """``geo, treated, n_pre, d_pre, n_post, d_post``: sums of a ratio's parts."""
    df = prepared(panel, design, metric, linearize=False)
    sums = [F.coalesce(F.sum(F.when(F.col("post") == p, F.col(c).cast("double"))), F.lit(0.0)).alias(f"{k}_{name}") for c, k in ((metric.numerator, "n"), (metric.denominator, "d")) for p, name in ((0, "pre"), (1, "post"))]
    return df.groupBy("geo", "treated").agg(*sums)


def ratio_did(cells: DataFrame) -> DataFrame:
    """One row ``ratio_did``: the arms' changes in their ratios of sums."""
    r = lambda t, p: ratio(F.sum(F.when(F.col("treated") == t, F.col(f"n_{p}"))), F.sum(F.when(F.col("treated") == t, F.col(f"d_{p}"))))
    return cells.agg(((r(1, "post") - r(1, "pre")) - (r(0, "post") - r(0, "pre"))).alias("ratio_did"))


def ratio_did_jackknife(cells: DataFrame) -> DataFrame:
    """``geo, ratio_did`` with each market left out: totals less its own sums, in one pass."""
    names = ["n_pre", "d_pre", "n_post", "d_post"]
    # one row of totals
    totals = cells.agg(*[F.sum(F.when(F.col("treated") == t, F.col(c))).alias(f"{c}_{t}") for t in (0, 1) for c in names])
    rows = cells.crossJoin(F.broadcast(totals))
    left = lambda c, t: F.col(f"{c}_{t}") - F.when(F.col("treated") == t, F.col(c)).otherwise(0.0)
    r = lambda t, p: ratio(left(f"n_{p}", t), left(f"d_{p}", t))
    return rows.select("geo", ((r(1, "post") - r(1, "pre")) - (r(0, "post") - r(0, "pre"))).alias("ratio_did"))


def bootstrap_weights(units: DataFrame, draws: int, strata: str, seed: int = 0) -> DataFrame:
    """``draw, geo, weight``: how often each unit is drawn, with replacement within its stratum.

    Draws are a table of its own, made from hashes of (seed, draw, slot), so any number of them is one join.
    """
    w = Window.partitionBy(strata)
    slots = units.select("geo", strata, (F.row_number().over(w.orderBy("geo")) - 1).alias("slot"), F.count(F.lit(1)).over(w).alias("size"))
    spark = units.sparkSession
    # markets x draws is the result's own size
    drawn = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(slots.select(strata, "slot", "size")))
    drawn = drawn.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "draw", strata, "slot"), F.col("size")))
    counts = drawn.groupBy("draw", strata, "pick").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(F.broadcast(slots.select(strata, F.col("slot").alias("pick"), "geo")), [strata, "pick"]).select("draw", "geo", "weight")


def ratio_delta(panel: GeoPanel, design: Design, metric: Metric, draws: int = 500, seed: int = 0, confidence: float = 0.95) -> Estimate:
    """Ratio: change in ratios of sums with a market bootstrap. Additive: mean change by market with Welch's interval."""
    if not isinstance(metric, RatioMetric):
        g = geo_periods(prepared(panel, design, metric))
        r = inference.welch_by(g.withColumn("all", F.lit(1)), ["all"], "delta", "treated").first()
        se, df_ = r["standard_error"], r["df"]
        out = Estimate("ratio_delta", metric.name, r["estimate"], inference.t_interval(r["estimate"], se, df_, confidence) if se else None, inference.t_p_value(r["estimate"], se, df_) if se else None, se)
        return out.with_lift(observed_summary(panel, design, metric).first()["treatment_post"])
    return _bootstrapped(panel, design, metric, "ratio_delta", draws, seed, confidence)


def block_bootstrap(panel: GeoPanel, design: Design, metric: Metric, draws: int = 500, seed: int = 0, confidence: float = 0.95) -> Estimate:
    """Market bootstrap of the difference in differences, within arms."""
    return _bootstrapped(panel, design, metric, "block_bootstrap", draws, seed, confidence)


def bootstrap_statistics(panel: GeoPanel, design: Design, metric: Metric, draws: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row ``estimate``, ``draw, estimate``, ``geo, estimate`` leaving it out)."""
    if isinstance(metric, RatioMetric):
        cells = ratio_cells(panel, design, metric)
        weighted = cells.join(bootstrap_weights(cells, draws, "treated", seed), "geo")
        r = lambda t, p: ratio(F.sum(F.when(F.col("treated") == t, F.col("weight") * F.col(f"n_{p}"))), F.sum(F.when(F.col("treated") == t, F.col("weight") * F.col(f"d_{p}"))))
        drawn = weighted.groupBy("draw").agg(((r(1, "post") - r(1, "pre")) - (r(0, "post") - r(0, "pre"))).alias("estimate"))
        return ratio_did(cells).withColumnRenamed("ratio_did", "estimate"), drawn, ratio_did_jackknife(cells).withColumnRenamed("ratio_did", "estimate")
    g = geo_periods(prepared(panel, design, metric)).select("geo", "treated", "delta")
    mean = lambda t, w: F.sum(F.when(F.col("treated") == t, w * F.col("delta"))) / F.sum(F.when(F.col("treated") == t, w))
    whole = g.agg((mean(1, F.lit(1)) - mean(0, F.lit(1))).alias("estimate"))
    drawn = g.join(bootstrap_weights(g, draws, "treated", seed), "geo").groupBy("draw").agg((mean(1, F.col("weight")) - mean(0, F.col("weight"))).alias("estimate"))
    w = Window.partitionBy("treated")
    left = ratio(F.sum("delta").over(w) - F.col("delta"), F.count(F.lit(1)).over(w) - 1)
    means = g.groupBy().agg(mean(1, F.lit(1)).alias("m1"), mean(0, F.lit(1)).alias("m0"))  # one row
    jack = g.withColumn("left", left).crossJoin(F.broadcast(means)).select("geo", F.when(F.col("treated") == 1, F.col("left") - F.col("m0")).otherwise(F.col("m1") - F.col("left")).alias("estimate"))
    return whole, drawn, jack


def _bootstrapped(panel: GeoPanel, design: Design, metric: Metric, name: str, draws: int, seed: int, confidence: float) -> Estimate:
    whole, drawn, jack = bootstrap_statistics(panel, design, metric, draws, seed)
    estimate = whole.first()["estimate"]
    if estimate is None:
        raise EstimationError("an arm lacks a period.")
    d = np.array([r["estimate"] for r in drawn.collect() if r["estimate"] is not None])
    j = [r["estimate"] for r in jack.collect() if r["estimate"] is not None]
    out = Estimate(name, metric.name, estimate, standard_error=float(d.std(ddof=1)), p_value=inference.plus_one_p(estimate, d - d.mean()))
    try:
        out.interval, out.diagnostics = inference.bca_interval(estimate, d, j, confidence)
    except EstimationError:
        out.interval = tuple(float(np.quantile(d, p)) for p in ((1 - confidence) / 2, (1 + confidence) / 2))
        out.warnings.append("percentile interval: too few units for BCa")
    return out.with_lift(observed_summary(panel, design, metric).first()["treatment_post"])


# ---- market-level regression ---------------------------------------------------------------------------------


def cuped(panel: GeoPanel, design: Design, metric: Metric, covariates: list[str] | None = None, select: bool = False) -> Estimate:
    """Post totals by market on treatment and centred pre-period covariates, HC3 errors; the effect is a total."""
    df = prepared(panel, design, metric, extra=covariates, linearize=False)
    pre = [F.avg(F.when(F.col("post") == 0, F.col(c).cast("double"))).alias(f"x_{c}") for c in covariates or ()]
    if isinstance(metric, RatioMetric):
        v = lambda p: ratio(*[F.sum(F.when(F.col("post") == p, F.col(c).cast("double"))) for c in metric.columns])
    else:
        v = lambda p: F.sum(F.when(F.col("post") == p, F.col("outcome")))
    rows = df.groupBy("geo", "treated").agg(v(0).alias("pre"), v(1).alias("post"), *pre).where("pre is not null and post is not null").orderBy("geo").collect()
    z = np.array([r["treated"] for r in rows], float)
    y = np.array([r["post"] for r in rows], float)
    if z.sum() < 1 or z.sum() == len(z):
        raise EstimationError("an arm is empty.")
    names = ["pre", *[f"x_{c}" for c in covariates or ()]]
    features, _ = linear.centred_features({c: np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in names})
    if select:
        c = z == 0
        chosen = linear.forward_select(y[c], np.ones((int(c.sum()), 1)), {k: v_[c] for k, v_ in features.items()})
        features = {k: features[k] for k in chosen}
    x = np.column_stack([np.ones_like(y), z, *features.values()])
    if len(y) <= x.shape[1]:
        raise EstimationError("fewer markets than coefficients.")
    beta, e = linear.ols(x, y)
    se = math.sqrt(max(linear.hc3(x, e)[1, 1], 0.0))
    scale = 1.0 if isinstance(metric, RatioMetric) else float(z.sum())
    effect = float(beta[1]) * scale
    out = Estimate("cuped", metric.name, effect, inference.t_interval(effect, se * scale, len(y) - x.shape[1]), inference.t_p_value(effect, se * scale, len(y) - x.shape[1]), se * scale, diagnostics={"covariates": list(features), "n_markets": len(y)})
    return out.with_lift(float(y[z == 1].sum()) if scale != 1.0 or z.sum() == 1 else float(y[z == 1].mean()))


# ---- treated path against a model of it ----------------------------------------------------------------------


def arm_series(panel: GeoPanel, design: Design, metric: Metric) -> DataFrame:
    """``time, post, treatment, control``: totals (or ratios of sums) of the arms by date."""
    df = prepared(panel, design, metric, linearize=False)
    if isinstance(metric, RatioMetric):
        v = lambda t: ratio(*[F.sum(F.when(F.col("treated") == t, F.col(c).cast("double"))) for c in metric.columns])
    else:
        v = lambda t: F.sum(F.when(F.col("treated") == t, F.col("outcome")))
    return df.groupBy("time", "post").agg(v(1).alias("treatment"), v(0).alias("control"))


def tbr_terms(series: DataFrame) -> DataFrame:
    """One row: slope and intercept of treatment on control before the test, and the cumulative gap after it."""
    fit = series.where("post = 0").agg(F.regr_slope("treatment", "control").alias("slope"), F.regr_intercept("treatment", "control").alias("intercept"), F.count(F.lit(1)).alias("n_pre"))
    post = series.where("post = 1").agg(F.sum("treatment").alias("observed"), F.sum("control").alias("control"), F.count(F.lit(1)).alias("n_post"))
    row = fit.crossJoin(post)  # a row each
    return row.select("slope", "intercept", "n_pre", "n_post", "observed", (F.col("observed") - F.col("slope") * F.col("control") - F.col("intercept") * F.col("n_post")).alias("effect"))


def tbr(panel: GeoPanel, design: Design, metric: Metric) -> Estimate:
    """Time-based regression of the treated total on the control total."""
    series = arm_series(panel, design, metric).where("treatment is not null and control is not null")
    r = tbr_terms(series).first()
    if r["n_pre"] < 5 or not r["n_post"]:
        raise EstimationError("five pre-period dates are needed at least.")
    if r["slope"] is None:
        raise EstimationError("the control total doesn't vary before the test.")
    rows = series.orderBy("time").collect()
    e = np.array([x["treatment"] - r["intercept"] - r["slope"] * x["control"] for x in rows])
    post = np.array([bool(x["post"]) for x in rows])
    pre_x, post_x = (np.array([x["control"] for x in rows])[m] for m in (~post, post))
    s2 = float((e[~post] ** 2).sum() / max(1, len(pre_x) - 2))
    sxx = float(((pre_x - pre_x.mean()) ** 2).sum())
    n1 = len(post_x)
    variance = s2 * (n1**2 / len(pre_x) + (post_x.sum() - n1 * pre_x.mean()) ** 2 / max(sxx, 1e-300))
    out = inference.cumulative_residual_interval(r["effect"], e[~post], n1, variance)
    pre_y = np.array([x["treatment"] for x in rows])[~post]
    diagnostics = {"slope": r["slope"], "intercept": r["intercept"], "outliers": outlier_count(e[~post]), "half_slopes": half_slopes(pre_x, pre_y)}
    return Estimate("tbr", metric.name, r["effect"], out.interval, out.p_value, out.standard_error, diagnostics=diagnostics, artifacts={"gaps": e.tolist()}).with_lift(r["observed"])


def half_slopes(x: np.ndarray, y: np.ndarray) -> list[float] | None:
    """Slopes of y on x in the first and the second half of the dates; none for fewer than eight."""
    half = len(x) // 2
    return [float(np.polyfit(x[s], y[s], 1)[0]) for s in (slice(0, half), slice(half, None))] if len(x) >= 8 else None


def outlier_count(residuals: np.ndarray) -> int:
    """Residuals over three deviations from nothing."""
    sd = residuals.std()
    return int((np.abs(residuals) > 3 * sd).sum()) if sd else 0


def calendar_features(times: list[Any], scale: float | None = None) -> tuple[np.ndarray, float]:
    """Days since the first time, their square over ``scale`` (fixed by the fit) and weekdays as flags."""
    days = np.array([(t - times[0]).days for t in times], float)
    scale = max(1.0, days.max()) if scale is None else scale
    return np.column_stack([days, (days / scale) ** 2, *[[float(t.weekday() == k) for t in times] for k in range(7)]]), scale


def validation_periods(n_pre: int) -> int:
    """Last dates of the pre-period that are held out: a quarter, 2 to 14, and none if fewer than four would remain."""
    hold = max(2, min(14, n_pre // 4))
    return 0 if n_pre - hold < 4 else hold


def cumulative_parameter_variance(x_pre: np.ndarray, x_post: np.ndarray, residuals: np.ndarray, alpha: float) -> float:
    """Variance of a summed ridge forecast that its coefficients cause, with correlated residuals."""
    middle = x_pre.mean(0)
    design = np.column_stack([np.ones(len(x_pre)), x_pre - middle])
    bread = np.linalg.pinv(design.T @ design + alpha * np.diag([0.0] + [1.0] * x_pre.shape[1]))
    reach = np.concatenate([[len(x_post)], (x_post - middle).sum(0)])
    return inference.long_run_variance(residuals) * float(reach @ bread @ design.T @ design @ bread @ reach)


def forecast(panel: GeoPanel, design: Design, metric: Metric, alpha: float = 1.0) -> Estimate:
    """Ridge on trend, squared trend and weekdays of the treated total; a terminal stretch is held out for residuals."""
    rows = arm_series(panel, design, metric).where("treatment is not null").orderBy("time").collect()
    post = np.array([bool(r["post"]) for r in rows])
    y = np.array([r["treatment"] for r in rows], float)
    n = int((~post).sum())
    if n < 8 or not post.any():
        raise EstimationError("eight pre-period dates are needed at least.")
    times = [r["time"] for r in rows]
    _, scale = calendar_features(times[:n])
    x, _ = calendar_features(times, scale)
    hold = validation_periods(n)
    a, b = linear.ridge(x[: n - hold], y[: n - hold], alpha) if hold else (0.0, np.zeros(x.shape[1]))
    held = y[n - hold : n] - a - x[n - hold : n] @ b if hold else np.zeros(0)
    a, b = linear.ridge(x[:n], y[:n], alpha)
    e = y[:n] - a - x[:n] @ b
    residuals = held if len(held) >= 2 else e
    effect = float((y[post] - a - x[post] @ b).sum())
    variance = cumulative_parameter_variance(x[:n], x[post], e, alpha)
    out = inference.cumulative_residual_interval(effect, residuals, int(post.sum()), variance)
    return Estimate("forecast", metric.name, effect, out.interval, out.p_value, out.standard_error, diagnostics={"held_out": hold, "rmse": float(np.sqrt((residuals**2).mean()))}).with_lift(float(y[post].sum()))


def local_trend_filter(y: np.ndarray, variances: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, last state and its covariance of a local linear trend (level, slope, noise variances)."""
    state, cov = np.array([y[0], 0.0]), np.diag([1e7, 1e7])
    move, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag(variances[:2])
    total = 0.0
    for i, v in enumerate(y):
        if i:
            state, cov = move @ state, move @ cov @ move.T + q
        if not np.isfinite(v):
            continue
        s = cov[0, 0] + variances[2]
        gap = v - state[0]
        if i >= 2:
            total -= 0.5 * (math.log(2 * math.pi * s) + gap * gap / s)
        k = cov[:, 0] / s
        state, cov = state + k * gap, cov - np.outer(k, cov[0])
    return total, state, cov


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 300) -> np.ndarray:
    n = len(start)
    points = [start, *[start + np.eye(n)[i] for i in range(n)]]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-8:
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        v = f(tried)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            near = middle + 0.5 * (points[-1] - middle)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


def state_space(panel: GeoPanel, design: Design, metric: Metric, draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> Estimate:
    """Local linear trend by maximum likelihood; predictive paths give the interval and the chance of an effect above zero."""
    rows = arm_series(panel, design, metric).where("treatment is not null").orderBy("time").collect()
    y, post = np.array([r["treatment"] for r in rows], float), np.array([bool(r["post"]) for r in rows])
    pre = y[~post]
    if len(pre) < 8 or not post.any():
        raise EstimationError("eight pre-period dates are needed at least.")
    scale = max(float(pre.std()), 1e-9)
    z = pre / scale
    best = nelder_mead(lambda p: -local_trend_filter(z, np.exp(np.clip(p, -25, 10)))[0], np.log([0.1, 0.001, 0.5]))
    v = np.exp(np.clip(best, -25, 10))
    _, state, cov = local_trend_filter(z, v)
    rng = np.random.default_rng(seed)
    states = rng.multivariate_normal(state, (cov + cov.T) / 2, draws, method="eigh")
    paths = np.empty((draws, int(post.sum())))
    for i in range(paths.shape[1]):
        states[:, 0] += states[:, 1] + rng.normal(0, math.sqrt(v[0]), draws)
        states[:, 1] += rng.normal(0, math.sqrt(v[1]), draws)
        paths[:, i] = states[:, 0] + rng.normal(0, math.sqrt(v[2]), draws)
    effects = (y[post] - paths * scale).sum(1)
    effect = float(effects.mean())
    interval = tuple(float(np.quantile(effects, p)) for p in ((1 - confidence) / 2, (1 + confidence) / 2))
    return Estimate("state_space", metric.name, effect, interval, None, float(effects.std(ddof=1)), diagnostics={"probability_positive": float((effects > 0).mean()), "variances": (v * scale * scale).tolist()}, artifacts={"cumulative": np.cumsum((y[post] - paths * scale).mean(0)).tolist()}).with_lift(float(y[post].sum()))


# ---- donors --------------------------------------------------------------------------------------------------


@dataclass
class Donors:
    """Treated mean path and donor matrix (times x donors)."""

    treated: np.ndarray
    donors: np.ndarray
    names: list[str]
    post: np.ndarray
    times: list[Any]


def donor_matrix(panel: GeoPanel, design: Design, metric: Metric) -> Donors:
    names, times, m, is_t, post = wide_matrix(prepared(panel, design, metric))
    if not is_t.any() or is_t.all() or not any(post) or all(post):
        raise EstimationError("an arm or a period is empty.")
    if np.isnan(m).any():
        bad = [n for n, row in zip(names, m, strict=True) if np.isnan(row).any()]
        raise EstimationError(f"markets {bad[:5]} lack dates.")
    return Donors(m[is_t].mean(0), m[~is_t].T, [n for n, t in zip(names, is_t, strict=True) if not t], np.array(post), times)


def _path(d: Donors, treated: np.ndarray, donors: np.ndarray, penalty: float = 1e-6, augment: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counterfactual path and weights: demeaned simplex weights, with a ridge correction of the imbalance if asked."""
    pre = ~d.post
    x, y = donors[pre], treated[pre]
    mx, my = x.mean(0), y.mean()
    w = linear.simplex_weights(x - mx, y - my, penalty)
    if augment:
        w = w + _ridge_shift(x - mx, y - my, w, _ridge_alpha(x - mx, y - my))
    return (donors - mx) @ w + my, w


def _ridge_shift(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Change of weights that a ridge regression of what is left over asks for."""
    return x.T @ np.linalg.solve(x @ x.T + alpha * np.eye(len(y)), y - x @ w)


def _ridge_alpha(x: np.ndarray, y: np.ndarray) -> float:
    """Penalty of least leave-one-period-out error on 20 values below the largest squared singular value."""
    top = float(np.linalg.svd(x, compute_uv=False)[0] ** 2) or 1.0
    grid = top * np.geomspace(1, 1e-4, 20)
    gram, best = x @ x.T, (math.inf, grid[0])
    for a in grid:
        hat = gram @ np.linalg.inv(gram + a * np.eye(len(y)))
        e = (y - hat @ y) / np.maximum(1 - np.diag(hat), 1e-9)
        best = min(best, (float((e**2).mean()), a))
    return best[1]


def _donor_estimate(name: str, metric: Metric, d: Donors, augment: bool, confidence: float) -> Estimate:
    if (~d.post).sum() < (4 if augment else 2) or d.donors.shape[1] < 2:
        raise EstimationError("too few pre-period dates or donors.")
    path, w = _path(d, d.treated, d.donors, augment=augment)
    gaps = d.treated - path
    pre = gaps[~d.post]
    fit = pre_fit(d.treated[~d.post], d.donors[~d.post], path[~d.post])
    check_pre_fit(fit)
    out = inference.conformal_inversion(gaps[d.post], pre, confidence)
    diagnostics = {**fit, "hhi": float((w**2).sum()), "weights": dict(zip(d.names, w.tolist(), strict=True))}
    estimate = Estimate(name, metric.name, float(gaps[d.post].sum()), out.interval, out.p_value, diagnostics=diagnostics, artifacts={"counterfactual": path.tolist(), "gaps": gaps.tolist()})
    if out.interval is None and d.donors.shape[1] >= 3:
        null = placebo_in_donors(d, augment)
        fallback = inference.empirical_interval(estimate.estimate, null, confidence)
        estimate.interval, estimate.p_value = fallback.interval, fallback.p_value
    return estimate.with_lift(float(d.treated[d.post].sum()))


def pre_fit(treated: np.ndarray, donors: np.ndarray, path: np.ndarray) -> dict[str, float]:
    """How well a path follows the treated one before the test, and how often that lies outside all donors."""
    rmse = float(np.sqrt(((treated - path) ** 2).mean()))
    outside = float(((treated > donors.max(1)) | (treated < donors.min(1))).mean())
    return {"pre_rmse": rmse, "relative_rmse": rmse / max(float(np.abs(treated).mean()), 1e-12), "outside_donors": outside}


def check_pre_fit(fit: dict[str, float], most: float = 0.3) -> None:
    """Raises if the error before the test is over this share of the level."""
    if fit["relative_rmse"] > most:
        raise EstimationError(f"the donors miss the treated path before the test: RMSE {fit['pre_rmse']:.4g}, {fit['relative_rmse']:.0%} of its level.")


def placebo_in_donors(d: Donors, augment: bool = False) -> list[float]:
    """Effects found when each donor plays the treated market."""
    out = []
    for k in range(d.donors.shape[1]):
        path, _ = _path(d, d.donors[:, k], np.delete(d.donors, k, 1), augment=augment)
        out.append(float((d.donors[:, k] - path)[d.post].sum()))
    return out


def synthetic_control(panel: GeoPanel, design: Design, metric: Metric, confidence: float = 0.95, backend: str = "native") -> Estimate:
    if backend not in ("native", "auto"):
        raise OptionalDependencyError(f"backend {backend!r} isn't installed; use native.")
    return _donor_estimate("synthetic_control", metric, donor_matrix(panel, design, metric), False, confidence)


def augmented_synthetic_control(panel: GeoPanel, design: Design, metric: Metric, confidence: float = 0.95) -> Estimate:
    return _donor_estimate("augmented_synthetic_control", metric, donor_matrix(panel, design, metric), True, confidence)


def _frank_wolfe(a: np.ndarray, b: np.ndarray, zeta: float, start: np.ndarray, rounds: int, least: float) -> np.ndarray:
    """Simplex weights that minimise |a w - b|^2 / rows + zeta^2 |w|^2, by exact line search."""
    w, n = start, len(b)
    before = math.inf
    for _ in range(rounds):
        e = a @ w - b
        grad = a.T @ e + n * zeta**2 * w
        i = int(grad.argmin())
        step = -w.copy()
        step[i] += 1
        move = a @ step
        curve = move @ move + n * zeta**2 * (step @ step)
        if curve <= 0:
            break
        w = w + min(1.0, max(0.0, -(grad @ step) / curve)) * step
        value = zeta**2 * (w @ w) + float(((a @ w - b) ** 2).mean())
        if before - value < least**2:
            break
        before = value
    return w


def eta_of_times(n0: int, t0: int) -> tuple[float, list[str]]:
    """Regularisation of time weights, which grows where dates are many for the donors, and a warning."""
    share = t0 / n0
    return 1e-6 if share <= 8 else min(0.1, 0.01 * share / 8), ["many pre-period dates for few donors"] if share >= 10 else []


def sparsified(w: np.ndarray) -> np.ndarray:
    """Weights without those up to a quarter of the largest, adding up to one."""
    w = np.where(w <= w.max() / 4, 0, w)
    return w / w.sum()


def collapsed(d: Donors) -> np.ndarray:
    """Donors and, last, the treated path by pre date, with the mean of the post dates as last column."""
    y = np.column_stack([d.donors, d.treated]).T
    return np.column_stack([y[:, ~d.post], y[:, d.post].mean(1)])


def synthetic_did(panel: GeoPanel, design: Design, metric: Metric, confidence: float = 0.95) -> Estimate:
    """Unit and time weights by Frank-Wolfe, fitted, sparsified and refitted; the effect is per post date."""
    d = donor_matrix(panel, design, metric)
    pre = ~d.post
    n0, t0 = d.donors.shape[1], int(pre.sum())
    n1, t1 = len(design.treatment), int(d.post.sum())
    if n0 < 2 or t0 < 3:
        raise EstimationError("two donors and three pre-period dates are needed at least.")
    y = collapsed(d)
    y0 = y[:-1, :-1]  # donors x pre dates
    noise = float(np.diff(y0, axis=1).std(ddof=1))
    least = 1e-5 * noise
    eta, warnings = eta_of_times(n0, t0)

    def weights(a: np.ndarray, b: np.ndarray, zeta: float) -> np.ndarray:
        a, b = a - a.mean(0), b - b.mean()
        w = _frank_wolfe(a, b, zeta, np.full(a.shape[1], 1 / a.shape[1]), 100, least)
        return _frank_wolfe(a, b, zeta, sparsified(w), 10_000, least)

    omega = weights(y0.T, y[-1, :-1], (n1 * t1) ** 0.25 * noise)
    lam = weights(y0, y[:-1, -1], eta * noise)
    shift = lam @ (d.treated[pre] - d.donors[pre] @ omega)
    path = d.donors @ omega + shift
    gaps = d.treated - path
    effect = float(gaps[d.post].mean())
    out = inference.conformal_inversion(gaps[d.post], gaps[pre], confidence)
    interval = tuple(x / t1 for x in out.interval) if out.interval else None
    return Estimate("synthetic_did", metric.name, effect, interval, out.p_value, diagnostics={"omega": dict(zip(d.names, omega.tolist(), strict=True)), "lambda": lam.tolist(), "noise": noise}, artifacts={"counterfactual": path.tolist(), "gaps": gaps.tolist()}, warnings=warnings).with_lift(float(d.treated[d.post].mean()))


def two_way_effects(m: np.ndarray) -> np.ndarray:
    """Row mean plus column mean less the mean of all."""
    return m.mean(1, keepdims=True) + m.mean(0, keepdims=True) - m.mean()


def initial_fill(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Cells that aren't seen at their row's plus their column's less the overall mean of seen cells; rows or columns
    without any count as average."""
    base, fill = values[seen].mean(), np.where(seen, values, 0.0)
    rows, cols = (np.where(seen.any(k), fill.sum(k) / np.maximum(seen.sum(k), 1), base) for k in (1, 0))
    return np.where(seen, values, rows[:, None] + cols[None, :] - base)


def additive_fit(values: np.ndarray, seen: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Row plus column effects that fit the seen cells best, by alternating means; nothing is known of a row or column
    without any."""
    v, n_row, n_col = np.where(seen, values, 0.0), np.maximum(seen.sum(1), 1), np.maximum(seen.sum(0), 1)
    rows, cols = np.zeros(len(values)), np.zeros(values.shape[1])
    for _ in range(rounds):
        before = rows
        cols = (v.sum(0) - seen.T @ rows) / n_col
        rows = (v.sum(1) - seen @ cols) / n_row
        if np.abs(rows - before).max() <= 1e-12 * max(1.0, np.abs(rows).max()):
            break
    return rows[:, None] + cols[None, :]


def held_out_error(values: np.ndarray, train: np.ndarray, held: np.ndarray, shrink: float, rank: int) -> float:
    return float(((soft_impute(values, train, shrink, rank) - values)[tuple(held.T)] ** 2).mean())


def select_penalty(values: np.ndarray, train: np.ndarray, held: np.ndarray, rank: int, steps: int = 12) -> float:
    """Penalty of least error on the held-out cells, of a falling geometric grid."""
    top = float(np.linalg.svd(np.where(train, values - values[train].mean(), 0), compute_uv=False)[0])
    return float(min(np.geomspace(top, top * 1e-3, steps), key=lambda p: held_out_error(values, train, held, p, rank)))


def select_rank(values: np.ndarray, train: np.ndarray, held: np.ndarray, most: int) -> int:
    return min(range(1, most + 1), key=lambda k: held_out_error(values, train, held, 0.0, k))


def block_mask_errors(values: np.ndarray, seen: np.ndarray, rows: np.ndarray, post: np.ndarray, fit: Callable[[np.ndarray], np.ndarray]) -> list[float]:
    """Summed errors of each of ``rows`` when its post cells are hidden and completed."""
    out = []
    for i in rows:
        mask = seen.copy()
        mask[i, post] = False
        out.append(float((values - fit(mask))[i, post].sum()))
    return out


def soft_impute(values: np.ndarray, seen: np.ndarray, shrink: float, rank: int, fixed_effects: bool = True, rounds: int = 500, tolerance: float = 1e-5) -> np.ndarray:
    """Low-rank completion with unpenalised row and column effects (shrinking) or of fixed rank (without shrinking)."""
    # a fixed rank keeps whatever block it starts from, so it starts from the best additive fit
    now = initial_fill(values, seen) if shrink else np.where(seen, values, additive_fit(values, seen))
    for _ in range(rounds):
        effects = two_way_effects(now) if fixed_effects else 0.0
        u, s, vt = np.linalg.svd(now - effects, full_matrices=False)
        s = np.maximum(s - shrink, 0) if shrink else s
        s[rank:] = 0
        made = effects + (u * s) @ vt
        new = np.where(seen, values, made)
        if np.linalg.norm(new - now) <= tolerance * max(np.linalg.norm(now), 1e-12):
            now = new
            break
        now = new
    return made


def matrix_completion(panel: GeoPanel, design: Design, metric: Metric, hard_rank: bool = False, most_rank: int = 6, confidence: float = 0.95, seed: int = 0) -> Estimate:
    """Treated post cells are completed from the rest; penalty or rank by error on held-out pre cells; a total effect."""
    _, times, m, is_t, post = wide_matrix(prepared(panel, design, metric), "sum")
    post = np.array(post)
    target = is_t[:, None] & post[None, :]
    seen = ~np.isnan(m) & ~target
    if np.isnan(m[target]).any() or not seen[is_t].any():
        raise EstimationError("treated markets lack dates.")
    m0 = np.where(np.isnan(m), 0.0, m)
    rank = max(1, min(most_rank, min(m.shape) - 1))
    rng = np.random.default_rng(seed)
    pre_cells = np.argwhere(seen & ~post[None, :])
    held = pre_cells[rng.choice(len(pre_cells), max(1, len(pre_cells) // 10), replace=False)]
    train = seen.copy()
    train[tuple(held.T)] = False
    if hard_rank:
        best = select_rank(m0, train, held, rank)
        fit = lambda mask: soft_impute(m0, mask, 0.0, best)
        chosen = {"rank": best}
    else:
        penalty = select_penalty(m0, train, held, rank)
        fit = lambda mask: soft_impute(m0, mask, penalty, rank)
        chosen = {"penalty": penalty}
    made = fit(seen)
    gaps = (m0 - made)[is_t].sum(0)
    effect = float(gaps[post].sum())
    out = inference.conformal_inversion(gaps[post], gaps[~post], confidence)
    interval, p = out.interval, out.p_value
    if interval is None:
        null = [x * is_t.sum() for x in block_mask_errors(m0, seen, np.flatnonzero(~is_t), post, fit)]
        fallback = inference.empirical_interval(effect, null, confidence)
        interval, p = fallback.interval, fallback.p_value
    name = "generalized_synthetic_control" if hard_rank else "matrix_completion"
    return Estimate(name, metric.name, effect, interval, p, diagnostics=chosen, artifacts={"gaps": gaps.tolist()}).with_lift(float(m0[target].sum()))


def generalized_synthetic_control(panel: GeoPanel, design: Design, metric: Metric, **how: Any) -> Estimate:
    return matrix_completion(panel, design, metric, hard_rank=True, **how)


# ---- pairs ---------------------------------------------------------------------------------------------------


def spend_effects(panel: GeoPanel, design: Design, response: str, spend: str) -> DataFrame:
    """``geo, treated, pre_response, response, spend``: post totals less pre totals scaled to the post's length."""
    from terralift.functions.metrics import ContinuousMetric

    df = prepared(panel, design, ContinuousMetric(response, column=response), extra=[spend], linearize=False)
    n = df.agg(F.count_distinct(F.when(F.col("post") == 0, F.col("time"))).alias("np"), F.count_distinct(F.when(F.col("post") == 1, F.col("time"))).alias("nq"))
    total = lambda c, p: F.coalesce(F.sum(F.when(F.col("post") == p, F.col(c).cast("double"))), F.lit(0.0))
    g = df.groupBy("geo", "treated").agg(*[total(c, p).alias(f"{c}_{p}") for c in (response, spend) for p in (0, 1)])
    scaled = lambda c: F.col(f"{c}_1") - F.col(f"{c}_0") / F.col("np") * F.col("nq")
    return g.crossJoin(F.broadcast(n)).select("geo", "treated", F.col(f"{response}_0").alias("pre_response"), scaled(response).alias("response"), scaled(spend).alias("spend"))


def paired_iroas(panel: GeoPanel, design: Design, response: str, spend: str, pairs: list[tuple[str, str]] | None = None, trim: float = 0.0, draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> Estimate:
    """Response effect over spend effect across matched pairs, trimmed by influence; bootstrap and Fieller intervals."""
    g = {r["geo"]: r for r in spend_effects(panel, design, response, spend).collect()}
    pairs = pairs or design.metadata.get("pairs") or nearest_pairs({k: r["pre_response"] for k, r in g.items()}, design)
    rows = [(t, c, g[t]["response"] - g[c]["response"], g[t]["spend"] - g[c]["spend"]) for t, c in pairs if t in g and c in g]
    if len(rows) < 2:
        raise EstimationError("two pairs are needed at least.")
    kept = trimmed(rows, trim)
    total = lambda x: (sum(r[2] for r in x), sum(r[3] for r in x))
    up, down = total(kept)
    if abs(down) < 1e-9:
        raise EstimationError("the spend effect is nothing.")
    estimate = up / down

    def of(x: list[Any]) -> float:
        a, b = total(x)
        if abs(b) < 1e-9 * max(1.0, abs(down)):
            raise EstimationError("no spend in a draw")
        return a / b

    boot = inference.bootstrap(kept, of, draws=draws, seed=seed, confidence=confidence)
    m = np.array([[r[2], r[3]] for r in kept])
    cov = np.cov(m.T, ddof=1) * len(kept)
    kind, sets = inference.fieller(up, down, cov[0, 0], cov[1, 1], cov[0, 1], confidence, len(kept) - 1)
    risk = denominator_risk(down, cov[1, 1], kind)
    sensitivity = trim_sensitivity(rows, of)
    return Estimate("paired_iroas", response, estimate, boot.interval, boot.p_value, boot.standard_error, diagnostics={"fieller": (kind, sets), "denominator_risk": risk, "sign_test": binomial_two_sided(sum(r[2] > 0 for r in kept), len(kept)), "trim": sensitivity, "pairs": [r[:2] for r in kept]})


def denominator_risk(spend: float, variance: float, kind: str = "bounded") -> str:
    """high, medium or low: how near the spend effect is to nothing, by its deviations."""
    snr = abs(spend) / math.sqrt(max(variance, 1e-300))
    return "high" if kind != "bounded" or snr < 2 else "medium" if snr < 4 else "low"


def trim_sensitivity(rows: list[tuple], ratio_of: Callable[[list[tuple]], float], grid: tuple[float, ...] = (0.0, 0.1, 0.2)) -> dict[float, float]:
    """The ratio at each trimmed share that leaves two pairs."""
    return {f: ratio_of(kept) for f in grid if len(kept := trimmed(rows, f)) >= 2}


def nearest_pairs(size: dict[str, float], design: Design) -> list[tuple[str, str]]:
    """Greedy: each treated market, in order, takes the nearest control that is left."""
    left, out = [c for c in design.control if c in size], []
    for t in design.treatment:
        if t in size and left:
            c = min(left, key=lambda k: (abs(size[k] - size[t]), k))
            left.remove(c)
            out.append((t, c))
    return out


def trimmed(rows: list[tuple], share: float) -> list[tuple]:
    """Without the floor(n share) pairs of greatest influence, by distance from the median ratio line in MAD units."""
    k = int(math.floor(len(rows) * share))
    if not k:
        return rows
    down = sum(r[3] for r in rows)
    slope = sum(r[2] for r in rows) / down if abs(down) > 1e-9 else 0.0
    e = [r[2] - slope * r[3] for r in rows]
    middle = float(np.median(e))
    mad = float(np.median([abs(x - middle) for x in e])) or 1.0
    order = sorted(range(len(rows)), key=lambda i: (-abs(e[i] - middle) / mad, i))
    drop = set(order[:k])
    return [r for i, r in enumerate(rows) if i not in drop]


# ---- suites --------------------------------------------------------------------------------------------------

ESTIMATORS: dict[str, Callable[..., Estimate]] = {
    "did": did, "ratio_delta": ratio_delta, "block_bootstrap": block_bootstrap, "cuped": cuped, "synthetic_control": synthetic_control, "synthetic_did": synthetic_did,
    "augmented_synthetic_control": augmented_synthetic_control, "matrix_completion": matrix_completion, "generalized_synthetic_control": generalized_synthetic_control,
    "tbr": tbr, "forecast": forecast, "state_space": state_space,
}
ALIASES = {"difference_in_differences": "did", "sdid": "synthetic_did", "scm": "synthetic_control", "ascm": "augmented_synthetic_control", "mc": "matrix_completion", "gsc": "generalized_synthetic_control", "time_based_regression": "tbr", "bayesian_time_series": "state_space", "bsts": "state_space", "bootstrap": "block_bootstrap"}
DEFAULT_SUITE = ("did", "ratio_delta", "block_bootstrap", "cuped", "synthetic_control", "synthetic_did", "tbr")


def default_estimators(bayesian: bool = False) -> list[str]:
    return [*DEFAULT_SUITE, *(["state_space"] if bayesian else [])]


def estimator_names() -> list[str]:
    """All names that ``estimator`` takes."""
    return sorted({*ESTIMATORS, *ALIASES})


def estimator(name: str) -> Callable[..., Estimate]:
    key = ALIASES.get(name, name)
    if key not in ESTIMATORS:
        raise ValidationError(f"unknown estimator {name!r}.", f"Use one of {sorted(ESTIMATORS)}.")
    return ESTIMATORS[key]


def fit_all(panel: GeoPanel, design: Design, metrics: list[Metric], names: list[str] | None = None, params: dict[str, dict[str, Any]] | None = None) -> list[Estimate]:
    """Every estimator on every metric; an estimator that fails is a row with its error."""
    out = []
    for m in metrics:
        for n in names or DEFAULT_SUITE:
            try:
                out.append(estimator(n)(panel, design, m, **(params or {}).get(n, {})))
            except (EstimationError, np.linalg.LinAlgError) as e:
                out.append(Estimate(n, m.name, math.nan, error=str(e)))
    return out


def consensus(results: list[Estimate]) -> dict[str, Any]:
    """Median lift by family of models, then across families; nothing to say where directions disagree."""
    family = {"did": "difference", "ratio_delta": "difference", "block_bootstrap": "difference", "cuped": "regression", "tbr": "regression", "forecast": "forecast", "state_space": "forecast"}
    by: dict[str, list[float]] = {}
    for r in results:
        if r.error is None and r.relative_lift is not None and math.isfinite(r.relative_lift):
            by.setdefault(family.get(r.estimator, "synthetic"), []).append(r.relative_lift)
    medians = {k: float(np.median(v)) for k, v in by.items()}
    values = list(medians.values())
    if not values:
        return {"families": {}, "median": None, "agree": None}
    agree = len({v > 0 for v in values}) == 1
    return {"families": medians, "median": float(np.median(values)) if agree else None, "mean": float(np.mean(values)), "min": min(values), "max": max(values), "agree": agree}


def z_value(confidence: float) -> float:
    return NORMAL.inv_cdf((1 + confidence) / 2)
