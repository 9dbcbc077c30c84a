"""Minimum detectable effects, detection curves, placebo tests and injected lifts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralift.errors import EstimationError, MDEComputationError
from terralift.functions.metrics import Metric, RatioMetric
from terralift.functions.stats import clopper_pearson, t_ppf, two_sided_ncp
from terralift.operators.design import Design
from terralift.operators.estimators import Estimate, estimator
from terralift.operators.panel import GeoPanel


def count_mde(treatment: list[float], control: list[float], test_days: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """Relative effect that a t test on daily differences finds with the given power."""
    d = np.asarray(treatment, float) - np.asarray(control, float)
    base = float(np.mean(treatment))
    if len(d) < 3 or base <= 0:
        raise MDEComputationError("three days and a positive treatment mean are needed.")
    return two_sided_ncp(alpha, power, len(d) - 1) * float(d.std(ddof=1)) / math.sqrt(test_days) / base


def ratio_mde(moments: DataFrame, arm: str, test_days: int, pre_days: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """From ``arm, ratio, variance, n`` with arms treatment and control: delta-method error scaled to the test's length."""
    r = {x[arm]: x for x in moments.collect()}
    t, c = r["treatment"], r["control"]
    se = math.sqrt((t["variance"] or 0) + (c["variance"] or 0)) * math.sqrt(pre_days / test_days)
    if not c["ratio"]:
        raise MDEComputationError("the control ratio is nothing.")
    return two_sided_ncp(alpha, power, max(1, t["n"] + c["n"] - 2)) * se / abs(c["ratio"])


def daily_arms(panel: GeoPanel, metric: Metric, treatment: list[str], control: list[str]) -> DataFrame:
    """``time, treatment, control``: the arms' metric by date."""
    v = lambda geos: F.sum(F.when(F.col(panel.geo).isin(geos), metric.row())) if not isinstance(metric, RatioMetric) else None
    if isinstance(metric, RatioMetric):
        from terralift.functions.metrics import ratio

        v = lambda geos: ratio(*[F.sum(F.when(F.col(panel.geo).isin(geos), F.col(c).cast("double"))) for c in metric.columns])
    return panel.df.groupBy(F.col(panel.time).alias("time")).agg(v(treatment).alias("treatment"), v(control).alias("control"))


def placebo_windows(times: DataFrame, days: int, most: int | None = None) -> DataFrame:
    """``start, end`` of windows whose both ends are dates of the panel; the last ``most``."""
    t = times.select(F.to_date("time").alias("start")).distinct()
    ends = t.select(F.col("start").alias("end"))
    w = t.withColumn("end", F.date_add("start", days - 1)).join(ends, "end", "left_semi")
    return w.orderBy(F.desc("start")).limit(most) if most else w


def detection_curve(panel: GeoPanel, metric: Metric, treatment: list[str], control: list[str], days: int, lifts: list[float], alpha: float = 0.05, most: int = 20) -> DataFrame:
    """``lift, windows, power``: share of past windows in which the lift would stand out of the daily differences."""
    series = daily_arms(panel, metric, treatment, control).where("treatment is not null and control is not null").withColumn("day", F.to_date("time"))
    windows = placebo_windows(series, days, most)
    inside = windows.join(series, F.col("day").between(F.col("start"), F.col("end")))  # range join of few windows
    w = inside.groupBy("start").agg(F.greatest(F.avg("treatment"), F.lit(1.0)).alias("base"), F.stddev_samp(F.col("treatment") - F.col("control")).alias("sd"), F.count(F.lit(1)).alias("n")).where("n > 1 and sd > 0")
    grid = panel.df.sparkSession.createDataFrame([(float(x),) for x in lifts], "lift double")
    critical = {n: t_ppf(1 - alpha / 2, n - 1) for n in range(2, days + 1)}
    crit = F.element_at(F.create_map(*[x for n, v in critical.items() for x in (F.lit(n), F.lit(v))]), F.col("n").cast("int"))
    found = F.abs(F.col("base") * F.col("lift")) / (F.col("sd") / F.sqrt("n")) > crit
    return w.crossJoin(F.broadcast(grid)).groupBy("lift").agg(F.count(F.lit(1)).alias("windows"), F.avg(found.cast("double")).alias("power")).orderBy("lift")


def mde_from_curve(points: list[tuple[float, float]], target: float = 0.8) -> float:
    """The first lift that reaches the power, else the largest."""
    points = sorted(points)
    return next((lift for lift, power in points if power >= target), points[-1][0])


def power_curve(points: list[tuple[float, float]] | dict[float, float]) -> list[dict[str, float]]:
    """Points (lift, power) as rows in order of the lift."""
    pairs = points.items() if isinstance(points, dict) else points
    return [{"lift": float(x), "power": float(p)} for x, p in sorted(pairs)]


Fit = Callable[[GeoPanel, Design, Metric], Estimate]


def moved(design: Design, start: Any, days: int, pre_days: int) -> Design:
    return replace(design, start=start, end=start + timedelta(days=days - 1), pre_start=start - timedelta(days=pre_days), pre_end=start - timedelta(days=1))


def replay_power(panel: GeoPanel, design: Design, metric: Metric, name: str, days: int, lifts: list[float], alpha: float = 0.05, windows: int = 8, pre_days: int = 60, target: float = 0.8) -> dict[str, Any]:
    """An estimator on past windows with lifts put in; a window that fails at one lift is dropped wholly."""
    fit, found = estimator(name), {x: [] for x in lifts}
    history = panel.slice(end=design.start - timedelta(days=1))
    starts = [r["start"] for r in placebo_windows(history.df.select(F.col(panel.time).alias("time")), days, windows).collect()]
    dropped = 0
    for s in starts:
        d = moved(design, s, days, pre_days)
        where = F.col(panel.geo).isin(list(design.treatment)) & F.to_date(F.col(panel.time)).between(F.lit(d.start), F.lit(d.end))
        try:
            got = {x: fit(replace(history, df=metric.inject_lift(history.df, x, where)), d, metric) for x in lifts}
        except (EstimationError, np.linalg.LinAlgError):
            dropped += 1
            continue
        for x, e in got.items():
            found[x].append(e.p_value is not None and e.p_value < alpha)
    curve = [(x, float(np.mean(v)) if v else 0.0) for x, v in found.items()]
    return {"curve": curve, "windows": len(starts) - dropped, "dropped": dropped, "mde": mde_from_curve(curve, target)}


def calibration_status(false_positives: int, trials: int, covered: int, alpha: float, errors: int) -> str:
    """pass, warning or fail, by exact binomial intervals."""
    if not trials or errors > trials:
        return "fail"
    low, _ = clopper_pearson(false_positives, trials)
    _, high = clopper_pearson(covered, trials)
    if low > alpha or high < 1 - alpha:
        return "fail"
    return "warning" if false_positives / trials > 1.5 * alpha or trials < 10 or errors else "pass"


def _summary(estimates: list[Estimate], errors: int, alpha: float) -> dict[str, Any]:
    e = np.array([x.estimate for x in estimates])
    hits = sum(x.p_value is not None and x.p_value < alpha for x in estimates)
    covered = sum(x.interval is not None and x.interval[0] <= 0 <= x.interval[1] for x in estimates)
    n = len(estimates)
    return {"n": n, "errors": errors, "false_positive_rate": hits / n if n else None, "coverage": covered / n if n else None, "bias": float(e.mean()) if n else None, "rmse": float(np.sqrt((e**2).mean())) if n else None, "status": calibration_status(hits, n, covered, alpha, errors)}


def placebo_in_time(panel: GeoPanel, design: Design, metric: Metric, name: str, windows: int = 20, alpha: float = 0.05, pre_days: int = 60) -> dict[str, Any]:
    """The estimator on the last windows before the test, where the effect is nothing."""
    days = (design.end - design.start).days + 1
    history = panel.slice(end=design.start - timedelta(days=1))
    out, errors = [], 0
    for r in placebo_windows(history.df.select(F.col(panel.time).alias("time")), days, windows).collect():
        try:
            out.append(estimator(name)(history, moved(design, r["start"], days, pre_days), metric))
        except (EstimationError, np.linalg.LinAlgError):
            errors += 1
    return _summary(out, errors, alpha)


#: Estimators that placebos in space make no sense for.
NO_SPACE = frozenset({"paired_iroas"})


def placebo_applies(name: str, where: str) -> bool:
    """Whether placebos in ``time`` or in ``space`` say anything of an estimator."""
    return where == "time" or name not in NO_SPACE


def not_applicable(name: str, metric: str, where: str, reason: str = "its pairs leave no market to play the treated one") -> dict[str, Any]:
    """A row that says why a check was left out."""
    return {"estimator": name, "metric": metric, "method": f"placebo_in_{where}", "n": 0, "errors": 0, "status": "not_applicable", "reason": reason}


def placebo_in_space(panel: GeoPanel, design: Design, metric: Metric, name: str, alpha: float = 0.05) -> dict[str, Any]:
    """Each control plays the treated market; the treated ones stay out."""
    if not placebo_applies(name, "space"):
        return not_applicable(name, metric.name, "space")
    out, errors = [], 0
    for g in design.control:
        rest = tuple(c for c in design.control if c != g)
        try:
            out.append(estimator(name)(panel, replace(design, treatment=(g,), control=rest), metric))
        except (EstimationError, np.linalg.LinAlgError):
            errors += 1
    return _summary(out, errors, alpha)


def injected_recovery(panel: GeoPanel, design: Design, metric: Metric, name: str, lifts: list[float]) -> dict[str, Any]:
    """What the estimator finds of lifts put into the treated post cells, over what it finds without."""
    where = F.col(panel.geo).isin(list(design.treatment)) & F.to_date(F.col(panel.time)).between(F.lit(design.start), F.lit(design.end))
    base = estimator(name)(panel, design, metric)
    rows = []
    for x in lifts:
        e = estimator(name)(replace(panel, df=metric.inject_lift(panel.df, x, where)), design, metric)
        rows.append({"lift": x, "recovered": None if e.relative_lift is None or base.relative_lift is None else (1 + e.relative_lift) / (1 + base.relative_lift) - 1, "estimate": e.estimate})
    bias = [r["recovered"] - r["lift"] for r in rows if r["recovered"] is not None]
    values = [r["estimate"] for r in rows]
    return {"rows": rows, "median_bias": float(np.median(bias)) if bias else None, "rmse": float(np.sqrt(np.mean(np.square(bias)))) if bias else None, "monotone": all(a <= b for a, b in zip(values, values[1:], strict=False))}


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``*keys, monotone``: whether values never fall."""
    following = F.lead(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("ok", following.isNull() | (following >= F.col(value))).groupBy(*keys).agg(F.bool_and("ok").alias("monotone"))
