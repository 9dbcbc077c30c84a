"""A completed test's design, and panels prepared for estimators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralift.errors import EstimationError, ValidationError
from terralift.functions.metrics import Metric, RatioMetric, ratio
from terralift.operators.panel import GeoPanel
from terralift.operators.validation import as_day


@dataclass(frozen=True)
class Design:
    """Arms (deduplicated, disjoint), test dates and the window before the test."""

    experiment_id: str
    treatment: tuple[str, ...]
    control: tuple[str, ...]
    start: date
    end: date
    pre_start: date | None = None
    pre_end: date | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, experiment_id: str, treatment: list[Any], control: list[Any], start: Any, end: Any, pre_start: Any = None, pre_end: Any = None, **metadata: Any) -> Design:
        t, c = (tuple(dict.fromkeys(map(str, x))) for x in (treatment, control))
        if both := sorted({*t} & {*c}):
            raise ValidationError(f"{both} are in both arms.", "Keep arms disjoint.")
        if not t or not c:
            raise ValidationError("an arm is empty.", "Name a market at least in each arm.")
        s, e = as_day(start), as_day(end)
        if e < s:
            raise ValidationError("the test ends before it starts.", "Swap the dates.")
        return cls(experiment_id, t, c, s, e, as_day(pre_start) if pre_start else None, as_day(pre_end) if pre_end else s - timedelta(days=1), metadata)

    @property
    def geos(self) -> list[str]:
        return [*self.treatment, *self.control]


def period_of(time: Column, design: Design) -> Column:
    """pre, post or null."""
    d = F.to_date(time)
    pre = (d < F.lit(design.start)) & (d <= F.lit(design.pre_end))
    if design.pre_start:
        pre = pre & (d >= F.lit(design.pre_start))
    return F.when(pre, "pre").when(d.between(F.lit(design.start), F.lit(design.end)), "post")


def prepared(panel: GeoPanel, design: Design, metric: Metric, extra: list[str] | None = None, linearize: bool = True) -> DataFrame:
    """``geo, time, period, treated, post, outcome`` of the design's markets and periods.

    A ratio's outcome is its numerator less the pre-period ratio of both arms times its denominator. The level is a
    one-row aggregate, so the join to it moves nothing.
    """
    panel.require([metric])
    df = panel.df.select(F.col(panel.geo).cast("string").alias("geo"), F.col(panel.time).alias("time"), *[F.col(c) for c in dict.fromkeys([*metric.columns, *(extra or [])])])
    df = df.where(F.col("geo").isin(design.geos)).withColumn("period", period_of(F.col("time"), design)).where("period is not null")
    df = df.withColumns({"treated": F.col("geo").isin(list(design.treatment)).cast("int"), "post": (F.col("period") == "post").cast("int")})
    if isinstance(metric, RatioMetric) and linearize:
        level = df.where("post = 0").agg(metric.aggregate().alias("level"))
        df = df.crossJoin(F.broadcast(level)).withColumn("outcome", metric.linearized(F.col("level"))).drop("level")
    else:
        df = df.withColumn("outcome", metric.row())
    return df.where(F.col("outcome").isNotNull() & ~F.isnan("outcome"))


def checked(df: DataFrame) -> DataFrame:
    """Raises unless both arms have both periods."""
    cells = {(r["treated"], r["post"]) for r in df.select("treated", "post").distinct().collect()}
    if len(cells) < 4:
        raise EstimationError(f"only {sorted(cells)} of the four (arm, period) cells have data.")
    return df


def observed_summary(panel: GeoPanel, design: Design, metric: Metric) -> DataFrame:
    """One row: the four cells' values and totals, the difference in differences, and lifts."""
    df = prepared(panel, design, metric, linearize=False)
    out = []
    for arm, t in (("treatment", 1), ("control", 0)):
        for period, p in (("pre", 0), ("post", 1)):
            here = (F.col("treated") == t) & (F.col("post") == p)
            if isinstance(metric, RatioMetric):
                n, d = (F.sum(F.when(here, F.col(c).cast("double"))) for c in metric.columns)
                out += [ratio(n, d).alias(f"{arm}_{period}"), n.alias(f"{arm}_{period}_total")]
            else:
                out += [F.avg(F.when(here, F.col("outcome"))).alias(f"{arm}_{period}"), F.sum(F.when(here, F.col("outcome"))).alias(f"{arm}_{period}_total")]
    row = df.agg(*out)
    effect = (F.col("treatment_post") - F.col("treatment_pre")) - (F.col("control_post") - F.col("control_pre"))
    row = row.withColumn("did", effect).withColumn("post_difference", F.col("treatment_post") - F.col("control_post"))
    return row.withColumn("lift_vs_pre", safe_relative(F.col("did"), F.col("treatment_pre"))).withColumn("relative_lift", counterfactual_lift(F.col("did"), F.col("treatment_post"), F.col("treatment_pre")))


def safe_relative(estimate: Column, baseline: Column) -> Column:
    return F.when(F.abs(baseline) >= 1e-12, estimate / F.abs(baseline))


def counterfactual_lift(effect: Column, treated_post: Column, treated_pre: Column | None = None) -> Column:
    """Effect against what the treated would have been without it."""
    base = treated_post - effect
    if treated_pre is not None:
        base = F.coalesce(base, treated_pre)
    return safe_relative(effect, base)


def geo_periods(df: DataFrame, agg: str = "avg") -> DataFrame:
    """``geo, treated, pre, post, delta``: one row a market; markets without both periods are left out."""
    f = {"avg": F.avg, "sum": F.sum}[agg]
    out = df.groupBy("geo", "treated").agg(f(F.when(F.col("post") == 0, F.col("outcome"))).alias("pre"), f(F.when(F.col("post") == 1, F.col("outcome"))).alias("post"), F.count(F.when(F.col("post") == 0, 1)).alias("n_pre"), F.count(F.when(F.col("post") == 1, 1)).alias("n_post"))
    return out.where("pre is not null and post is not null").withColumn("delta", F.col("post") - F.col("pre"))


def wide_matrix(df: DataFrame, agg: str = "avg") -> tuple[list[str], list[Any], Any, Any, list[bool]]:
    """(markets, times, matrix, treated flags, post flags) of a prepared frame, gathered once aggregated.

    The matrix has one number a market and time, which is what the dense estimators work on.
    """
    import numpy as np

    f = {"avg": F.avg, "sum": F.sum}[agg]
    cells = df.groupBy("geo", "treated", "time", "post").agg(f("outcome").alias("v"))
    rows = cells.groupBy("geo", "treated").agg(F.sort_array(F.collect_list(F.struct("time", "post", "v"))).alias("s")).orderBy("treated", "geo").collect()
    times = sorted({(c["time"], c["post"]) for r in rows for c in r["s"]})
    at = {t: i for i, (t, _) in enumerate(times)}
    matrix = np.full((len(rows), len(times)), np.nan)
    for i, r in enumerate(rows):
        for c in r["s"]:
            matrix[i, at[c["time"]]] = c["v"]
    return [r["geo"] for r in rows], [t for t, _ in times], matrix, np.array([bool(r["treated"]) for r in rows]), [bool(p) for _, p in times]
