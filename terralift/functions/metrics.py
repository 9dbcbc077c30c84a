"""Metrics as emitters of Column expressions, so that every metric is part of one plan."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralift.errors import ValidationError
from terralift.functions.stats import t_ppf, t_sf


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is null where the denominator is null or zero."""
    return F.when(denominator != 0, numerator / denominator)


@dataclass(frozen=True)
class Metric:
    """What all metrics have: a name, the direction that is good, and a role."""

    name: str
    direction: str = "increase"
    role: str = "primary"

    @property
    def columns(self) -> list[str]:
        raise NotImplementedError

    def row(self) -> Column:
        """The metric of one row."""
        raise NotImplementedError

    def aggregate(self) -> Column:
        """The metric of a group."""
        raise NotImplementedError

    def planning_score(self) -> Column:
        """The aggregate with its sign turned where a decrease is good."""
        return -self.aggregate() if self.direction == "decrease" else self.aggregate()

    def aggregate_by(self, df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(self.aggregate().alias(self.name))

    def lifted(self, lift: float, where: Column, relative: bool = True) -> dict[str, Column]:
        """Columns with a lift put in on the rows ``where``."""
        one = lambda c: F.col(c) * (1 + lift) if relative else F.col(c) + lift
        return {c: F.when(where, one(c)).otherwise(F.col(c)) for c in self.columns}

    def inject_lift(self, df: DataFrame, lift: float, where: Column, relative: bool = True) -> DataFrame:
        return df.withColumns(self.lifted(lift, where, relative))

    def to_dict(self) -> dict[str, Any]:
        return {"type": KIND_OF[type(self)], **self.__dict__}


@dataclass(frozen=True)
class CountMetric(Metric):
    column: str = ""
    non_negative: bool = True

    @property
    def columns(self) -> list[str]:
        return [self.column or self.name]

    def row(self) -> Column:
        value = F.col(self.columns[0]).try_cast("double")
        if self.non_negative:
            return F.when(value < 0, F.raise_error(F.lit(f"metric {self.name} has negative values")).cast("double")).otherwise(value)
        return value

    def aggregate(self) -> Column:
        return F.coalesce(F.sum(self.row()), F.lit(0.0))


@dataclass(frozen=True)
class ContinuousMetric(Metric):
    column: str = ""
    agg: str = "sum"

    @property
    def columns(self) -> list[str]:
        return [self.column or self.name]

    def row(self) -> Column:
        return F.col(self.columns[0]).try_cast("double")

    def aggregate(self) -> Column:
        return F.avg(self.row()) if self.agg == "mean" else F.coalesce(F.sum(self.row()), F.lit(0.0))


@dataclass(frozen=True)
class CompositeMetric(Metric):
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.weights)

    def row(self) -> Column:
        return reduce(lambda a, b: a + b, [F.col(c).try_cast("double") * w for c, w in self.weights.items()])

    def aggregate(self) -> Column:
        return F.coalesce(F.sum(self.row()), F.lit(0.0))


@dataclass(frozen=True)
class RatioMetric(Metric):
    """Ratio of sums; rows without a positive denominator are null, or an error."""

    numerator: str = ""
    denominator: str = ""
    denominator_min: float = 0.0
    zero_denominator: str = "null"

    @property
    def columns(self) -> list[str]:
        return [self.numerator, self.denominator]

    def row(self) -> Column:
        n, d = (F.col(c).try_cast("double") for c in self.columns)
        bad = F.raise_error(F.lit(f"metric {self.name} has rows without a positive denominator")).cast("double") if self.zero_denominator == "raise" else F.lit(None).cast("double")
        return F.when(d > 0, n / d).otherwise(bad)

    def aggregate(self) -> Column:
        n, d = (F.sum(F.col(c).try_cast("double")) for c in self.columns)
        return F.when((d > 0) & (d >= self.denominator_min), n / d)

    def lifted(self, lift: float, where: Column, relative: bool = True, affect_denominator: bool = False) -> dict[str, Column]:
        n, d = F.col(self.numerator), F.col(self.denominator)
        out = {self.numerator: F.when(where, n * (1 + lift) if relative else n + lift * d).otherwise(n)}
        if affect_denominator and relative:
            out[self.numerator] = F.when(where, n * (1 + lift) * (1 + lift)).otherwise(n)
            out[self.denominator] = F.when(where, d * (1 + lift)).otherwise(d)
        return out

    def linearized(self, level: Column) -> Column:
        """Numerator less ``level`` times the denominator."""
        return F.col(self.numerator).cast("double") - level * F.col(self.denominator).cast("double")


METRIC_KINDS: dict[str, type[Metric]] = {"count": CountMetric, "continuous": ContinuousMetric, "composite": CompositeMetric, "ratio": RatioMetric}
KIND_OF = {v: k for k, v in METRIC_KINDS.items()}


def metric_from_dict(payload: dict[str, Any]) -> Metric:
    rest = dict(payload)
    kind = rest.pop("type", "count")
    if kind not in METRIC_KINDS:
        raise ValidationError(f"unknown metric type {kind!r}.", f"Use one of {sorted(METRIC_KINDS)}.")
    return METRIC_KINDS[kind](**rest)


@dataclass(frozen=True)
class MetricInfo:
    """A metric's name, kind and columns, whatever it was given as."""

    name: str
    kind: str
    column: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    direction: str = "increase"


def metric_info(metric: Metric | dict[str, Any] | str) -> MetricInfo:
    """From a metric, its configuration or a column's name; with a numerator and a denominator it is a ratio."""
    if isinstance(metric, str):
        return MetricInfo(metric, "count", metric)
    if isinstance(metric, dict):
        metric = metric_from_dict({"name": metric.get("name") or metric.get("column"), **metric})
    if isinstance(metric, RatioMetric):
        return MetricInfo(metric.name, "ratio", None, metric.numerator, metric.denominator, metric.direction)
    return MetricInfo(metric.name, KIND_OF.get(type(metric), "custom"), metric.columns[0] if len(metric.columns) == 1 else None, direction=metric.direction)


class MetricCatalog:
    """Named metrics in order."""

    def __init__(self, metrics: Iterable[Metric] = ()) -> None:
        self.metrics: dict[str, Metric] = {}
        for m in metrics:
            self.register(m)

    def register(self, metric: Metric, replace: bool = False) -> None:
        if metric.name in self.metrics and not replace:
            raise ValidationError(f"metric {metric.name!r} exists.", "Pass replace=True to replace it.")
        self.metrics[metric.name] = metric

    def required_columns(self, names: Iterable[str] | None = None) -> list[str]:
        return list(dict.fromkeys(c for n in (names or self.metrics) for c in self.metrics[n].columns))

    def select(self, names: Iterable[str]) -> MetricCatalog:
        """Some of the metrics, in the given order."""
        names = list(names)
        if unknown := [n for n in names if n not in self.metrics]:
            raise ValidationError(f"unknown metrics {unknown}.", f"Use some of {list(self.metrics)}.")
        return MetricCatalog(self.metrics[n] for n in names)

    def fetch(self, source: Any, names: Iterable[str] | None = None, **limits: Any) -> Any:
        """From a source, only the columns that the metrics need."""
        return source.fetch(metrics=self.required_columns(names), **limits)

    @classmethod
    def from_configs(cls, configs: dict[str, dict[str, Any]]) -> MetricCatalog:
        return cls(metric_from_dict({"name": n, **c}) for n, c in configs.items())

    def to_file(self, path: str) -> None:
        payload = [m.to_dict() for m in self.metrics.values()]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        if path.endswith((".yml", ".yaml")):
            import yaml

            Path(path).write_text(yaml.safe_dump(payload, sort_keys=False))
        else:
            Path(path).write_text(json.dumps(payload, indent=2))

    @classmethod
    def from_file(cls, path: str) -> MetricCatalog:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return cls(map(metric_from_dict, yaml.safe_load(Path(path).read_text())))
        return cls(map(metric_from_dict, json.loads(Path(path).read_text())))


def ratio_moments(df: DataFrame, metric: RatioMetric, by: list[str], cluster: str | None = None) -> DataFrame:
    """``*by, ratio, variance, n``: a ratio of sums and its delta-method variance, by cluster where one is named."""
    n, d = (F.col(c).cast("double") for c in metric.columns)
    unit = df.groupBy(*by, cluster).agg(F.sum(n).alias("n"), F.sum(d).alias("d")) if cluster else df.select(*by, n.alias("n"), d.alias("d"))
    # the variance of residuals n - R d from moments, so that one aggregate will do
    m = unit.groupBy(*by).agg(
        F.sum("n").alias("sn"), F.sum("d").alias("sd"), F.avg("d").alias("md"), F.count(F.lit(1)).cast("double").alias("k"),
        F.var_samp("n").alias("vn"), F.var_samp("d").alias("vd"), F.covar_samp("n", "d").alias("c"),
    ).withColumn("ratio", ratio(F.col("sn"), F.col("sd")))
    spread = F.col("vn") - 2 * F.col("ratio") * F.col("c") + F.col("ratio") * F.col("ratio") * F.col("vd")
    return m.select(*by, "ratio", F.greatest(spread, F.lit(0.0)).alias("spread"), "md", F.col("k").alias("n")).select(*by, "ratio", ratio(F.col("spread"), F.col("n") * F.col("md") * F.col("md")).alias("variance"), F.col("n").cast("long").alias("n"))


def delta_method_difference(df: DataFrame, metric: RatioMetric, arm: str, treatment: Any, control: Any, alpha: float = 0.05, cluster: str | None = None) -> dict[str, Any]:
    """Difference of two arms' ratios with Welch interval and p."""
    if cluster is not None and cluster not in df.columns:
        raise ValidationError(f"cluster column {cluster!r} is missing.", f"Columns are {df.columns}.")
    rows = {r[arm]: r for r in ratio_moments(df.where(F.col(arm).isin([treatment, control])), metric, [arm], cluster).collect()}
    t, c = rows[treatment], rows[control]
    for side in (t, c):
        if side["ratio"] is None:
            raise ValidationError(f"metric {metric.name} has no positive denominator in an arm.", "Check the arms and the period.")
    diff, v_t, v_c = t["ratio"] - c["ratio"], t["variance"] or 0.0, c["variance"] or 0.0
    se = math.sqrt(v_t + v_c)
    df_ = (v_t + v_c) ** 2 / (sum(v * v / (n - 1) for v, n in ((v_t, t["n"]), (v_c, c["n"])) if n > 1 and v) or math.nan) if se else math.nan
    half = t_ppf(1 - alpha / 2, df_) * se if se and df_ == df_ else None
    return {
        "estimate": diff, "treatment": t["ratio"], "control": c["ratio"], "standard_error": se, "df": df_,
        "interval": None if half is None else (diff - half, diff + half),
        "p_value": None if half is None else 2 * t_sf(abs(diff) / se, df_),
        "relative_lift": diff / abs(c["ratio"]) if abs(c["ratio"]) > 1e-12 else None,
    }
