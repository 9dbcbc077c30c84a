"""Long geo-by-time panels: a DataFrame with the names of its keys."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.errors import ValidationError
from terralift.functions.metrics import Metric
from terralift.operators import validation

Time = str | date | datetime


def quote_identifier(name: str) -> str:
    """A name in backticks; NUL and semicolons are refused."""
    if not name or "\0" in name or ";" in name:
        raise ValidationError(f"{name!r} can't be an identifier.", "Use a plain column or table name.")
    return "`" + name.replace("`", "``") + "`"


def quote_qualified_name(name: str) -> str:
    return ".".join(quote_identifier(p) for p in name.split("."))


def checked_filter(clause: str) -> str:
    """A guard against slips, not against malice: no statement ends, no comments, not empty."""
    if not clause.strip() or any(x in clause for x in (";", "--", "/*", "\0")):
        raise ValidationError("the filter clause is empty or holds ; -- /* or NUL.", "Pass one boolean expression.")
    return clause


class PanelSource(Protocol):
    """What can fetch a panel."""

    def fetch(self, geos: list[str] | None, start: Time | None, end: Time | None, metrics: list[str] | None, columns: list[str] | None) -> DataFrame | GeoPanel: ...


def filtered(df: DataFrame, geo: str, time: str, geos: list[str] | None = None, start: Time | None = None, end: Time | None = None, columns: list[str] | None = None) -> DataFrame:
    """Inclusive time range, set of markets (an empty set gives no rows), and columns besides the keys."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    if geos is not None:
        df = df.where(F.col(geo).isin(list(geos)) if geos else F.lit(False))
    if columns is not None:
        df = df.select(*dict.fromkeys([geo, time, *columns]))
    return df


@dataclass(frozen=True)
class GeoPanel:
    """A panel and the names of its keys; ``metadata`` are columns that describe markets."""

    df: DataFrame
    geo: str = "geo_id"
    time: str = "date"
    frequency: str | timedelta | None = None
    metadata: tuple[str, ...] = field(default=())

    @classmethod
    def from_dataframe(cls, df: Any, geo: str = "geo_id", time: str = "date", frequency: str | timedelta | None = None, market_metadata: DataFrame | None = None, validate: bool = True, complete: bool = False, spark: SparkSession | None = None) -> GeoPanel:
        """Wrap a Spark or pandas frame or a list of rows."""
        if not isinstance(df, DataFrame):
            session = spark or SparkSession.getActiveSession()
            df = session.createDataFrame(df.to_pandas() if hasattr(df, "to_pandas") else df)
        panel = cls(validation.normalize_keys(df, geo, time), geo, time, frequency)
        if validate:
            report = validation.validate_panel(panel.df, geo, time, frequency=frequency, complete=complete).raise_if_invalid()
            panel = cls(panel.df, geo, time, frequency or report.frequency)
        return panel.with_metadata(market_metadata) if market_metadata is not None else panel

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, columns: list[str] | None = None, geo: str = "geo_id", time: str = "date", **how: Any) -> GeoPanel:
        df = spark.read.parquet(path)
        return cls.from_dataframe(df.select(*dict.fromkeys([geo, time, *columns])) if columns else df, geo, time, **how)

    @classmethod
    def from_table(cls, spark: SparkSession, name: str, where: str | None = None, geo: str = "geo_id", time: str = "date", **how: Any) -> GeoPanel:
        df = spark.read.table(quote_qualified_name(name))
        return cls.from_dataframe(df.where(F.expr(checked_filter(where))) if where else df, geo, time, **how)

    @classmethod
    def from_query(cls, spark: SparkSession, query: str, params: dict[str, Any] | list[Any] | None = None, geo: str = "geo_id", time: str = "date", start: Time | None = None, end: Time | None = None, **how: Any) -> GeoPanel:
        """Caller's SQL with ``:name`` or ``?`` markers; time bounds go down to the scan."""
        df = spark.sql(query, args=params) if params else spark.sql(query)
        return cls.from_dataframe(filtered(validation.normalize_keys(df, geo, time), geo, time, start=start, end=end), geo, time, **how)

    @classmethod
    def from_callable(cls, fetcher: Callable[..., Any], geos: list[str] | None = None, start: Time | None = None, end: Time | None = None, metrics: list[str] | None = None, columns: list[str] | None = None, geo: str = "geo_id", time: str = "date", **how: Any) -> GeoPanel:
        """Calls ``fetcher`` with those of the arguments that it takes."""
        given = {"geos": geos, "start": start, "end": end, "metrics": metrics, "columns": columns}
        takes = inspect.signature(fetcher).parameters
        anything = any(p.kind == p.VAR_KEYWORD for p in takes.values())
        got = fetcher(**{k: v for k, v in given.items() if anything or k in takes})
        if isinstance(got, GeoPanel):
            return got.slice(start, end, geos)
        panel = cls.from_dataframe(got, geo, time, **how)
        return panel.slice(start, end, geos)

    @classmethod
    def from_adapter(cls, source: PanelSource, geos: list[str] | None = None, start: Time | None = None, end: Time | None = None, metrics: list[str] | None = None, columns: list[str] | None = None, **how: Any) -> GeoPanel:
        got = source.fetch(geos, start, end, metrics, columns)
        return got if isinstance(got, GeoPanel) else cls.from_dataframe(got, **how)

    def fetch(self, geos: list[str] | None = None, start: Time | None = None, end: Time | None = None, metrics: list[str] | None = None, columns: list[str] | None = None) -> GeoPanel:
        """A panel is a source, too."""
        wanted = None if metrics is None and columns is None else [*(metrics or []), *(columns or [])]
        return self._with(filtered(self.df, self.geo, self.time, geos, start, end, wanted))

    def _with(self, df: DataFrame) -> GeoPanel:
        return GeoPanel(df, self.geo, self.time, self.frequency, tuple(c for c in self.metadata if c in df.columns))

    def with_metadata(self, markets: DataFrame, allow_unknown: bool = False) -> GeoPanel:
        """Left join of one row per market; a second row for a market would multiply cells, so it is an error."""
        markets = markets.withColumn(self.geo, F.col(self.geo).cast("string"))
        if markets.groupBy(self.geo).count().where("count > 1").limit(1).count():
            raise ValidationError("market metadata has several rows for a market.", "Keep one row per market.")
        if not allow_unknown and markets.join(self.df, self.geo, "left_anti").limit(1).count():
            raise ValidationError("market metadata names markets that the panel lacks.", "Drop them or allow unknown markets.")
        names = tuple(c for c in markets.columns if c != self.geo)
        return GeoPanel(self.df.drop(*names).join(markets, self.geo, "left"), self.geo, self.time, self.frequency, names)

    def metric_columns(self) -> list[str]:
        skip = {self.geo, self.time, *self.metadata}
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]

    def require(self, metrics: list[Metric]) -> None:
        validation.require_columns(self.df, [c for m in metrics for c in m.columns], "panel")

    def validate(self, **how: Any) -> validation.PanelReport:
        return validation.validate_panel(self.df, self.geo, self.time, frequency=self.frequency, **how)

    def markets(self) -> DataFrame:
        return self.df.select(self.geo).distinct().orderBy(self.geo)

    def dates(self) -> DataFrame:
        return self.df.select(self.time).distinct().orderBy(self.time)

    def time_range(self) -> tuple[datetime, datetime]:
        low, high = self.df.agg(F.min(self.time), F.max(self.time)).first()
        if low is None:
            raise ValidationError("the panel is empty.", "Check the filters.")
        return low, high

    def slice(self, start: Time | None = None, end: Time | None = None, geos: list[str] | None = None) -> GeoPanel:
        return self._with(filtered(self.df, self.geo, self.time, geos, start, end))

    def metric_frame(self, metrics: list[str | Metric], keys: bool = True, start: Time | None = None, end: Time | None = None, geos: list[str] | None = None) -> DataFrame:
        names = list(dict.fromkeys(c for m in metrics for c in ([m] if isinstance(m, str) else m.columns)))
        out = filtered(self.df, self.geo, self.time, geos, start, end, names)
        return out if keys else out.select(*names)

    def aggregate(self, columns: str | list[str] | dict[str, str], by: list[str] | None = None, freq: str | None = None, agg: str = "sum", geos: list[str] | None = None, start: Time | None = None, end: Time | None = None) -> DataFrame:
        """Sums (or another aggregate, or one for each column) by keys and, with ``freq``, by calendar period."""
        df = filtered(self.df, self.geo, self.time, geos, start, end)
        how = columns if isinstance(columns, dict) else dict.fromkeys([columns] if isinstance(columns, str) else columns, agg)
        keys = [F.col(c) for c in (by if by is not None else [self.geo] if freq else [])]
        if freq:
            keys.append(period(F.col(self.time), freq).alias(self.time))
        functions = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_samp, "nunique": F.count_distinct, "first": F.first}
        return df.groupBy(*keys).agg(*[functions[a](F.col(c)).alias(c) for c, a in how.items()])

    def to_parquet(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    def to_table(self, name: str, replace: bool = False) -> None:
        self.df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(quote_qualified_name(name))

    def to_pandas(self, most_rows: int = 1_000_000) -> Any:
        """To the driver, if it has at most ``most_rows`` rows."""
        if self.df.limit(most_rows + 1).count() > most_rows:
            raise ValidationError(f"the panel has more than {most_rows} rows.", "Aggregate it first, or raise most_rows.")
        return self.df.toPandas()

    def to_arrow(self) -> Any:
        return self.df.toArrow()


def period(time: Any, freq: str) -> Any:
    """The label of a time's calendar period: its first day, its last for names that end in E, the anchor day for weeks."""
    units = {"D": "day", "H": "hour", "MS": "month", "M": "month", "QS": "quarter", "Q": "quarter", "YS": "year", "Y": "year"}
    if freq in units:
        return F.date_trunc(units[freq], time)
    if freq in ("ME", "QE", "YE"):
        step = {"M": "0", "Q": "2", "Y": "11"}[freq[0]]
        return F.last_day(F.add_months(F.date_trunc(units[freq[0]], time), int(step))).cast("timestamp")
    if m := re.fullmatch(r"W(?:-([A-Z]{3}))?", freq):
        # weeks are labelled by the day they end on: the first such day on or after the time
        return F.next_day(F.date_sub(F.to_date(time), 1), m[1] or "SUN").cast("timestamp")
    raise ValidationError(f"unknown frequency {freq!r}.", f"Use one of {sorted(units)}, ME, QE, YE or W-MON..W-SUN.")
