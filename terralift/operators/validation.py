"""Checks of long panels: keys, frequency, gaps and duplicates; all counting happens in plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralift.errors import ValidationError

#: Steps of a calendar by name, as interval literals; anchored ones stand at the first or last day of their period.
STEPS = {"D": "1 day", "H": "1 hour", "MS": "1 month", "QS": "3 months", "YS": "1 year", "ME": "1 month", "QE": "3 months", "YE": "1 year"}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def require_columns(df: DataFrame, columns: list[str], context: str = "frame") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"{context} lacks columns {missing}.", f"Columns are {df.columns}.")


def normalize_keys(df: DataFrame, geo: str, time: str) -> DataFrame:
    """Geo as a string, time as a timestamp; a key that can't be read stops the query."""
    require_columns(df, [geo, time], "panel")
    parsed = F.col(time).try_cast("timestamp")
    bad = F.raise_error(F.concat(F.lit(f"column {time} holds what is no time: "), F.coalesce(F.col(time).cast("string"), F.lit("null")))).cast("timestamp")
    return df.withColumns({geo: F.col(geo).cast("string"), time: F.coalesce(parsed, bad)})


def _anchors(t: Column) -> dict[str, Column]:
    d = F.to_date(t)
    midnight = F.date_trunc("day", t) == t
    return {
        "YS": midnight & (F.trunc(d, "year") == d), "QS": midnight & (F.trunc(d, "quarter") == d), "MS": midnight & (F.trunc(d, "month") == d),
        "YE": midnight & (F.last_day(d) == d) & (F.month(d) == 12), "QE": midnight & (F.last_day(d) == d) & (F.month(d) % 3 == 0), "ME": midnight & (F.last_day(d) == d),
    }


def infer_frequency(df: DataFrame, time: str) -> str | timedelta | None:
    """The step of a panel's distinct times: the coarsest anchored calendar that all fit, else the commonest gap."""
    times = df.select(F.col(time).cast("timestamp").alias("t")).where("t is not null").distinct()
    gap = F.unix_micros("t") - F.lag(F.unix_micros("t")).over(Window.orderBy("t"))
    checks = times.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), *[F.bool_and(c).alias(k) for k, c in _anchors(F.col("t")).items()]).first()
    if checks["n"] < 2:
        return None
    gaps = times.select(gap.alias("gap")).where("gap is not null").groupBy("gap").count().orderBy(F.desc("count"), "gap").limit(1).first()["gap"]
    if checks["n"] > 2 or gaps > 27 * 86_400_000_000:
        for name in ("YS", "YE", "QS", "QE", "MS", "ME"):
            if checks[name] and gaps >= {"Y": 365, "Q": 89, "M": 28}[name[0]] * 86_400_000_000:
                return name
    step = timedelta(microseconds=gaps)
    if step == timedelta(days=1):
        return "D"
    if step == timedelta(days=7):
        return f"W-{WEEKDAYS[checks['low'].weekday()]}"
    return step


def interval_of(frequency: str | timedelta) -> str:
    if isinstance(frequency, timedelta):
        return f"{int(frequency.total_seconds())} seconds"
    if frequency in STEPS:
        return STEPS[frequency]
    if frequency.startswith("W"):
        return "7 days"
    raise ValidationError(f"unknown frequency {frequency!r}.", f"Use one of {sorted(STEPS)}, W-MON..W-SUN, or a timedelta.")


def calendar(df: DataFrame, time: str, frequency: str | timedelta) -> DataFrame:
    """Expected times from the first to the last seen; if the grid misses a time that was seen, the times seen."""
    spark = df.sparkSession
    seen = df.select(F.col(time).cast("timestamp").alias("t")).where("t is not null").distinct()
    step = interval_of(frequency)
    low_high = seen.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    if isinstance(frequency, str) and frequency.endswith("E"):
        grid = low_high.select(F.explode(F.expr(f"sequence(trunc(a, 'month'), trunc(b, 'month'), interval {step})")).alias("m")).select(F.last_day("m").cast("timestamp").alias("t"))
    else:
        grid = low_high.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("t"))
    if seen.join(grid, "t", "left_anti").limit(1).count():
        return seen
    del spark
    return grid


@dataclass
class PanelReport:
    """What a check found."""

    valid: bool
    n_missing: int = 0
    n_duplicates: int = 0
    missing: list[tuple[Any, Any]] = field(default_factory=list)
    duplicates: list[tuple[Any, Any]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    frequency: str | timedelta | None = None

    def raise_if_invalid(self) -> PanelReport:
        if not self.valid:
            raise ValidationError("; ".join(self.errors), "Fill or drop the cells named, or don't require a complete grid.")
        return self


def missing_cells(df: DataFrame, geo: str, time: str, frequency: str | timedelta) -> DataFrame:
    """``geo, time`` of the expected grid that the panel lacks."""
    keys = df.select(F.col(geo).alias("g"), F.col(time).cast("timestamp").alias("t")).distinct()
    grid = keys.select("g").distinct().crossJoin(calendar(df, time, frequency))  # markets x dates is the grid itself
    return grid.join(keys, ["g", "t"], "left_anti").select(F.col("g").alias(geo), F.col("t").alias(time))


def duplicate_cells(df: DataFrame, geo: str, time: str) -> DataFrame:
    """``geo, time, rows`` of cells with several rows."""
    return df.groupBy(geo, time).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def grid_diagnostics(df: DataFrame, geo: str, time: str, frequency: str | timedelta) -> DataFrame:
    """One row: markets, dates, expected and seen cells, missing and duplicate cells."""
    seen = df.agg(F.count_distinct(geo).alias("n_geos"), F.count_distinct(time).alias("n_times"), F.count_distinct(geo, time).alias("n_cells"))
    expected = calendar(df, time, frequency).agg(F.count(F.lit(1)).alias("n_expected_times"))
    missing = missing_cells(df, geo, time, frequency).agg(F.count(F.lit(1)).alias("n_missing"))
    repeated = duplicate_cells(df, geo, time).agg(F.count(F.lit(1)).alias("n_duplicates"))
    return seen.crossJoin(expected).crossJoin(missing).crossJoin(repeated)  # one row each


def validate_panel(df: DataFrame, geo: str, time: str, required: list[str] | None = None, frequency: str | timedelta | None = None, complete: bool = False, examples: int = 10) -> PanelReport:
    """Duplicates always fail; gaps fail only if a complete grid is required."""
    require_columns(df, [geo, time, *(required or [])], "panel")
    frequency = frequency or infer_frequency(df, time)
    repeated = duplicate_cells(df, geo, time)
    n_repeated = repeated.count()
    report = PanelReport(True, n_duplicates=n_repeated, frequency=frequency)
    if n_repeated:
        report.duplicates = [(r[geo], r[time]) for r in repeated.orderBy(geo, time).limit(examples).collect()]
        report.valid = False
        report.errors.append(f"{n_repeated} duplicate cells, such as {report.duplicates[0]}")
    if frequency is not None:
        gaps = missing_cells(df, geo, time, frequency)
        report.n_missing = gaps.count()
        if report.n_missing:
            report.missing = [(r[geo], r[time]) for r in gaps.orderBy(geo, time).limit(examples).collect()]
            said = f"{report.n_missing} missing cells, such as {report.missing[0]}"
            (report.errors if complete else report.warnings).append(said)
            report.valid = report.valid and not complete
    return report


def as_day(value: str | date | datetime) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])
