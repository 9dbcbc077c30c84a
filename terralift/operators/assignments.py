"""Assignments of markets to tests as inclusive date intervals, and what they imply for each market and date."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import ValidationError

SCHEMA = "test_id string, geo_id string, role string, start_date date, end_date date, status string"
TREATMENT, CONTROL = "treatment", "control"


@dataclass(frozen=True)
class AssignmentMatrix:
    """Interval rows (test_id, geo_id, role, start_date, end_date, status)."""

    df: DataFrame
    step: str = "1 day"

    @classmethod
    def from_records(cls, spark: SparkSession, records: list[Any], step: str = "1 day") -> AssignmentMatrix:
        get = lambda r, k: (r.get(k) if isinstance(r, dict) else getattr(r, k, None))
        rows = [(str(get(r, "test_id") or get(r, "experiment_id")), str(get(r, "geo_id")), get(r, "role"), _day(get(r, "start_date")), _day(get(r, "end_date")), get(r, "status")) for r in records]
        for r in rows:
            if r[4] < r[3]:
                raise ValidationError(f"{r[0]} {r[1]} ends before it starts.", "Swap the dates.")
        return cls(spark.createDataFrame(rows, SCHEMA), step)

    @classmethod
    def from_frame(cls, df: DataFrame, step: str = "1 day") -> AssignmentMatrix:
        names = {"experiment_id": "test_id", "market_id": "geo_id"}
        df = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
        if "status" not in df.columns:
            df = df.withColumn("status", F.lit(None).cast("string"))
        return cls(df.select(F.col("test_id").cast("string"), F.col("geo_id").cast("string"), "role", F.col("start_date").cast("date"), F.col("end_date").cast("date"), "status"), step)

    @classmethod
    def from_candidates(cls, candidates: DataFrame, step: str = "1 day") -> AssignmentMatrix:
        """Rows of candidate designs with arrays of treatment and control markets."""
        arms = F.explode(F.array(F.struct(F.lit(TREATMENT).alias("role"), F.col("treatment_markets").alias("markets")), F.struct(F.lit(CONTROL).alias("role"), F.col("control_markets").alias("markets")))).alias("arm")
        wide = candidates.select(F.coalesce("test_name", "candidate_id").alias("test_id"), "start_date", "end_date", arms)
        return cls.from_frame(wide.select("test_id", F.explode("arm.markets").alias("geo_id"), F.col("arm.role").alias("role"), "start_date", "end_date"), step)

    def combine(self, *others: AssignmentMatrix) -> AssignmentMatrix:
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        return AssignmentMatrix(df, self.step)

    def dates(self, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
        """One row for each date of each interval, within a window."""
        low = F.col("start_date") if start is None else F.greatest("start_date", F.lit(start).cast("date"))
        high = F.col("end_date") if end is None else F.least("end_date", F.lit(end).cast("date"))
        rows = self.df.select("test_id", "geo_id", "role", "status", low.alias("low"), high.alias("high")).where("low <= high")
        return rows.select("test_id", "geo_id", "role", "status", F.explode(F.sequence("low", "high", F.expr(f"interval {self.step}"))).alias("date"))

    def market_role(self, test: str, market: str, day: date | str) -> str | None:
        at = F.lit(day).cast("date")
        roles = [r["role"] for r in self.df.where((F.col("test_id") == test) & (F.col("geo_id") == market) & F.lit(at).between(F.col("start_date"), F.col("end_date"))).select("role").distinct().limit(2).collect()]
        if len(roles) > 1:
            raise ValidationError(f"{market} has several roles in {test} on {day}.", "Keep one.")
        return roles[0] if roles else None

    def treatment_overlaps(self) -> DataFrame:
        """Market-dates that several tests treat."""
        return _tests(self.dates().where(F.col("role") == TREATMENT)).where("n_tests > 1")

    def treatment_control_conflicts(self) -> DataFrame:
        """Market-dates that are treated and control at once, in one test or two."""
        ids = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("test_id"))))
        both = self.dates().groupBy("geo_id", "date").agg(ids(TREATMENT).alias("treatment_tests"), ids(CONTROL).alias("control_tests"))
        return both.where((F.size("treatment_tests") > 0) & (F.size("control_tests") > 0))

    def shared_control_usage(self, shared_only: bool = True) -> DataFrame:
        """Tests that use each market-date as control."""
        used = _tests(self.dates().where(F.col("role") == CONTROL))
        return used.where("n_tests > 1") if shared_only else used

    def max_shared_control_usage(self) -> int:
        return self.shared_control_usage(False).agg(F.coalesce(F.max("n_tests"), F.lit(0))).first()[0]

    def interval_control_usage(self) -> DataFrame:
        return self.df.where(F.col("role") == CONTROL).groupBy("geo_id").agg(F.count(F.lit(1)).alias("n_intervals"))

    def validate(self, most_shared: int | None = None, allow_shared: bool = True) -> None:
        """Raises on the first offence: overlap, conflict, sharing where it's off, sharing beyond the limit."""
        checks = [
            (self.treatment_overlaps(), "is treated by several tests"),
            (self.treatment_control_conflicts(), "is treated and control at once"),
        ]
        if not allow_shared:
            checks.append((self.shared_control_usage(), "is a shared control, which is off"))
        elif most_shared is not None:
            checks.append((self.shared_control_usage().where(F.col("n_tests") > most_shared), f"is a control of more than {most_shared} tests"))
        for offending, said in checks:
            if row := offending.orderBy("geo_id", "date").first():
                raise ValidationError(f"market {row['geo_id']} {said} on {row['date']}.", "Move a test or drop the market from one.")

    def intervals(self) -> DataFrame:
        """First and last date of each market's role in a test; gaps are bridged."""
        return self.df.groupBy("test_id", "geo_id", "role").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def _tests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("geo_id", "date").agg(F.count_distinct("test_id").alias("n_tests"), F.sort_array(F.collect_set("test_id")).alias("tests"))


def _day(value: Any) -> date:
    from terralift.operators.validation import as_day

    return as_day(value)


@dataclass
class UsageReport:
    """Class of a plan: disjoint, shared_controls, or an invalid kind; with what is wrong."""

    usage: str
    errors: list[str] = field(default_factory=list)
    max_usage: int = 0


def classify_usage(plan: AssignmentMatrix, registry: AssignmentMatrix | None = None, most_shared: int | None = None, allow_shared: bool = True, raise_on_error: bool = False) -> UsageReport:
    """Whether a plan, with the registry's tests, keeps treatments exclusive and controls within limits."""
    all_rows = plan.combine(registry) if registry else plan
    most = all_rows.max_shared_control_usage()
    if all_rows.treatment_overlaps().limit(1).count():
        report = UsageReport("invalid_treatment_overlap", ["a market is treated by several tests at once"], most)
    elif all_rows.treatment_control_conflicts().limit(1).count():
        report = UsageReport("invalid_treatment_control_conflict", ["a market is treated and control at once"], most)
    elif most > 1 and (not allow_shared or (most_shared is not None and most > most_shared)):
        report = UsageReport("invalid_shared_control_usage", [f"a control serves {most} tests"], most)
    else:
        report = UsageReport("shared_controls" if most > 1 else "disjoint", [], most)
    if raise_on_error and report.errors:
        raise ValidationError("; ".join(report.errors), "Move a test or drop the market from one.")
    return report
