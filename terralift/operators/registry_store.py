"""Registry of experiments: three tables as Parquet, rewritten whole behind checks that run as joins."""

from __future__ import annotations

import json
import uuid
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import ValidationError
from terralift.operators.assignments import CONTROL, TREATMENT, AssignmentMatrix

EXPERIMENTS = "experiment_id string, name string, domain string, status string, start_date date, end_date date, treatment_geos array<string>, control_geos array<string>, primary_metrics array<string>, cooldown_until date, notes string, metadata string"
ASSIGNMENTS = "experiment_id string, geo_id string, role string, start_date date, end_date date, status string, cooldown_until date, metadata string"
ARTIFACTS = "experiment_id string, artifact_type string, uri string, manifest string"
STATUSES = ("planned", "active", "cooldown", "completed", "cancelled")
#: Days of a stretch that intervals are joined by.
STEP_DAYS = 32
ROLES = ("treatment", "control", "eligible_control", "excluded", "unused")


def overlaps(start: Column, end: Column, low: Any, high: Any) -> Column:
    """Inclusive intervals that meet."""
    return (start <= (high if isinstance(high, Column) else F.lit(high).cast("date"))) & (end >= (low if isinstance(low, Column) else F.lit(low).cast("date")))


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


class ExperimentRegistry:
    """Experiments, assignments and artifacts under one folder; a pointer file names the current version of each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        pointer = Path(self.path) / f"{name}.current"
        if not pointer.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(pointer.read_text().strip())

    def _write(self, name: str, df: DataFrame) -> None:
        # a new version beside the old, then one small write that switches to it
        version = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(version)
        pointer = Path(self.path) / f"{name}.current"
        pointer.parent.mkdir(parents=True, exist_ok=True)
        staged = pointer.with_suffix(".next")
        staged.write_text(version)
        staged.replace(pointer)

    @property
    def experiments(self) -> DataFrame:
        return self._table("experiments", EXPERIMENTS)

    @property
    def assignment_rows(self) -> DataFrame:
        return self._table("assignments", ASSIGNMENTS)

    def add_experiment(self, record: dict[str, Any], dry_run: bool = False, replace: bool = False) -> dict[str, int]:
        return self.add_experiments([record], dry_run, replace)

    def add_planned(self, record: dict[str, Any], dry_run: bool = False) -> dict[str, int]:
        return self.add_experiment({**record, "status": "planned"}, dry_run)

    def add_experiments(self, records: list[dict[str, Any]], dry_run: bool = False, replace: bool = False, skip_existing: bool = False) -> dict[str, int]:
        """Insert or replace experiments and their assignments, all or none; a dry run only counts."""
        rows = [experiment_row(r) for r in records]
        new = self.spark.createDataFrame(rows, EXPERIMENTS)
        ids = [r[0] for r in rows]
        existing = {r[0] for r in self.experiments.where(F.col("experiment_id").isin(ids)).select("experiment_id").collect()} if ids else set()
        if existing and skip_existing:
            new = new.where(~F.col("experiment_id").isin(list(existing)))
        elif existing and not replace:
            raise ValidationError(f"experiments {sorted(existing)} exist.", "Pass replace=True.")
        assigned = expand_assignments(new)
        rest = self.assignment_rows.join(new.select("experiment_id"), "experiment_id", "left_anti")
        clash = role_conflicts(assigned, rest.unionByName(assigned)).first()
        if clash:
            raise ValidationError(f"market {clash['geo_id']} is {clash['role']} of {clash['experiment_id']} and {clash['other_role']} of {clash['other_id']} at once.", "Move one of them.")
        counts = {"experiments": new.count(), "assignments": assigned.count()}
        if not dry_run:
            kept = self.experiments.join(new.select("experiment_id"), "experiment_id", "left_anti")
            self._write("experiments", kept.unionByName(new))
            self._write("assignments", rest.unionByName(assigned))
        return counts

    def import_assignments(self, source: str | DataFrame | dict[str, Any], dry_run: bool = False, replace: bool = True) -> dict[str, int]:
        from terralift.sources.registry_import import load_registry_import

        return self.add_experiments(load_registry_import(self.spark, source), dry_run, replace, skip_existing=not replace)

    def get_experiment(self, experiment_id: str) -> dict[str, Any] | None:
        row = self.experiments.where(F.col("experiment_id") == experiment_id).first()
        return row.asDict(True) if row else None

    def list_experiments(self, status: list[str] | None = None) -> DataFrame:
        df = self.experiments
        if status is not None:
            df = df.where(F.col("status").isin(status) if status else F.lit(False))
        return df.orderBy("experiment_id")

    def assignments(self, experiment_id: str | None = None, statuses: list[str] | None = None, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
        """Assignment rows with the experiment's status and cooldown where they have none of their own."""
        e = self.experiments.select("experiment_id", F.col("status").alias("e_status"), F.col("cooldown_until").alias("e_cooldown"))
        df = self.assignment_rows.join(e, "experiment_id").withColumns({"status": F.coalesce("status", "e_status"), "cooldown_until": F.coalesce("cooldown_until", "e_cooldown")}).drop("e_status", "e_cooldown")
        if experiment_id is not None:
            df = df.where(F.col("experiment_id") == experiment_id)
        if statuses is not None:
            df = df.where(F.col("status").isin(statuses) if statuses else F.lit(False))
        if start is not None or end is not None:
            df = df.where(overlaps(F.col("start_date"), F.col("end_date"), start or end, end or start))
        return df

    def to_assignment_matrix(self, **how: Any) -> AssignmentMatrix:
        return AssignmentMatrix.from_frame(self.assignments(**how))

    def active_market_blocks(self, start: date | str, end: date | str | None = None) -> dict[str, list[str]]:
        rows = self.assignments(statuses=["active"], start=start, end=end or start)
        roles = {r["role"]: sorted(r["geos"]) for r in rows.groupBy("role").agg(F.collect_set("geo_id").alias("geos")).collect()}
        treated, control = roles.get(TREATMENT, []), roles.get(CONTROL, [])
        return {"treatment": treated, "control": control, "blocked_from_treatment": sorted({*treated, *control}), "blocked_from_control": treated}

    def active_treatment_blocks(self, start: date | str, end: date | str | None = None) -> list[str]:
        return self.active_market_blocks(start, end)["treatment"]

    def active_control_blocks(self, start: date | str, end: date | str | None = None) -> list[str]:
        return self.active_market_blocks(start, end)["control"]

    markets_blocked_from_control = active_treatment_blocks

    def cooldown_blocks(self, start: date | str, end: date | str | None = None) -> list[str]:
        """Treated markets whose days after the test, up to the cooldown's end, meet the window."""
        rows = self.assignments(statuses=["active", "completed", "cooldown"]).where(F.col("role") == TREATMENT).where("cooldown_until is not null")
        return sorted(r[0] for r in rows.where(overlaps(F.date_add("end_date", 1), F.col("cooldown_until"), start, end or start)).select("geo_id").distinct().collect())

    def shared_control_usage(self, start: date | str, end: date | str, statuses: list[str] | None = None, shared_only: bool = True) -> DataFrame:
        used = self.to_assignment_matrix(statuses=statuses or ["planned", "active"], start=start, end=end).dates(start, end).where(F.col("role") == CONTROL)
        counts = used.groupBy("geo_id", "date").agg(F.count_distinct("test_id").alias("n_tests"))
        return counts.where("n_tests > 1") if shared_only else counts

    def add_artifact(self, experiment_id: str, artifact_type: str, uri: str, manifest: dict[str, Any] | None = None, dry_run: bool = False) -> None:
        if self.get_experiment(experiment_id) is None:
            raise ValidationError(f"experiment {experiment_id!r} is unknown.", "Add it first.")
        if not dry_run:
            row = self.spark.createDataFrame([(experiment_id, artifact_type, uri, json.dumps(manifest or {}, sort_keys=True))], ARTIFACTS)
            self._write("artifacts", self._table("artifacts", ARTIFACTS).unionByName(row))

    def artifacts(self, experiment_id: str) -> DataFrame:
        return self._table("artifacts", ARTIFACTS).where(F.col("experiment_id") == experiment_id)


def experiment_row(r: dict[str, Any]) -> tuple:
    """Checked values of one experiment in the order of the table."""
    from terralift.operators.validation import as_day

    names = lambda v: [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else [str(x) for x in (v or [])]
    treated, control = names(r.get("treatment_geos")), names(r.get("control_geos"))
    status = str(r.get("status") or "planned").strip().lower()
    start, end = as_day(r["start_date"]), as_day(r["end_date"])
    cooldown = as_day(r["cooldown_until"]) if r.get("cooldown_until") else None
    if status not in STATUSES:
        raise ValidationError(f"status {status!r} is unknown.", f"Use one of {STATUSES}.")
    if end < start or (cooldown and cooldown < end):
        raise ValidationError(f"{r['experiment_id']} has dates out of order.", "start <= end <= cooldown.")
    if both := sorted({*treated} & {*control}):
        raise ValidationError(f"{r['experiment_id']} has {both} in both arms.", "Keep arms disjoint.")
    metadata = r.get("metadata")
    return (str(r["experiment_id"]), r.get("name"), r.get("domain"), status, start, end, treated, control, names(r.get("primary_metrics")), cooldown, r.get("notes"), metadata if isinstance(metadata, str) else json.dumps(metadata or {}, sort_keys=True, default=str))


def expand_assignments(experiments: DataFrame) -> DataFrame:
    """One row for each market of each arm."""
    arm = lambda c, role: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda g: F.struct(g.alias("geo_id"), F.lit(role).alias("role")))
    rows = experiments.select("experiment_id", "start_date", "end_date", "status", "cooldown_until", F.explode(F.concat(arm("treatment_geos", TREATMENT), arm("control_geos", CONTROL))).alias("a"))
    return rows.select("experiment_id", "a.geo_id", "a.role", "start_date", "end_date", "status", "cooldown_until", F.lit("{}").alias("metadata"))


def role_conflicts(new: DataFrame, every: DataFrame) -> DataFrame:
    """Active rows of ``new`` whose market has the opposite role in another active experiment at the same time."""
    step = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / STEP_DAYS)
    steps = lambda s, e: F.explode(F.sequence(step(s), step(e))).alias("__step")
    a = new.where(F.col("status") == "active").where(F.col("role").isin(TREATMENT, CONTROL)).select("experiment_id", "geo_id", "role", "start_date", "end_date", steps(F.col("start_date"), F.col("end_date")))
    b = every.where(F.col("status") == "active").where(F.col("role").isin(TREATMENT, CONTROL)).select(F.col("experiment_id").alias("other_id"), "geo_id", F.col("role").alias("other_role"), F.col("start_date").alias("s"), F.col("end_date").alias("e"), steps(F.col("start_date"), F.col("end_date")))
    # rows meet by market and stretch of days; a pair counts in the stretch of its later start, which both have
    once = step(F.greatest("start_date", "s")) == F.col("__step")
    return a.join(b, ["geo_id", "__step"]).where((F.col("role") != F.col("other_role")) & (F.col("experiment_id") != F.col("other_id")) & overlaps(F.col("start_date"), F.col("end_date"), F.col("s"), F.col("e")) & once).drop("__step")


def merge_experiments(rows: DataFrame) -> DataFrame:
    """Assignment rows to one row per experiment: widest dates, sorted markets by role, the furthest status."""
    names = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("geo_id"))))
    return rows.groupBy("experiment_id").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.max("cooldown_until").alias("cooldown_until"),
        names(TREATMENT).alias("treatment_geos"), names(CONTROL).alias("control_geos"), F.max_by("status", status_rank(F.col("status"))).alias("status"),
    )
