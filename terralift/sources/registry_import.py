"""Registry imports: CSV and JSON through Spark's readers, YAML on the driver, or rows at hand."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import ValidationError
from terralift.operators.registry_store import STATUSES, merge_experiments

ROLE_NAMES = {"treated": "treatment", "treat": "treatment", "test": "treatment", "holdout": "control", "ctrl": "control"}


def load_registry_import(spark: SparkSession, source: str | DataFrame | dict[str, Any] | list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Experiment records from a file, a frame, or rows; assignment rows are merged by experiment."""
    if isinstance(source, DataFrame):
        return from_assignment_rows(source)
    if isinstance(source, str):
        if source.endswith(".csv"):
            return from_assignment_rows(spark.read.csv(source, header=True))
        if source.endswith(".json"):
            source = json.loads("\n".join(r[0] for r in spark.read.text(source, wholetext=True).collect()))
        elif source.endswith((".yml", ".yaml")):
            import yaml

            source = yaml.safe_load(Path(source).read_text())
        else:
            raise ValidationError(f"can't import {source!r}.", "Use a .csv, .json, .yml or .yaml file.")
    experiments, rows = split_payload(source)
    merged = {e["experiment_id"]: e for e in experiments}
    if rows:
        names = sorted({k for r in rows for k in r})
        frame = spark.createDataFrame([tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in rows], ", ".join(f"{n} string" for n in names))
        for e in from_assignment_rows(frame):
            old = merged.get(e["experiment_id"], {})
            for side in ("treatment_geos", "control_geos"):
                e[side] = sorted({*(old.get(side) or []), *e[side]})
            merged[e["experiment_id"]] = {**old, **{k: v for k, v in e.items() if v is not None}}
    return [merged[k] for k in sorted(merged)]


def split_payload(payload: Any) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """Experiments and assignment rows, by key or by the look of the rows."""
    if isinstance(payload, dict) and ("experiments" in payload or "assignments" in payload):
        return list(payload.get("experiments") or []), list(payload.get("assignments") or [])
    rows = payload if isinstance(payload, list) else [payload]
    is_assignment = lambda r: "geo_id" in r or "role" in r
    return [r for r in rows if not is_assignment(r)], [r for r in rows if is_assignment(r)]


def from_assignment_rows(df: DataFrame) -> list[dict[str, Any]]:
    """One record per experiment; these are few, so they come to the driver for the registry's checks."""
    for c in ("status", "cooldown_until", "name", "domain", "primary_metrics"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    role = F.lower(F.trim("role"))
    for k, v in ROLE_NAMES.items():
        role = F.when(role == k, v).otherwise(role)
    rows = df.select("experiment_id", F.trim("geo_id").alias("geo_id"), role.alias("role"), F.col("start_date").cast("date"), F.col("end_date").cast("date"), F.coalesce(F.lower(F.trim("status")), F.lit(STATUSES[0])).alias("status"), F.nullif(F.trim(F.col("cooldown_until").cast("string")), F.lit("")).cast("date").alias("cooldown_until"))
    named = df.groupBy("experiment_id").agg(F.max("name").alias("name"), F.max("domain").alias("domain"), F.max("primary_metrics").alias("primary_metrics"))
    return [r.asDict(True) for r in merge_experiments(rows).join(named, "experiment_id").orderBy("experiment_id").collect()]
