"""Queries over assignments of markets to tests, and over the registry's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.operators.assignments import AssignmentMatrix
from terralift.operators.registry_store import merge_experiments, overlaps, role_conflicts
from terralift.plans.panels import INTERVALS_SQL, intervals

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def matrix(spark: SparkSession, d: str) -> AssignmentMatrix:
    return AssignmentMatrix.from_frame(intervals(spark, d))


def joined(c: str) -> Column:
    return F.array_join(c, ",")


@query("assignment_dates", f"WITH {INTERVALS_SQL} SELECT test_id, geo_id, role, count(*) AS rows, min(date) AS first, max(date) AS last FROM dates WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2, 3")
def assignment_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = matrix(spark, d).dates("1996-01-01", "1999-12-31")
    return rows.groupBy("test_id", "geo_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("assignment_treatment_overlaps", f"WITH {INTERVALS_SQL} SELECT geo_id, date, count(DISTINCT test_id) AS n_tests, string_agg(DISTINCT test_id, ',' ORDER BY test_id) AS tests FROM dates WHERE role = 'treatment' GROUP BY 1, 2 HAVING count(DISTINCT test_id) > 1")
def assignment_treatment_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).treatment_overlaps().withColumn("tests", joined("tests"))


@query("assignment_conflicts", f"""WITH {INTERVALS_SQL}, sides AS (SELECT geo_id, date,
  string_agg(DISTINCT test_id, ',' ORDER BY test_id) FILTER (role = 'treatment') AS treatment_tests, string_agg(DISTINCT test_id, ',' ORDER BY test_id) FILTER (role = 'control') AS control_tests FROM dates GROUP BY 1, 2)
SELECT * FROM sides WHERE treatment_tests IS NOT NULL AND control_tests IS NOT NULL""")
def assignment_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).treatment_control_conflicts().withColumns({c: joined(c) for c in ("treatment_tests", "control_tests")})


@query("assignment_shared_controls", f"WITH {INTERVALS_SQL} SELECT geo_id, date, count(DISTINCT test_id) AS n_tests FROM dates WHERE role = 'control' GROUP BY 1, 2 HAVING count(DISTINCT test_id) > 1")
def assignment_shared_controls(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).shared_control_usage().drop("tests")


@query("assignment_max_usage", f"WITH {INTERVALS_SQL} SELECT max(n) AS most FROM (SELECT count(DISTINCT test_id) AS n FROM dates WHERE role = 'control' GROUP BY geo_id, date)")
def assignment_max_usage(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).shared_control_usage(False).agg(F.max("n_tests").alias("most"))


@query("assignment_interval_usage", f"WITH {INTERVALS_SQL} SELECT geo_id, count(*) AS n_intervals FROM intervals WHERE role = 'control' GROUP BY 1")
def assignment_interval_usage(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).interval_control_usage()


@query("assignment_intervals", f"WITH {INTERVALS_SQL} SELECT test_id, geo_id, role, min(start_date) AS start_date, max(end_date) AS end_date FROM intervals GROUP BY 1, 2, 3")
def assignment_intervals(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).intervals()


@query("assignment_usage_class", f"""WITH {INTERVALS_SQL}, m AS (SELECT geo_id, date, count(DISTINCT test_id) FILTER (role = 'treatment') AS t, count(DISTINCT test_id) FILTER (role = 'control') AS c FROM dates GROUP BY 1, 2)
SELECT geo_id, CASE WHEN max(t) > 1 THEN 'invalid_treatment_overlap' WHEN max(CASE WHEN t > 0 AND c > 0 THEN 1 ELSE 0 END) = 1 THEN 'invalid_treatment_control_conflict' WHEN max(c) > 1 THEN 'shared_controls' ELSE 'disjoint' END AS usage FROM m GROUP BY 1""")
def assignment_usage_class(spark: SparkSession, d: str) -> DataFrame:
    n = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("test_id")))
    m = matrix(spark, d).dates().groupBy("geo_id", "date").agg(n("treatment").alias("t"), n("control").alias("c"))
    usage = F.when(F.max("t") > 1, "invalid_treatment_overlap").when(F.bool_or((F.col("t") > 0) & (F.col("c") > 0)), "invalid_treatment_control_conflict").when(F.max("c") > 1, "shared_controls").otherwise("disjoint")
    return m.groupBy("geo_id").agg(usage.alias("usage"))


REGISTRY_SQL = f"""{INTERVALS_SQL}, registry AS (
  SELECT test_id AS experiment_id, geo_id, role, start_date, end_date, status, end_date + 30 AS cooldown_until FROM intervals
)"""


def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select(F.col("test_id").alias("experiment_id"), "geo_id", "role", "start_date", "end_date", "status", F.date_add("end_date", 30).alias("cooldown_until"))


@query("registry_window", f"WITH {REGISTRY_SQL} SELECT experiment_id, geo_id, role, start_date, end_date FROM registry WHERE status = 'active' AND start_date <= DATE '1998-06-30' AND end_date >= DATE '1998-01-01'")
def registry_window(spark: SparkSession, d: str) -> DataFrame:
    r = registry_rows(spark, d).where("status = 'active'").where(overlaps(F.col("start_date"), F.col("end_date"), "1998-01-01", "1998-06-30"))
    return r.select("experiment_id", "geo_id", "role", "start_date", "end_date")


@query("registry_blocks", f"WITH {REGISTRY_SQL} SELECT geo_id, max(CASE WHEN role = 'treatment' THEN 1 ELSE 0 END) = 1 AS blocked_from_control, true AS blocked_from_treatment FROM registry WHERE status = 'active' AND start_date <= DATE '1998-03-31' AND end_date >= DATE '1998-01-01' GROUP BY 1")
def registry_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = registry_rows(spark, d).where("status = 'active'").where(overlaps(F.col("start_date"), F.col("end_date"), "1998-01-01", "1998-03-31"))
    return r.groupBy("geo_id").agg(F.bool_or(F.col("role") == "treatment").alias("blocked_from_control"), F.lit(True).alias("blocked_from_treatment"))


@query("registry_cooldown", f"WITH {REGISTRY_SQL} SELECT DISTINCT geo_id FROM registry WHERE status IN ('active', 'completed', 'cooldown') AND role = 'treatment' AND end_date + 1 <= DATE '1998-03-31' AND cooldown_until >= DATE '1998-03-01'")
def registry_cooldown(spark: SparkSession, d: str) -> DataFrame:
    r = registry_rows(spark, d).where(F.col("status").isin("active", "completed", "cooldown") & (F.col("role") == "treatment"))
    return r.where(overlaps(F.date_add("end_date", 1), F.col("cooldown_until"), "1998-03-01", "1998-03-31")).select("geo_id").distinct()


@query("registry_role_conflicts", f"""WITH {REGISTRY_SQL} SELECT a.experiment_id, a.geo_id, b.experiment_id AS other_id, count(*) AS pairs FROM registry a JOIN registry b ON a.geo_id = b.geo_id AND a.role <> b.role AND a.experiment_id <> b.experiment_id
  AND a.start_date <= b.end_date AND a.end_date >= b.start_date WHERE a.status = 'active' AND b.status = 'active' GROUP BY 1, 2, 3""")
def registry_role_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r = registry_rows(spark, d)
    return role_conflicts(r, r).groupBy("experiment_id", "geo_id", "other_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("registry_merge", f"""WITH {REGISTRY_SQL} SELECT experiment_id, min(start_date) AS start_date, max(end_date) AS end_date, max(cooldown_until) AS cooldown_until,
  string_agg(DISTINCT geo_id, ',' ORDER BY geo_id) FILTER (role = 'treatment') AS treatment_geos, string_agg(DISTINCT geo_id, ',' ORDER BY geo_id) FILTER (role = 'control') AS control_geos,
  CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN bool_or(status = 'active') THEN 'active' ELSE 'planned' END AS status FROM registry GROUP BY 1""")
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    m = merge_experiments(registry_rows(spark, d))
    return m.withColumns({c: F.nullif(joined(c), F.lit("")) for c in ("treatment_geos", "control_geos")})


@query("registry_shared_usage", f"WITH {REGISTRY_SQL}, x AS (SELECT experiment_id, geo_id, CAST(unnest(generate_series(greatest(start_date, DATE '1997-01-01'), least(end_date, DATE '1997-12-31'), INTERVAL 1 DAY)) AS DATE) AS date FROM registry WHERE role = 'control' AND status IN ('planned', 'active') AND start_date <= DATE '1997-12-31' AND end_date >= DATE '1997-01-01') SELECT geo_id, date, count(DISTINCT experiment_id) AS n_tests FROM x GROUP BY 1, 2 HAVING count(DISTINCT experiment_id) > 1")
def registry_shared_usage(spark: SparkSession, d: str) -> DataFrame:
    r = registry_rows(spark, d).where(F.col("status").isin("planned", "active") & (F.col("role") == "control"))
    rows = AssignmentMatrix.from_frame(r).dates("1997-01-01", "1997-12-31")
    return rows.groupBy("geo_id", "date").agg(F.count_distinct("test_id").alias("n_tests")).where("n_tests > 1")
