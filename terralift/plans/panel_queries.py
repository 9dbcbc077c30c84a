"""Queries over panels: sources, validation, slices, aggregation, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.functions.metrics import CompositeMetric, CountMetric, RatioMetric, ratio_moments
from terralift.operators import validation
from terralift.plans.panels import DISCOUNT, EVENTS_SQL, LINEITEM_SQL, ORDERS, ORDERS_SQL, REVENUE, TREATED, events_panel, lineitem_panel, orders_panel, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("panel_orders", f"WITH {ORDERS_SQL} SELECT geo_id, date, orders, round(revenue, 4) AS revenue, customers FROM orders_panel")
def panel_orders(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).df.withColumn("revenue", F.round("revenue", 4))


@query("panel_events", f"WITH {EVENTS_SQL} SELECT geo_id, date, sessions, orders, round(revenue, 4) AS revenue FROM events_panel")
def panel_events(spark: SparkSession, d: str) -> DataFrame:
    return events_panel(spark, d).df.withColumn("revenue", F.round("revenue", 4))


GRID = """grid AS (
  SELECT g.geo_id, t.date FROM (SELECT DISTINCT geo_id FROM orders_panel) g,
    (SELECT unnest(generate_series((SELECT min(date) FROM orders_panel), (SELECT max(date) FROM orders_panel), INTERVAL 1 MONTH)) AS date) t
)"""


@query("panel_missing_cells", f"WITH {ORDERS_SQL}, {GRID} SELECT geo_id, CAST(date AS TIMESTAMP) AS date FROM grid ANTI JOIN orders_panel USING (geo_id, date)")
def panel_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    p = orders_panel(spark, d)
    return validation.missing_cells(p.df, p.geo, p.time, "MS")


@query("panel_grid_diagnostics", f"""WITH {ORDERS_SQL}, {GRID}
SELECT count(DISTINCT geo_id) AS n_geos, count(DISTINCT date) AS n_times, count(*) AS n_cells, (SELECT count(DISTINCT date) FROM grid) AS n_expected_times,
  (SELECT count(*) FROM grid ANTI JOIN orders_panel USING (geo_id, date)) AS n_missing, CAST(0 AS BIGINT) AS n_duplicates FROM orders_panel""")
def panel_grid_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    p = orders_panel(spark, d)
    return validation.grid_diagnostics(p.df, p.geo, p.time, "MS")


@query("panel_duplicate_cells", "SELECT CAST(c_nationkey AS VARCHAR) AS geo_id, date_trunc('day', o_orderdate) AS date, count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 1")
def panel_duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return validation.duplicate_cells(rows.select(F.col("c_nationkey").cast("string").alias("geo_id"), F.date_trunc("day", "o_orderdate").alias("date")), "geo_id", "date")


@query("panel_slice", f"WITH {ORDERS_SQL} SELECT geo_id, date, orders FROM orders_panel WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-01' AND geo_id IN ('0', '3', '7')")
def panel_slice(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).slice("1996-03-01", "1998-06-01", ["0", "3", "7"]).metric_frame(["orders"])


@query("panel_slice_no_markets", f"WITH {ORDERS_SQL} SELECT geo_id, date, orders FROM orders_panel WHERE false")
def panel_slice_no_markets(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).slice(geos=[]).metric_frame(["orders"])


@query("panel_aggregate_quarters", f"WITH {ORDERS_SQL} SELECT geo_id, date_trunc('quarter', date) AS date, CAST(sum(orders) AS BIGINT) AS orders, round(avg(revenue), 4) AS revenue FROM orders_panel GROUP BY 1, 2")
def panel_aggregate_quarters(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).aggregate({"orders": "sum", "revenue": "mean"}, freq="QS").withColumn("revenue", F.round("revenue", 4))


@query("panel_aggregate_weeks", f"WITH {EVENTS_SQL} SELECT geo_id, CAST(CAST(date AS DATE) + CAST(7 - isodow(CAST(date AS DATE)) AS INTEGER) AS TIMESTAMP) AS date, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(sessions) AS BIGINT) AS sessions FROM events_panel GROUP BY 1, 2")
def panel_aggregate_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks that end on Sunday, labelled by it."""
    return events_panel(spark, d).aggregate(["orders", "sessions"], freq="W-SUN")


@query("panel_total", f"WITH {ORDERS_SQL} SELECT CAST(sum(orders) AS BIGINT) AS orders, CAST(max(customers) AS BIGINT) AS customers FROM orders_panel")
def panel_total(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).aggregate({"orders": "sum", "customers": "max"}, by=[])


@query("panel_metadata", f"WITH {ORDERS_SQL} SELECT r_name AS region, count(*) AS cells, CAST(sum(orders) AS BIGINT) AS orders FROM orders_panel LEFT JOIN nation ON geo_id = CAST(n_nationkey AS VARCHAR) LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def panel_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = orders_panel(spark, d).with_metadata(n.select(F.col("n_nationkey").cast("string").alias("geo_id"), F.col("r_name").alias("region")), allow_unknown=True)
    return p.df.groupBy("region").agg(F.count(F.lit(1)).alias("cells"), F.sum("orders").alias("orders"))


@query("panel_markets_and_range", f"WITH {ORDERS_SQL} SELECT geo_id, min(date) AS first, max(date) AS last, count(*) AS n FROM orders_panel GROUP BY 1")
def panel_markets_and_range(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).df.groupBy("geo_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))


@query("metric_ratio_by_market", f"WITH {LINEITEM_SQL} SELECT geo_id, round(sum(discounted) / sum(gross), 9) AS discount FROM lineitem_panel GROUP BY 1")
def metric_ratio_by_market(spark: SparkSession, d: str) -> DataFrame:
    return DISCOUNT.aggregate_by(lineitem_panel(spark, d).df, ["geo_id"]).withColumn("discount", F.round("discount", 9))


@query("metric_ratio_rows", f"WITH {EVENTS_SQL} SELECT geo_id, date, CASE WHEN sessions > 0 THEN round(orders / sessions, 9) END AS conversion FROM events_panel")
def metric_ratio_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows without sessions are null, not an error."""
    m = RatioMetric("conversion", numerator="orders", denominator="sessions")
    return events_panel(spark, d).df.select("geo_id", "date", F.round(m.row(), 9).alias("conversion"))


@query("metric_composite", f"WITH {EVENTS_SQL} SELECT geo_id, round(sum(1.0 * orders + 0.25 * sessions), 6) AS engagement FROM events_panel GROUP BY 1")
def metric_composite(spark: SparkSession, d: str) -> DataFrame:
    m = CompositeMetric("engagement", weights={"orders": 1.0, "sessions": 0.25})
    return m.aggregate_by(events_panel(spark, d).df, ["geo_id"]).withColumn("engagement", F.round("engagement", 6))


@query("metric_delta_method", f"""WITH {LINEITEM_SQL}, u AS (SELECT geo_id, sum(discounted) AS n, sum(gross) AS d FROM lineitem_panel GROUP BY 1),
  a AS (SELECT CAST(geo_id AS INTEGER) < 5 AS treated, n, d FROM u), r AS (SELECT treated, sum(n) / sum(d) AS ratio FROM a GROUP BY 1)
SELECT a.treated, round(r.ratio, 9) AS ratio, round(var_samp(n - ratio * d) / count(*) / (avg(d) * avg(d)) * 1e6, 6) AS variance_ppm, count(*) AS n FROM a JOIN r USING (treated) GROUP BY 1, r.ratio""")
def metric_delta_method(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of sums of each arm and its variance over markets."""
    df = lineitem_panel(spark, d).df.withColumn("treated", F.col("geo_id").isin(TREATED))
    m = ratio_moments(df, DISCOUNT, ["treated"], "geo_id")
    return m.select("treated", F.round("ratio", 9).alias("ratio"), F.round(F.col("variance") * 1e6, 6).alias("variance_ppm"), "n")


@query("metric_inject_lift", f"WITH {ORDERS_SQL} SELECT geo_id, round(sum(CASE WHEN CAST(geo_id AS INTEGER) < 5 AND date >= DATE '1999-01-01' THEN revenue * 1.08 ELSE revenue END), 2) AS revenue FROM orders_panel GROUP BY 1")
def metric_inject_lift(spark: SparkSession, d: str) -> DataFrame:
    p = orders_panel(spark, d)
    lifted = REVENUE.inject_lift(p.df, 0.08, F.col("geo_id").isin(TREATED) & (F.col("date") >= "1999-01-01"))
    return REVENUE.aggregate_by(lifted, ["geo_id"]).withColumn("revenue", F.round("revenue", 2))


@query("metric_inject_absolute", f"WITH {ORDERS_SQL} SELECT geo_id, CAST(sum(CASE WHEN date >= DATE '2000-01-01' THEN orders + 2 ELSE orders END) AS DOUBLE) AS orders FROM orders_panel GROUP BY 1")
def metric_inject_absolute(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.aggregate_by(ORDERS.inject_lift(orders_panel(spark, d).df, 2, F.col("date") >= "2000-01-01", relative=False), ["geo_id"])


@query("metric_linearized", f"WITH {LINEITEM_SQL}, r AS (SELECT sum(discounted) / sum(gross) AS ratio FROM lineitem_panel WHERE date < DATE '1999-01-01') SELECT geo_id, round(sum(discounted - ratio * gross), 3) AS residual FROM lineitem_panel, r GROUP BY 1")
def metric_linearized(spark: SparkSession, d: str) -> DataFrame:
    df = lineitem_panel(spark, d).df
    level = df.where(F.col("date") < "1999-01-01").agg(DISCOUNT.aggregate().alias("ratio"))
    return df.crossJoin(F.broadcast(level)).groupBy("geo_id").agg(F.round(F.sum(DISCOUNT.linearized(F.col("ratio"))), 3).alias("residual"))


@query("metric_planning_score", f"WITH {ORDERS_SQL} SELECT geo_id, CAST(-sum(orders) AS DOUBLE) AS score FROM orders_panel GROUP BY 1")
def metric_planning_score(spark: SparkSession, d: str) -> DataFrame:
    m = CountMetric("returns", direction="decrease", column="orders")
    return orders_panel(spark, d).df.groupBy("geo_id").agg(m.planning_score().alias("score"))
