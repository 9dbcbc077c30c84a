"""The panels that the registered queries work on, from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.functions.metrics import ContinuousMetric, CountMetric, RatioMetric
from terralift.operators.design import Design
from terralift.operators.panel import GeoPanel

TREATED = [str(i) for i in range(5)]
CONTROL = [str(i) for i in range(5, 25)]
START, END = "1999-01-01", "2001-12-31"
REVENUE, ORDERS = ContinuousMetric("revenue", column="revenue"), CountMetric("orders", column="orders")
DISCOUNT = RatioMetric("discount", numerator="discounted", denominator="gross")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def design() -> Design:
    return Design.of("orders-1999", TREATED, CONTROL, START, END)


def orders_panel(spark: SparkSession, sf_dir: str) -> GeoPanel:
    """Nation by month of order."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    df = rows.groupBy(F.col("c_nationkey").cast("string").alias("geo_id"), F.date_trunc("month", "o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"), F.count_distinct("o_custkey").alias("customers"))
    return GeoPanel(df, frequency="MS")


ORDERS_SQL = """orders_panel AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS geo_id, date_trunc('month', o_orderdate) AS date, count(*) AS orders,
         sum(o_totalprice) AS revenue, count(DISTINCT o_custkey) AS customers
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""

PREPARED_SQL = f"""{ORDERS_SQL}, prepared AS (
  SELECT geo_id AS geo, date AS time, CAST(CAST(geo_id AS INTEGER) < 5 AS INTEGER) AS treated,
         CAST(date >= DATE '{START}' AS INTEGER) AS post, revenue AS outcome, orders
  FROM orders_panel WHERE date <= DATE '{END}' AND CAST(geo_id AS INTEGER) < 25
), geo_periods AS (
  SELECT geo, treated, avg(CASE WHEN post = 0 THEN outcome END) AS pre, avg(CASE WHEN post = 1 THEN outcome END) AS post,
         sum(CASE WHEN post = 0 THEN outcome END) AS pre_total, sum(CASE WHEN post = 1 THEN outcome END) AS post_total
  FROM prepared GROUP BY 1, 2
)"""


def lineitem_panel(spark: SparkSession, sf_dir: str) -> GeoPanel:
    """Supplier's nation by month of shipment: discounted and gross value."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    df = rows.groupBy(F.col("s_nationkey").cast("string").alias("geo_id"), F.date_trunc("month", "l_shipdate").alias("date")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discounted"), F.sum("l_extendedprice").alias("gross"), F.sum("l_quantity").alias("quantity"))
    return GeoPanel(df, frequency="MS")


LINEITEM_SQL = f"""lineitem_panel AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS geo_id, date_trunc('month', l_shipdate) AS date, sum(l_extendedprice * l_discount) AS discounted,
         sum(l_extendedprice) AS gross, sum(l_quantity) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), ratio_cells AS (
  SELECT geo_id AS geo, CAST(CAST(geo_id AS INTEGER) < 5 AS INTEGER) AS treated,
    coalesce(sum(CASE WHEN date < DATE '{START}' THEN discounted END), 0) AS n_pre, coalesce(sum(CASE WHEN date < DATE '{START}' THEN gross END), 0) AS d_pre,
    coalesce(sum(CASE WHEN date >= DATE '{START}' THEN discounted END), 0) AS n_post, coalesce(sum(CASE WHEN date >= DATE '{START}' THEN gross END), 0) AS d_post
  FROM lineitem_panel WHERE date <= DATE '{END}' AND CAST(geo_id AS INTEGER) < 25 GROUP BY 1, 2
)"""


def events_panel(spark: SparkSession, sf_dir: str) -> GeoPanel:
    """Ten markets (user id modulo ten) by day."""
    e = read(spark, sf_dir, "events")
    one = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    df = e.groupBy((F.col("user_id") % 10).cast("string").alias("geo_id"), F.date_trunc("day", "ts").alias("date")).agg(one("view").alias("sessions"), one("purchase").alias("orders"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("revenue"))
    return GeoPanel(df, frequency="D")


EVENTS_SQL = """events_panel AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS geo_id, date_trunc('day', ts) AS date,
    CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS sessions,
    CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS orders,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0) AS revenue
  FROM events GROUP BY 1, 2
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests (customer modulo 40) that hold a nation for 28 days from an order; large orders treat, others control."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    day = F.to_date("o_orderdate")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("test_id"), F.col("c_nationkey").cast("string").alias("geo_id"),
        F.when(F.col("o_totalprice") > 150000, "treatment").otherwise("control").alias("role"), day.alias("start_date"), F.date_add(day, 27).alias("end_date"),
        F.element_at(F.array(*[F.lit(s) for s in ("planned", "active", "completed")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"),
    )


INTERVALS_SQL = """intervals AS (
  SELECT 't' || CAST(o_custkey % 40 AS VARCHAR) AS test_id, CAST(c_nationkey AS VARCHAR) AS geo_id,
    CASE WHEN o_totalprice > 150000 THEN 'treatment' ELSE 'control' END AS role,
    CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 27 AS end_date,
    CASE o_orderkey % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'active' ELSE 'completed' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
), dates AS (
  SELECT test_id, geo_id, role, status, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM intervals
)"""
