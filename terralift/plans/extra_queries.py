"""Queries of streams, of conformal and jackknife plans, and of candidate scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralift.functions.metrics import RatioMetric
from terralift.operators import contracts, inference, markets, portfolio, power
from terralift.operators.design import geo_periods, prepared
from terralift.operators.reports import calendar_events
from terralift.plans.estimator_queries import FEATURES_SQL, two_features
from terralift.plans.panels import EVENTS_SQL, ORDERS_SQL, PREPARED_SQL, REVENUE, TREATED, design, events_panel, orders_panel
from terralift.plans.portfolio_queries import CANDIDATES_SQL, ITEMS_SQL, candidates, items
from terralift.sources.synthetic import balanced_round
from terralift.streaming.monitoring import daily_arms

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("stream_daily_arms", "SELECT date_trunc('day', ts) AS day, round(avg(value) FILTER (user_id % 10 < 5), 6) AS treatment, round(avg(value) FILTER (user_id % 10 >= 5), 6) AS control FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_daily_arms(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of two arms, as a stream over the events run to its end."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parquet*")  # a glob, as the table can be one file
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("string").alias("geo"), "value")
    name = f"arms_{uuid.uuid4().hex}"
    q = daily_arms(rows, "ts", "geo", "value", [str(i) for i in range(5)]).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    out = rounded(spark.table(name), 6, "treatment", "control")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("conformal_block_p", f"""WITH {EVENTS_SQL}, s AS (SELECT geo_id, row_number() OVER (PARTITION BY geo_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY geo_id) AS n, orders - avg(orders) OVER (PARTITION BY geo_id) AS e FROM events_panel),
b AS (SELECT a.geo_id, a.i AS start, a.n, abs(avg(b.e)) AS score FROM s a, range(5) k, s b WHERE b.geo_id = a.geo_id AND b.i = (a.i + k.range) % a.n GROUP BY 1, 2, 3)
SELECT geo_id, round(count(*) FILTER (score >= seen - 1e-12) / count(*), 9) AS p_value FROM (SELECT *, max(CASE WHEN start = n - 5 THEN score END) OVER (PARTITION BY geo_id) AS seen FROM b) GROUP BY 1""")
def conformal_block_p(spark: SparkSession, d: str) -> DataFrame:
    """Share of circular five-day blocks of residuals that score as high as the last one, for every market at once."""
    w = Window.partitionBy("geo_id")
    s = events_panel(spark, d).df.select("geo_id", (F.row_number().over(w.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), (F.col("orders") - F.avg("orders").over(w)).alias("e"))
    return rounded(inference.block_conformal_by(s, "geo_id", 5), 9, "p_value")


@query("jackknife_did", f"""WITH {PREPARED_SQL}, g AS (SELECT geo, treated, post - pre AS delta FROM geo_periods WHERE pre IS NOT NULL AND post IS NOT NULL), l AS (SELECT a.geo, avg(b.delta) FILTER (b.treated = 1) - avg(b.delta) FILTER (b.treated = 0) AS v FROM g a JOIN g b ON a.geo <> b.geo GROUP BY 1)
SELECT round(sqrt((count(*) - 1) / count(*) * sum((v - m) ** 2)), 4) AS standard_error, count(*) AS n FROM l, (SELECT avg(v) AS m FROM l)""")
def jackknife_did(spark: SparkSession, d: str) -> DataFrame:
    g = geo_periods(prepared(orders_panel(spark, d), design(), REVENUE)).select("geo", "treated", "delta")
    return rounded(inference.jackknife_by(g, "geo", "treated", "delta"), 4, "standard_error")


@query("randomization_p_values", f"""WITH {EVENTS_SQL}, u AS (SELECT geo_id, sum(revenue) AS y, CAST(geo_id AS INTEGER) AS i FROM events_panel GROUP BY 1),
s AS (SELECT m.range AS a, avg(y) FILTER ((m.range >> i) & 1 = 1) - avg(y) FILTER ((m.range >> i) & 1 = 0) AS t FROM range(1024) m, u WHERE bit_count(m.range) = 3 GROUP BY 1), o AS (SELECT t FROM s WHERE a = 146)
SELECT round(o.t, 4) AS statistic, round(count(*) FILTER (abs(s.t) >= abs(o.t) - 1e-9) / count(*), 9) AS p_value, count(*) AS assignments FROM s, o GROUP BY o.t""")
def randomization_p_values(spark: SparkSession, d: str) -> DataFrame:
    u = events_panel(spark, d).df.groupBy("geo_id").agg(F.sum("revenue").alias("y")).withColumn("z", F.col("geo_id").isin("1", "4", "7").cast("int"))
    s = inference.randomization_by(u, "geo_id", "y", "z")
    seen = s.where("observed").select(F.col("statistic").alias("seen"))
    p = s.crossJoin(F.broadcast(seen)).groupBy("seen").agg(F.avg((F.abs("statistic") >= F.abs("seen") - 1e-9).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("assignments"))
    return p.select(F.round("seen", 4).alias("statistic"), F.round("p_value", 9).alias("p_value"), "assignments")


@query("assignment_ranking", f"""WITH {FEATURES_SQL}, a AS (SELECT * FROM (VALUES (0, ['0', '1', '2', '3', '4']), (1, ['0', '5', '10', '15', '20']), (2, ['4', '9', '14', '19', '24'])) t(assignment, treated)),
l AS (SELECT geo, 'revenue_mean' AS feature, revenue_mean AS v FROM f UNION ALL SELECT geo, 'orders_mean', orders_mean FROM f),
b AS (SELECT assignment, feature, (avg(v) FILTER (list_contains(treated, geo)) - avg(v) FILTER (NOT list_contains(treated, geo))) / sqrt((var_samp(v) FILTER (list_contains(treated, geo)) + var_samp(v) FILTER (NOT list_contains(treated, geo))) / 2) AS smd FROM l, a GROUP BY 1, 2)
SELECT CAST(assignment AS BIGINT) AS assignment, round(max(abs(smd)), 8) AS max_smd FROM b GROUP BY 1""")
def assignment_ranking(spark: SparkSession, d: str) -> DataFrame:
    sets = [tuple("01234"), ("0", "5", "10", "15", "20"), ("4", "9", "14", "19", "24")]
    r = markets.rank_assignments(two_features(spark, d), sets, ["revenue_mean", "orders_mean"])
    return r.select("assignment", F.round("max_smd", 8).alias("max_smd"))


@query("rounding_to_total", f"""WITH {ORDERS_SQL}, v AS (SELECT geo_id, date, orders * 1.08 AS v FROM orders_panel), r AS (SELECT *, round(sum(v) OVER (PARTITION BY geo_id)) AS total, row_number() OVER (PARTITION BY geo_id ORDER BY v - floor(v) DESC, date) AS k, sum(floor(v)) OVER (PARTITION BY geo_id) AS s FROM v)
SELECT geo_id, date, CAST(floor(v) + CASE WHEN k <= total - s THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM r""")
def rounding_to_total(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers by largest remainders, up to each market's rounded total."""
    v = orders_panel(spark, d).df.select("geo_id", "date", (F.col("orders") * F.lit("1.08").cast("decimal(3,2)")).alias("v"))
    total = F.round(F.sum("v").over(Window.partitionBy("geo_id")))
    return balanced_round(v, "v", total, ["geo_id"], ["date"]).select("geo_id", "date", "rounded")


@query("metric_lift_monotone", f"WITH {EVENTS_SQL}, x AS (SELECT geo_id, orders, lead(orders) OVER (PARTITION BY geo_id ORDER BY date) AS next FROM events_panel) SELECT geo_id, bool_and(next IS NULL OR next >= orders) AS monotone FROM x GROUP BY 1")
def metric_lift_monotone(spark: SparkSession, d: str) -> DataFrame:
    return power.monotone(events_panel(spark, d).df, ["geo_id"], "date", "orders")


@query("plan_calendar_events", f"""WITH {ITEMS_SQL}, m AS (SELECT test_id, unnest(list_distinct(list_concat(treatment_markets, control_markets))) AS geo_id, start_date, end_date FROM items)
SELECT test_id, geo_id, 'pre' AS kind, start_date - 28 AS start_date, start_date - 1 AS end_date FROM m UNION ALL SELECT test_id, geo_id, 'live', start_date, end_date FROM m UNION ALL SELECT test_id, geo_id, 'cooldown', end_date + 1, end_date + 28 FROM m""")
def plan_calendar_events(spark: SparkSession, d: str) -> DataFrame:
    return calendar_events(items(spark, d))


@query("plan_pair_penalties", f"""WITH {CANDIDATES_SQL} SELECT a.candidate_id AS a, b.candidate_id AS b, round(2.0 * len(list_intersect(a.control_markets, b.control_markets)) / greatest(1, least(len(a.control_markets), len(b.control_markets))), 8) AS control_part,
  round(0.5 * greatest(0, least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) + 1) / least(a.end_date - a.start_date + 1, b.end_date - b.start_date + 1), 8) AS calendar_part
FROM candidates a JOIN candidates b ON a.candidate_id < b.candidate_id AND a.test_name <> b.test_name""")
def plan_pair_penalties(spark: SparkSession, d: str) -> DataFrame:
    w = contracts.ObjectiveWeights(shared_control_risk=2.0, calendar_overlap_risk=0.5)
    p = contracts.pair_penalties(candidates(spark, d), w)
    return p.select("a", "b", F.round("control_part", 8).alias("control_part"), F.round("calendar_part", 8).alias("calendar_part"))


@query("plan_learning_values", f"""WITH {CANDIDATES_SQL}, c AS (SELECT candidate_id, len(treatment_markets) / 200.0 AS mde FROM candidates), r AS (SELECT candidate_id, ln(1 + 1 / greatest(mde, 0.01)) * (1 + 1 / 4.0) AS raw FROM c)
SELECT candidate_id, round(100 * raw / max(raw) OVER (), 8) AS value FROM r""")
def plan_learning_values(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("candidate_id", F.create_map(F.lit("orders"), F.size("treatment_markets") / 200.0).alias("metric_mde"))
    known = spark.range(3).select(F.lit("orders").alias("metric"))
    return rounded(portfolio.learning_values(c, known), 8, "value")


@query("plan_candidate_scores", f"WITH {CANDIDATES_SQL} SELECT candidate_id, round(100.0 - 100.0 * 0.05 * len(treatment_markets) - 0.5 * len(control_markets), 8) AS score FROM candidates")
def plan_candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    score = portfolio.candidate_score(F.lit(1.0), 0.05 * F.size("treatment_markets"), F.size("control_markets"), 1.0, 0.5)
    return candidates(spark, d).select("candidate_id", F.round(score, 8).alias("score"))


@query("metric_ratio_lift", f"WITH {EVENTS_SQL} SELECT geo_id, round(sum(CASE WHEN CAST(geo_id AS INTEGER) < 5 AND date >= DATE '2024-01-15' THEN orders * 1.2 * 1.2 ELSE orders END) / sum(CASE WHEN CAST(geo_id AS INTEGER) < 5 AND date >= DATE '2024-01-15' THEN sessions * 1.2 ELSE sessions END), 9) AS conversion FROM events_panel GROUP BY 1")
def metric_ratio_lift(spark: SparkSession, d: str) -> DataFrame:
    """A lift of the ratio by a fifth while its denominator grows by as much."""
    m = RatioMetric("conversion", numerator="orders", denominator="sessions")
    e = events_panel(spark, d).df
    lifted = e.withColumns(m.lifted(0.2, F.col("geo_id").isin(TREATED) & (F.col("date") >= "2024-01-15"), affect_denominator=True))
    return rounded(m.aggregate_by(lifted, ["geo_id"]), 9, "conversion")
