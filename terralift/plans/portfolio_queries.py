"""Queries across tests: covariance, pooling, decisions, monitoring, candidates, calendars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralift.operators import portfolio, reports
from terralift.operators.assignments import AssignmentMatrix
from terralift.plans.panels import EVENTS_SQL, INTERVALS_SQL, events_panel, intervals

QUERIES: dict = {}
ORACLE_SQL: dict = {}
AS_OF = date(2002, 1, 31)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


ITEMS_SQL = f"""{INTERVALS_SQL}, items AS (SELECT test_id, list_sort(list(DISTINCT geo_id) FILTER (role = 'treatment')) AS treatment_markets, list_sort(list(DISTINCT geo_id) FILTER (role = 'control' AND CAST(geo_id AS INTEGER) > 4)) AS control_markets,
  max(start_date) - 27 AS start_date, max(end_date) AS end_date, CASE CAST(substr(test_id, 2) AS INTEGER) % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS status,
  CASE WHEN CAST(substr(test_id, 2) AS INTEGER) % 3 > 0 THEN 0.5 + (CAST(substr(test_id, 2) AS INTEGER) % 5) / 10.0 END AS calibrated_power FROM intervals GROUP BY test_id
  HAVING count(*) FILTER (role = 'treatment') > 0 AND count(*) FILTER (role = 'control' AND CAST(geo_id AS INTEGER) > 4) > 0)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """Roadmap items out of the test intervals."""
    i = intervals(spark, d)
    control = (F.col("role") == "control") & (F.col("geo_id").cast("int") > 4)
    number = F.substring("test_id", 2, 9).cast("int")
    rows = i.groupBy("test_id").agg(F.sort_array(F.collect_set(F.when(F.col("role") == "treatment", F.col("geo_id")))).alias("treatment_markets"), F.sort_array(F.collect_set(F.when(control, F.col("geo_id")))).alias("control_markets"), F.date_sub(F.max("start_date"), 27).alias("start_date"), F.max("end_date").alias("end_date"))
    rows = rows.where((F.size("treatment_markets") > 0) & (F.size("control_markets") > 0))
    status = F.element_at(F.array(*[F.lit(s) for s in ("planned", "active", "completed", "cancelled")]), number % 4 + 1)
    return rows.withColumns({"status": status, "calibrated_power": F.when(number % 3 > 0, 0.5 + (number % 5) / 10.0)})


@query("portfolio_overlap", f"""WITH {ITEMS_SQL}, t AS (SELECT *, list_distinct(list_concat(treatment_markets, control_markets)) AS markets FROM items),
p AS (SELECT a.test_id AS a, b.test_id AS b, len(list_intersect(a.markets, b.markets)) AS shared, least(len(a.markets), len(b.markets)) AS least,
  greatest(0, least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) + 1) AS days, least(a.end_date - a.start_date + 1, b.end_date - b.start_date + 1) AS shorter,
  len(a.treatment_markets)::DOUBLE AS t1, len(a.control_markets)::DOUBLE AS ac, len(b.treatment_markets)::DOUBLE AS bt, len(b.control_markets)::DOUBLE AS bc,
  len(list_intersect(a.treatment_markets, b.treatment_markets)) AS tt, len(list_intersect(a.treatment_markets, b.control_markets)) AS tc, len(list_intersect(a.control_markets, b.treatment_markets)) AS ct, len(list_intersect(a.control_markets, b.control_markets)) AS cc
  FROM t a JOIN t b ON a.test_id < b.test_id),
q AS (SELECT *, (tt / (t1 * bt) - tc / (t1 * bc) - ct / (ac * bt) + cc / (ac * bc)) / (sqrt(1 / t1 + 1 / ac) * sqrt(1 / bt + 1 / bc)) AS alignment FROM p)
SELECT a, b, shared, round(shared / least, 8) AS market_share, CAST(days AS BIGINT) AS overlap_days, round(days / shorter, 8) AS calendar_share, round(alignment, 8) AS alignment, round(alignment * (shared / least) * (0.75 * days / shorter + 0.25), 8) AS proxy FROM q""")
def portfolio_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = portfolio.overlap_drivers(items(spark, d))
    return o.withColumns({c: F.round(c, 8) for c in ("market_share", "calendar_share", "alignment", "proxy")})


@query("portfolio_draw_covariance", f"""WITH {EVENTS_SQL}, x AS (SELECT date AS draw, geo_id AS test_id, orders::DOUBLE AS value FROM events_panel)
SELECT a.test_id AS a, b.test_id AS b, round(covar_samp(a.value, b.value), 8) AS covariance, round(corr(a.value, b.value), 8) AS correlation FROM x a JOIN x b ON a.draw = b.draw AND a.test_id < b.test_id GROUP BY 1, 2""")
def portfolio_draw_covariance(spark: SparkSession, d: str) -> DataFrame:
    x = events_panel(spark, d).df.select(F.col("date").alias("draw"), F.col("geo_id").alias("test_id"), F.col("orders").cast("double").alias("value"))
    return portfolio.draw_covariance(x).withColumns({c: F.round(c, 8) for c in ("covariance", "correlation")})


@query("portfolio_clusters", f"""WITH RECURSIVE {EVENTS_SQL}, ids AS (SELECT DISTINCT geo_id AS test_id FROM events_panel), e AS (SELECT test_id AS a, CAST((CAST(test_id AS INTEGER) + 3) % 10 AS VARCHAR) AS b FROM ids WHERE CAST(test_id AS INTEGER) % 2 = 0),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT test_id, test_id AS other FROM ids UNION SELECT r.test_id, s.b FROM r JOIN s ON r.other = s.a)
SELECT test_id, min(other) AS cluster FROM r GROUP BY 1""")
def portfolio_clusters(spark: SparkSession, d: str) -> DataFrame:
    ids = events_panel(spark, d).df.select(F.col("geo_id").alias("test_id")).distinct()
    pairs = ids.where(F.col("test_id").cast("int") % 2 == 0).select(F.col("test_id").alias("a"), ((F.col("test_id").cast("int") + 3) % 10).cast("string").alias("b"), F.lit(1.0).alias("proxy"))
    return portfolio.clusters(pairs, ids, 0.5)


EVIDENCE_SQL = f"""{EVENTS_SQL}, evidence AS (SELECT geo_id AS record, CAST(CAST(geo_id AS INTEGER) % 2 AS VARCHAR) AS domain, avg(orders) AS estimate, var_samp(orders) / count(*) / 5 AS variance FROM events_panel GROUP BY geo_id),
w AS (SELECT *, 1 / variance AS w FROM evidence WHERE variance > 0), f AS (SELECT domain, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * estimate) / sum(w) AS mu, sum(w * estimate * estimate) AS swy2 FROM w GROUP BY 1),
t AS (SELECT domain, n, greatest(0, (swy2 - sw * mu * mu - (n - 1)) / (sw - sw2 / sw)) AS tau2 FROM f), p AS (SELECT domain, n, tau2, sum(estimate / (variance + tau2)) / sum(1 / (variance + tau2)) AS mean, 1 / sum(1 / (variance + tau2)) AS v FROM w JOIN t USING (domain) GROUP BY 1, 2, 3)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return events_panel(spark, d).df.groupBy(F.col("geo_id").alias("record")).agg(F.avg("orders").alias("estimate"), (F.var_samp("orders") / F.count(F.lit(1)) / 5).alias("variance")).withColumn("domain", (F.col("record").cast("int") % 2).cast("string"))


@query("portfolio_pooling", f"WITH {EVIDENCE_SQL} SELECT domain, n, round(tau2, 8) AS tau2, round(mean, 8) AS mean, round(v, 8) AS variance, round(mean - 1.96 * sqrt(tau2 + v), 8) AS low, round(mean + 1.96 * sqrt(tau2 + v), 8) AS high FROM p")
def portfolio_pooling(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.pooled(evidence(spark, d), ["domain"]).withColumns({c: F.round(c, 8) for c in ("tau2", "mean", "variance", "low", "high")})


@query("portfolio_shrinkage", f"WITH {EVIDENCE_SQL} SELECT record, domain, round(tau2 / (tau2 + variance) * estimate + (1 - tau2 / (tau2 + variance)) * mean, 8) AS shrunk FROM evidence JOIN p USING (domain)")
def portfolio_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.shrunk(evidence(spark, d), ["domain"]).select("record", "domain", F.round("shrunk", 8).alias("shrunk"))


DECISION_SQL = f"""{EVENTS_SQL}, m AS (SELECT 't' || CAST(CAST(geo_id AS INTEGER) % 5 AS VARCHAR) AS test_id, 'm' || geo_id AS metric, CASE WHEN CAST(geo_id AS INTEGER) < 5 THEN 'primary' ELSE 'guardrail' END AS role,
  CASE CAST(geo_id AS INTEGER) % 3 WHEN 0 THEN 'superiority' WHEN 1 THEN 'non_inferiority' ELSE 'equivalence' END AS framework, avg(orders) - 1.6 AS estimate, sqrt(var_samp(orders) / count(*)) AS se, (sum(orders) % 50 + 1) / 500.0 AS p_value FROM events_panel GROUP BY geo_id),
i AS (SELECT *, estimate - 1.96 * se AS low, estimate + 1.96 * se AS high FROM m),
r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY test_id, framework) AS k FROM i WHERE role = 'primary' WINDOW w AS (PARTITION BY test_id, framework ORDER BY p_value, metric)),
a AS (SELECT * EXCLUDE (r, k), least(1.0, max((k - r + 1) * p_value) OVER (PARTITION BY test_id, framework ORDER BY r ROWS UNBOUNDED PRECEDING)) AS adjusted FROM r UNION ALL SELECT *, p_value FROM i WHERE role <> 'primary'),
dec AS (SELECT *, CASE framework WHEN 'non_inferiority' THEN CASE WHEN low > -0.3 THEN 'passed' WHEN high < -0.3 THEN 'failed' ELSE 'inconclusive' END WHEN 'equivalence' THEN CASE WHEN low > -0.3 AND high < 0.3 THEN 'passed' WHEN low > 0.3 OR high < -0.3 THEN 'failed' ELSE 'inconclusive' END
  ELSE CASE WHEN adjusted <= 0.05 AND estimate > 0 THEN 'passed' WHEN adjusted <= 0.05 THEN 'failed' ELSE 'inconclusive' END END AS decision FROM a)"""


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("geo_id").cast("int")
    m = events_panel(spark, d).df.groupBy("geo_id").agg((F.avg("orders") - 1.6).alias("estimate"), F.sqrt(F.var_samp("orders") / F.count(F.lit(1))).alias("se"), ((F.sum("orders") % 50 + 1) / 500.0).alias("p_value"))
    framework = F.element_at(F.array(*[F.lit(s) for s in ("superiority", "non_inferiority", "equivalence")]), n % 3 + 1)
    return m.select(F.concat(F.lit("t"), (n % 5).cast("string")).alias("test_id"), F.concat(F.lit("m"), "geo_id").alias("metric"), F.when(n < 5, "primary").otherwise("guardrail").alias("role"), framework.alias("framework"), F.lit("increase").alias("direction"), F.lit(0.3).alias("margin"), F.lit(0.05).alias("alpha"), "estimate", (F.col("estimate") - 1.96 * F.col("se")).alias("low"), (F.col("estimate") + 1.96 * F.col("se")).alias("high"), "p_value")


@query("portfolio_decisions", f"WITH {DECISION_SQL} SELECT test_id, metric, framework, round(adjusted, 8) AS adjusted, decision FROM dec")
def portfolio_decisions(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.decided(metric_rows(spark, d)).select("test_id", "metric", "framework", F.round("adjusted", 8).alias("adjusted"), "decision")


@query("portfolio_states", f"""WITH {DECISION_SQL}, g AS (SELECT test_id, count(*) FILTER (role = 'primary') AS n, count(*) FILTER (role = 'primary' AND decision = 'passed') AS ok, count(*) FILTER (role = 'primary' AND decision = 'failed') AS bad, count(*) FILTER (role = 'guardrail' AND decision = 'failed') AS guard, max(adjusted) AS max_p FROM dec GROUP BY 1)
SELECT test_id, CASE WHEN n = 0 THEN 'descriptive_only' WHEN guard > 0 OR bad > 0 THEN 'no_go' WHEN ok = n THEN 'ship_scale' ELSE 'inconclusive' END AS state, round(max_p, 8) AS max_p FROM g""")
def portfolio_states(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.test_states(portfolio.decided(metric_rows(spark, d))).select("test_id", "state", F.round("max_p", 8).alias("max_p"))


@query("monitor_utilization", f"""WITH {ITEMS_SQL}, x AS (SELECT test_id, 'treatment' AS role, unnest(treatment_markets) AS market FROM items UNION ALL SELECT test_id, 'control', unnest(control_markets) FROM items)
SELECT market, count(*) FILTER (role = 'treatment') AS treatment, count(*) FILTER (role = 'control') AS control, string_agg(DISTINCT test_id, ',' ORDER BY test_id) AS tests FROM x GROUP BY 1""")
def monitor_utilization(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.market_utilization(items(spark, d))


@query("monitor_cooldown_debt", f"""WITH {ITEMS_SQL} SELECT market, max(end_date + 2000) AS until FROM (SELECT unnest(list_distinct(list_concat(treatment_markets, control_markets))) AS market, end_date FROM items WHERE status IN ('completed', 'cancelled') AND DATE '{AS_OF}' - end_date BETWEEN 0 AND 1999) GROUP BY 1""")
def monitor_cooldown_debt(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.cooldown_debt(items(spark, d), AS_OF, 2000)


@query("monitor_power_coverage", f"WITH {ITEMS_SQL} SELECT count(*) AS items, count(calibrated_power) AS with_power, count(*) FILTER (calibrated_power >= 0.8) AS reaching FROM items WHERE status IN ('planned', 'locked', 'active', 'launched')")
def monitor_power_coverage(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.power_coverage(items(spark, d))


@query("monitor_status_counts", f"WITH {ITEMS_SQL} SELECT status, count(*) AS items FROM items GROUP BY 1")
def monitor_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.status_counts(items(spark, d))


CANDIDATES_SQL = f"""{ITEMS_SQL}, candidates AS (SELECT test_id AS candidate_id, 'p' || CAST(CAST(substr(test_id, 2) AS INTEGER) % 6 AS VARCHAR) AS test_name, start_date, end_date, treatment_markets, control_markets, 100.0 - 10.0 * len(control_markets) / len(treatment_markets) AS score FROM items)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return i.select(F.col("test_id").alias("candidate_id"), F.concat(F.lit("p"), (F.substring("test_id", 2, 9).cast("int") % 6).cast("string")).alias("test_name"), "start_date", "end_date", "treatment_markets", "control_markets", (100.0 - 10.0 * F.size("control_markets") / F.size("treatment_markets")).alias("score"))


@query("plan_top_candidates", f"WITH {CANDIDATES_SQL}, r AS (SELECT test_name, candidate_id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY test_name ORDER BY score DESC, candidate_id) AS INTEGER) AS rank FROM candidates) SELECT * FROM r WHERE rank <= 5")
def plan_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.top_candidates(candidates(spark, d)).select("test_name", "candidate_id", F.round("score", 8).alias("score"), "rank")


@query("plan_conflicts", f"""WITH {CANDIDATES_SQL} SELECT a.candidate_id AS a, b.candidate_id AS b FROM candidates a JOIN candidates b ON a.candidate_id < b.candidate_id AND a.test_name <> b.test_name AND a.start_date <= b.end_date AND b.start_date <= a.end_date
WHERE list_has_any(a.treatment_markets, b.treatment_markets) OR list_has_any(a.treatment_markets, b.control_markets) OR list_has_any(a.control_markets, b.treatment_markets)""")
def plan_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.conflict_pairs(candidates(spark, d))


@query("plan_solution")
def plan_solution(spark: SparkSession, d: str) -> DataFrame:
    """The best set of candidates, one a test, by branch and bound."""
    rows = candidates(spark, d).collect()
    cs = [portfolio.Candidate(r["candidate_id"], r["test_name"], r["start_date"], r["end_date"], frozenset(r["treatment_markets"]), frozenset(r["control_markets"]), r["score"]) for r in rows]
    s = portfolio.solve(cs, most_controls=3)
    return spark.createDataFrame([(c.test_name, c.candidate_id, float(c.score)) for c in s["selected"]] or [], "test_name string, candidate_id string, score double")


@query("plan_calendar", f"""WITH {INTERVALS_SQL}, w AS (SELECT geo_id, test_id, role, CAST(unnest(generate_series(date_trunc('week', start_date), date_trunc('week', end_date), INTERVAL 7 DAY)) AS DATE) AS week FROM intervals WHERE start_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
SELECT geo_id, week, CASE WHEN bool_or(role = 'treatment') THEN 'treatment' ELSE 'control' END AS state, string_agg(DISTINCT test_id, ',' ORDER BY test_id) AS tests FROM w GROUP BY 1, 2""")
def plan_calendar(spark: SparkSession, d: str) -> DataFrame:
    m = AssignmentMatrix.from_frame(intervals(spark, d).where(F.col("start_date").between("1997-01-01", "1997-12-31")))
    return reports.calendar_cells(m.df)


@query("report_weekly_series", f"""WITH {EVENTS_SQL}, x AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-15', CAST(date AS DATE)) / 7.0) AS INTEGER) AS bin, geo_id IN ('1', '4', '7') AS treated, geo_id, sum(orders) AS s, count(DISTINCT date) AS days FROM events_panel GROUP BY 1, 2, 3),
a AS (SELECT bin, avg(s / days) FILTER (treated) AS treatment, avg(s / days) FILTER (NOT treated) AS control FROM x GROUP BY 1)
SELECT bin, round(100 * treatment / avg(treatment) FILTER (bin < 0) OVER (), 6) AS treatment, round(100 * control / avg(control) FILTER (bin < 0) OVER (), 6) AS control FROM a""")
def report_weekly_series(spark: SparkSession, d: str) -> DataFrame:
    """Seven-day bins from the test's start, indexed to the mean before it."""
    s = reports.binned_series(events_panel(spark, d), ["1", "4", "7"], "orders", date(2024, 1, 15))
    return s.withColumns({c: F.round(c, 6) for c in ("treatment", "control")})


@query("report_smoothed", f"WITH {EVENTS_SQL} SELECT geo_id, date, round(avg(revenue) OVER (PARTITION BY geo_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM events_panel")
def report_smoothed(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("geo_id").orderBy("date").rowsBetween(-3, 3)
    return events_panel(spark, d).df.select("geo_id", "date", F.round(F.avg("revenue").over(w), 6).alias("smoothed"))


@query("report_region_totals", f"""WITH {ITEMS_SQL} SELECT r_name AS region, count(*) AS markets FROM (SELECT unnest(treatment_markets) AS m FROM items) JOIN nation ON m = CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def report_region_totals(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = items(spark, d).select(F.explode("treatment_markets").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n_nationkey").cast("string"))
    return m.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("markets"))
