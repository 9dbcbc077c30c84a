"""Queries of estimators, inference and market design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralift.operators import estimators, inference, markets, power
from terralift.operators.design import geo_periods, observed_summary, prepared
from terralift.plans.panels import CONTROL, DISCOUNT, END, EVENTS_SQL, LINEITEM_SQL, ORDERS, ORDERS_SQL, PREPARED_SQL, REVENUE, START, TREATED, design, events_panel, lineitem_panel, orders_panel, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def frame(spark: SparkSession, d: str) -> DataFrame:
    return prepared(orders_panel(spark, d), design(), REVENUE)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


CELLS = "avg(CASE WHEN treated = 1 THEN pre END) AS treatment_pre, avg(CASE WHEN treated = 1 THEN post END) AS treatment_post, avg(CASE WHEN treated = 0 THEN pre END) AS control_pre, avg(CASE WHEN treated = 0 THEN post END) AS control_post"


@query("did_two_by_two", f"""WITH {PREPARED_SQL}, c AS (SELECT {CELLS} FROM geo_periods WHERE pre IS NOT NULL AND post IS NOT NULL), e AS (SELECT *, (treatment_post - treatment_pre) - (control_post - control_pre) AS did FROM c)
SELECT round(treatment_pre, 4) AS treatment_pre, round(treatment_post, 4) AS treatment_post, round(control_pre, 4) AS control_pre, round(control_post, 4) AS control_post, round(did, 4) AS did, round(did / abs(treatment_post - did), 8) AS relative_lift FROM e""")
def did_two_by_two(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: difference in differences of revenue by nation and month, with the lift against the counterfactual."""
    row = estimators.two_by_two(frame(spark, d)).withColumn("relative_lift", F.round(F.col("did") / F.abs(F.col("treatment_post") - F.col("did")), 8))
    return rounded(row, 4, "treatment_pre", "treatment_post", "control_pre", "control_post", "did")


@query("did_observed_summary", f"""WITH {PREPARED_SQL}, x AS (SELECT treated, post, avg(outcome) AS a, sum(outcome) AS s FROM prepared GROUP BY 1, 2)
SELECT round(max(CASE WHEN treated = 1 AND post = 0 THEN a END), 4) AS treatment_pre, round(max(CASE WHEN treated = 1 AND post = 1 THEN a END), 4) AS treatment_post, round(max(CASE WHEN treated = 0 AND post = 0 THEN a END), 4) AS control_pre, round(max(CASE WHEN treated = 0 AND post = 1 THEN a END), 4) AS control_post, round(max(CASE WHEN treated = 1 AND post = 1 THEN s END), 2) AS treatment_post_total FROM x""")
def did_observed_summary(spark: SparkSession, d: str) -> DataFrame:
    row = observed_summary(orders_panel(spark, d), design(), REVENUE)
    return row.select(*[F.round(c, 4).alias(c) for c in ("treatment_pre", "treatment_post", "control_pre", "control_post")], F.round("treatment_post_total", 2).alias("treatment_post_total"))


@query("did_geo_welch", f"""WITH {PREPARED_SQL}, x AS (SELECT treated, post - pre AS delta FROM geo_periods WHERE pre IS NOT NULL AND post IS NOT NULL),
m AS (SELECT avg(delta) FILTER (treated = 1) - avg(delta) FILTER (treated = 0) AS estimate, var_samp(delta) FILTER (treated = 1) / count(*) FILTER (treated = 1) AS vt, var_samp(delta) FILTER (treated = 0) / count(*) FILTER (treated = 0) AS vc, count(*) FILTER (treated = 1) AS n_treated, count(*) FILTER (treated = 0) AS n_control FROM x)
SELECT round(estimate, 4) AS estimate, round(sqrt(vt + vc), 4) AS standard_error, round((vt + vc) ** 2 / (vt ** 2 / (n_treated - 1) + vc ** 2 / (n_control - 1)), 6) AS df, n_treated, n_control FROM m""")
def did_geo_welch(spark: SparkSession, d: str) -> DataFrame:
    g = geo_periods(frame(spark, d)).withColumn("all", F.lit(1))
    w = inference.welch_by(g, ["all"], "delta", "treated").drop("all")
    return rounded(rounded(w, 4, "estimate", "standard_error"), 6, "df")


@query("did_parallel_trends", f"""WITH {PREPARED_SQL}, p AS (SELECT time, avg(outcome) FILTER (treated = 1) AS t, avg(outcome) FILTER (treated = 0) AS c, date_diff('day', DATE '1970-01-01', CAST(time AS DATE)) AS day FROM prepared WHERE post = 0 GROUP BY 1)
SELECT round(regr_slope(t, day), 6) AS treatment_slope, round(regr_slope(c, day), 6) AS control_slope, round(regr_slope(t - c, day), 6) AS gap_slope, count(*) AS n FROM p WHERE t IS NOT NULL AND c IS NOT NULL""")
def did_parallel_trends(spark: SparkSession, d: str) -> DataFrame:
    r = estimators.parallel_trends(frame(spark, d))
    return spark.createDataFrame([(round(r["treatment_slope"], 6), round(r["control_slope"], 6), round(r["gap_slope"], 6), r["n"])], "treatment_slope double, control_slope double, gap_slope double, n long")


RATIO = "(sum(n_post) FILTER (treated = 1) / sum(d_post) FILTER (treated = 1) - sum(n_pre) FILTER (treated = 1) / sum(d_pre) FILTER (treated = 1)) - (sum(n_post) FILTER (treated = 0) / sum(d_post) FILTER (treated = 0) - sum(n_pre) FILTER (treated = 0) / sum(d_pre) FILTER (treated = 0))"


def ratio_cells(spark: SparkSession, d: str) -> DataFrame:
    return estimators.ratio_cells(lineitem_panel(spark, d), design(), DISCOUNT)


@query("ratio_did", f"WITH {LINEITEM_SQL} SELECT round({RATIO}, 10) AS ratio_did FROM ratio_cells")
def ratio_did(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.ratio_did(ratio_cells(spark, d)), 10, "ratio_did")


@query("ratio_did_jackknife", f"WITH {LINEITEM_SQL}, l AS (SELECT a.geo AS geo, b.* EXCLUDE (geo) FROM ratio_cells a JOIN ratio_cells b ON a.geo <> b.geo) SELECT geo, round({RATIO}, 9) AS ratio_did FROM l GROUP BY 1")
def ratio_did_jackknife(spark: SparkSession, d: str) -> DataFrame:
    return rounded(estimators.ratio_did_jackknife(ratio_cells(spark, d)), 9, "ratio_did")


@query("ratio_did_bootstrap")
def ratio_did_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """A thousand market bootstraps as one join of draws with the cells' sums."""
    _, drawn, _ = estimators.bootstrap_statistics(lineitem_panel(spark, d), design(), DISCOUNT, 1000)
    return drawn


@query("did_bootstrap_fixed_draws", f"""WITH {PREPARED_SQL}, u AS (SELECT geo, treated, post - pre AS delta, row_number() OVER (PARTITION BY treated ORDER BY geo) - 1 AS slot, count(*) OVER (PARTITION BY treated) AS size FROM geo_periods WHERE pre IS NOT NULL AND post IS NOT NULL),
p AS (SELECT r.range AS draw, u.treated, (r.range * 7919 + u.slot * 104729 + (r.range * u.slot) % 31) % u.size AS pick FROM range(200) r, u)
SELECT draw, round(avg(u.delta) FILTER (u.treated = 1) - avg(u.delta) FILTER (u.treated = 0), 4) AS estimate FROM p JOIN u ON u.treated = p.treated AND u.slot = p.pick GROUP BY 1""")
def did_bootstrap_fixed_draws(spark: SparkSession, d: str) -> DataFrame:
    """Market bootstrap whose draws come from whole-number arithmetic that SQL engines share."""
    g = geo_periods(frame(spark, d)).select("geo", "treated", "delta")
    w = Window.partitionBy("treated")
    u = g.withColumns({"slot": (F.row_number().over(w.orderBy("geo")) - 1).cast("long"), "size": F.count(F.lit(1)).over(w)})
    draws = spark.range(200).withColumnRenamed("id", "draw").crossJoin(F.broadcast(u.select("treated", "slot", "size")))
    pick = (F.col("draw") * 7919 + F.col("slot") * 104729 + (F.col("draw") * F.col("slot")) % 31) % F.col("size")
    rows = draws.select("draw", "treated", pick.alias("slot")).join(F.broadcast(u.select("treated", "slot", "delta")), ["treated", "slot"])
    return rows.groupBy("draw").agg(F.round(F.avg(F.when(F.col("treated") == 1, F.col("delta"))) - F.avg(F.when(F.col("treated") == 0, F.col("delta"))), 4).alias("estimate"))


@query("tbr_effect", f"""WITH {PREPARED_SQL}, s AS (SELECT time, post, sum(outcome) FILTER (treated = 1) AS t, sum(outcome) FILTER (treated = 0) AS c FROM prepared GROUP BY 1, 2),
f AS (SELECT regr_slope(t, c) AS slope, regr_intercept(t, c) AS intercept FROM s WHERE post = 0 AND t IS NOT NULL AND c IS NOT NULL)
SELECT round(any_value(slope), 8) AS slope, round(any_value(intercept), 3) AS intercept, round(sum(t - slope * c - intercept), 2) AS effect FROM s, f WHERE post = 1 AND t IS NOT NULL AND c IS NOT NULL""")
def tbr_effect(spark: SparkSession, d: str) -> DataFrame:
    s = estimators.arm_series(orders_panel(spark, d), design(), REVENUE).where("treatment is not null and control is not null")
    return estimators.tbr_terms(s).select(F.round("slope", 8).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("effect", 2).alias("effect"))


@query("iroas_effects", f"""WITH {LINEITEM_SQL}, x AS (SELECT geo_id AS geo, CAST(CAST(geo_id AS INTEGER) < 5 AS INTEGER) AS treated, date >= DATE '{START}' AS post, date, gross, discounted FROM lineitem_panel WHERE date <= DATE '{END}' AND CAST(geo_id AS INTEGER) < 25),
n AS (SELECT count(DISTINCT date) FILTER (NOT post) AS np, count(DISTINCT date) FILTER (post) AS nq FROM x)
SELECT geo, treated, round(coalesce(sum(gross) FILTER (post), 0) - coalesce(sum(gross) FILTER (NOT post), 0) / np * nq, 2) AS response, round(coalesce(sum(discounted) FILTER (post), 0) - coalesce(sum(discounted) FILTER (NOT post), 0) / np * nq, 2) AS spend FROM x, n GROUP BY 1, 2, np, nq""")
def iroas_effects(spark: SparkSession, d: str) -> DataFrame:
    e = estimators.spend_effects(lineitem_panel(spark, d), design(), "gross", "discounted")
    return rounded(e.drop("pre_response"), 2, "response", "spend")


@query("estimator_suite")
def estimator_suite(spark: SparkSession, d: str) -> DataFrame:
    """Every estimator on monthly revenue; those that the data can't support are rows with their error."""
    got = estimators.fit_all(orders_panel(spark, d), design(), [REVENUE], list(estimators.ESTIMATORS))
    low = lambda e, k: None if e.interval is None else float(e.interval[k])
    rows = [(e.estimator, e.metric, None if e.error else float(e.estimate), low(e, 0), low(e, 1), e.p_value, e.relative_lift, e.error) for e in got]
    return spark.createDataFrame(rows, "estimator string, metric string, estimate double, low double, high double, p_value double, relative_lift double, error string")


@query("paired_iroas")
def paired_iroas(spark: SparkSession, d: str) -> DataFrame:
    e = estimators.paired_iroas(lineitem_panel(spark, d), design(), "gross", "discounted", draws=200)
    return spark.createDataFrame([(e.estimate, e.p_value, e.diagnostics["denominator_risk"], e.diagnostics["sign_test"])], "iroas double, p_value double, risk string, sign_test double")


# ---- inference -----------------------------------------------------------------------------------------------

DAILY_SQL = f"""{EVENTS_SQL}, daily AS (SELECT geo_id, date, least(1.0, orders / 10.0) AS x FROM events_panel)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events_panel(spark, d).df.select("geo_id", "date", F.least(F.lit(1.0), F.col("orders") / 10.0).alias("x"))


@query("sequential_confidence", f"""WITH {DAILY_SQL}, r AS (SELECT geo_id, date, row_number() OVER w AS look, avg(x) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM daily WINDOW w AS (PARTITION BY geo_id ORDER BY date))
SELECT geo_id, date, look, round(mean, 9) AS mean, round(greatest(mean - sqrt(ln(2 * look * (look + 1) / 0.05) / (2 * look)), 0), 9) AS lower, round(least(mean + sqrt(ln(2 * look * (look + 1) / 0.05) / (2 * look)), 1), 9) AS upper FROM r""")
def sequential_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.confidence_sequence(daily(spark, d), ["geo_id"], "date", "x", 0.0, 1.0), 9, "mean", "lower", "upper")


@query("sequential_e_values", f"""WITH {DAILY_SQL}, r AS (SELECT geo_id, date, row_number() OVER w AS look, exp(sum(x - 0.2) OVER (w ROWS UNBOUNDED PRECEDING) - row_number() OVER w / 8.0) AS e FROM daily WINDOW w AS (PARTITION BY geo_id ORDER BY date))
SELECT geo_id, date, look, round(e, 8) AS e_value, round(least(1.0, 1 / max(e) OVER (PARTITION BY geo_id ORDER BY look ROWS UNBOUNDED PRECEDING)), 8) AS p_value FROM r""")
def sequential_e_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.e_values(daily(spark, d), ["geo_id"], "date", "x", 0.0, 1.0, null=0.2), 8, "e_value", "p_value")


P_SQL = f"""{ORDERS_SQL}, ps AS (SELECT CAST(geo_id AS INTEGER) % 4 AS family, geo_id AS hypothesis, (sum(orders) % 97 + 1) / 2000.0 AS p FROM orders_panel GROUP BY geo_id)"""


def p_values(spark: SparkSession, d: str) -> DataFrame:
    return orders_panel(spark, d).df.groupBy(F.col("geo_id").alias("hypothesis")).agg(((F.sum("orders") % 97 + 1) / 2000.0).alias("p")).withColumn("family", F.col("hypothesis").cast("int") % 4)


@query("multiplicity_holm", f"""WITH {P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS r, count(*) OVER (PARTITION BY family) AS m FROM ps)
SELECT family, hypothesis, p, round(least(1.0, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY r ROWS UNBOUNDED PRECEDING)), 10) AS adjusted FROM r""")
def multiplicity_holm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.adjusted(p_values(spark, d), "p", ["family"], "hypothesis", "holm"), 10, "adjusted")


@query("multiplicity_bh", f"""WITH {P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS r, count(*) OVER (PARTITION BY family) AS m FROM ps)
SELECT family, hypothesis, p, round(least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 10) AS adjusted FROM r""")
def multiplicity_bh(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.adjusted(p_values(spark, d), "p", ["family"], "hypothesis", "bh"), 10, "adjusted")


@query("multiplicity_bonferroni", f"WITH {P_SQL} SELECT family, hypothesis, p, round(least(1.0, p * count(*) OVER (PARTITION BY family)), 10) AS adjusted FROM ps")
def multiplicity_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.adjusted(p_values(spark, d), "p", ["family"], "hypothesis", "bonferroni"), 10, "adjusted")


DRAWS_SQL = f"""{EVENTS_SQL}, obs AS (SELECT geo_id AS hypothesis, avg(orders) - 1.5 AS statistic FROM events_panel GROUP BY 1), draws AS (SELECT date AS draw, geo_id AS hypothesis, orders - avg(orders) OVER (PARTITION BY geo_id) AS statistic FROM events_panel)"""


@query("multiplicity_max_t", f"""WITH {DRAWS_SQL}, k AS (SELECT hypothesis, abs(statistic) AS seen, row_number() OVER (ORDER BY abs(statistic) DESC, hypothesis) AS rank FROM obs),
j AS (SELECT draw, k.hypothesis, seen, rank, max(abs(statistic)) OVER (PARTITION BY draw ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS most FROM draws JOIN k USING (hypothesis)),
p AS (SELECT hypothesis, seen, rank, (count(*) FILTER (most >= seen - 1e-12) + 1) / (count(*) + 1) AS p FROM j GROUP BY 1, 2, 3)
SELECT hypothesis, round(seen, 9) AS seen, CAST(rank AS INTEGER) AS rank, round(max(p) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 10) AS adjusted FROM p""")
def multiplicity_max_t(spark: SparkSession, d: str) -> DataFrame:
    e = events_panel(spark, d).df
    obs = e.groupBy(F.col("geo_id").alias("hypothesis")).agg((F.avg("orders") - 1.5).alias("statistic"))
    draws = e.select(F.col("date").alias("draw"), F.col("geo_id").alias("hypothesis"), (F.col("orders") - F.avg("orders").over(Window.partitionBy("geo_id"))).alias("statistic"))
    return rounded(rounded(inference.max_t_stepdown(obs, draws), 9, "seen"), 10, "adjusted")


@query("randomization_exact", f"""WITH {EVENTS_SQL}, u AS (SELECT geo_id, sum(revenue) AS y, CAST(geo_id AS INTEGER) AS i, CAST(geo_id IN ('1', '4', '7') AS INTEGER) AS z FROM events_panel GROUP BY 1)
SELECT m.range AS assignment, round(avg(y) FILTER ((m.range >> i) & 1 = 1) - avg(y) FILTER ((m.range >> i) & 1 = 0), 4) AS statistic, m.range = (SELECT CAST(sum(z * (1 << i)) AS BIGINT) FROM u) AS observed
FROM range(1024) m, u WHERE bit_count(m.range) = 3 GROUP BY 1""")
def randomization_exact(spark: SparkSession, d: str) -> DataFrame:
    u = events_panel(spark, d).df.groupBy("geo_id").agg(F.sum("revenue").alias("y")).withColumn("z", F.col("geo_id").isin("1", "4", "7").cast("int"))
    return rounded(inference.randomization_by(u, "geo_id", "y", "z"), 4, "statistic")


@query("long_run_variance", f"""WITH {EVENTS_SQL}, x AS (SELECT geo_id, date, orders - avg(orders) OVER (PARTITION BY geo_id) AS x FROM events_panel),
l AS (SELECT geo_id, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM x WINDOW w AS (PARTITION BY geo_id ORDER BY date))
SELECT geo_id, round(greatest((sum(x * x) + 2 * 0.75 * sum(x * l1) + 2 * 0.5 * sum(x * l2) + 2 * 0.25 * sum(x * l3)) / count(*), 0), 8) AS variance FROM l GROUP BY 1""")
def long_run_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.long_run_variance_by(events_panel(spark, d).df, ["geo_id"], "date", "orders", 3), 8, "variance")


# ---- market design -------------------------------------------------------------------------------------------


@query("market_features", f"""WITH {ORDERS_SQL} SELECT geo_id AS geo, round(avg(revenue), 4) AS revenue_mean, round(stddev_samp(revenue), 4) AS revenue_std, round(sum(revenue), 2) AS revenue_total, round(regr_slope(revenue, date_diff('day', DATE '1970-01-01', CAST(date AS DATE))), 6) AS revenue_trend FROM orders_panel GROUP BY 1""")
def market_features(spark: SparkSession, d: str) -> DataFrame:
    f = markets.market_features(orders_panel(spark, d), metrics=["revenue"])
    return rounded(rounded(rounded(f, 4, "revenue_mean", "revenue_std"), 2, "revenue_total"), 6, "revenue_trend")


FEATURES_SQL = f"""{ORDERS_SQL}, f AS (SELECT geo_id AS geo, avg(revenue) AS revenue_mean, avg(orders) AS orders_mean FROM orders_panel GROUP BY 1),
z AS (SELECT geo, (revenue_mean - avg(revenue_mean) OVER ()) / stddev_pop(revenue_mean) OVER () AS a, (orders_mean - avg(orders_mean) OVER ()) / stddev_pop(orders_mean) OVER () AS b FROM f)"""


def two_features(spark: SparkSession, d: str) -> DataFrame:
    f = markets.market_features(orders_panel(spark, d), metrics=["revenue", "orders"])
    return f.select("geo", "revenue_mean", "orders_mean")


@query("market_distances", f"WITH {FEATURES_SQL} SELECT x.geo AS a, y.geo AS b, round(sqrt(((x.a - y.a) ** 2 + (x.b - y.b) ** 2) / 2), 8) AS distance FROM z x JOIN z y ON x.geo < y.geo")
def market_distances(spark: SparkSession, d: str) -> DataFrame:
    z = markets.standardized(two_features(spark, d), ["revenue_mean", "orders_mean"])
    return rounded(markets.pair_distances(z, ["revenue_mean", "orders_mean"]), 8, "distance")


@query("market_balance", f"""WITH {FEATURES_SQL}, l AS (SELECT geo, 'revenue_mean' AS feature, revenue_mean AS v FROM f UNION ALL SELECT geo, 'orders_mean', orders_mean FROM f),
b AS (SELECT feature, avg(v) FILTER (CAST(geo AS INTEGER) < 5) - avg(v) FILTER (CAST(geo AS INTEGER) >= 5) AS gap, var_samp(v) FILTER (CAST(geo AS INTEGER) < 5) AS vt, var_samp(v) FILTER (CAST(geo AS INTEGER) >= 5) AS vc FROM l GROUP BY 1)
SELECT feature, round(gap / sqrt((vt + vc) / 2), 8) AS smd, round(vt / vc, 8) AS variance_ratio FROM b""")
def market_balance(spark: SparkSession, d: str) -> DataFrame:
    b = markets.balance(two_features(spark, d), TREATED, ["revenue_mean", "orders_mean"])
    return rounded(b.drop("warn"), 8, "smd", "variance_ratio")


@query("market_pairs")
def market_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = markets.matched_pairs(orders_panel(spark, d), metrics=["revenue", "orders"])
    return spark.createDataFrame(found, "a string, b string, distance double")


@query("market_supergeos")
def market_supergeos(spark: SparkSession, d: str) -> DataFrame:
    v = orders_panel(spark, d).df.groupBy(F.col("geo_id").alias("geo")).agg(F.sum("revenue").alias("volume"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("geo"), F.col("n_regionkey").alias("region"))
    return markets.supergeos(v.join(n, "geo"), group=["region"])


@query("market_contamination", """WITH e AS (SELECT CAST(a.n_nationkey AS VARCHAR) AS a, CAST(b.n_nationkey AS VARCHAR) AS b, 0.5 AS weight FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT b AS geo, round(sum(weight), 6) AS exposure FROM e WHERE CAST(a AS INTEGER) < 5 AND CAST(b AS INTEGER) BETWEEN 5 AND 24 GROUP BY 1""")
def market_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Exposure of each control to treated nations of its region."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("g"), "n_regionkey")
    e = n.select(F.col("g").alias("a"), "n_regionkey").join(n.select(F.col("g").alias("b"), "n_regionkey"), "n_regionkey").where("a < b").select("a", "b", F.lit(0.5).alias("weight"), F.lit(None).cast("double").alias("distance"))
    return rounded(markets.MarketGraph(e).exposures(TREATED, CONTROL), 6, "exposure")


@query("market_volume_strata", f"WITH {ORDERS_SQL}, v AS (SELECT geo_id, sum(revenue) AS volume FROM orders_panel GROUP BY 1) SELECT geo_id, CAST(ntile(4) OVER (ORDER BY volume DESC, geo_id) AS INTEGER) AS stratum FROM v")
def market_volume_strata(spark: SparkSession, d: str) -> DataFrame:
    v = orders_panel(spark, d).df.groupBy("geo_id").agg(F.sum("revenue").alias("volume"))
    return v.select("geo_id", F.ntile(4).over(Window.orderBy(F.desc("volume"), "geo_id")).alias("stratum"))


# ---- power ---------------------------------------------------------------------------------------------------


@query("placebo_windows", f"WITH {EVENTS_SQL}, t AS (SELECT DISTINCT CAST(date AS DATE) AS day FROM events_panel) SELECT a.day AS start, a.day + 6 AS \"end\" FROM t a JOIN t b ON b.day = a.day + 6 ORDER BY 1 DESC LIMIT 10")
def placebo_windows(spark: SparkSession, d: str) -> DataFrame:
    times = events_panel(spark, d).df.select(F.col("date").alias("time"))
    return power.placebo_windows(times, 7, 10).select("start", "end")


@query("power_daily_arms", f"WITH {EVENTS_SQL} SELECT date AS time, CAST(sum(orders) FILTER (geo_id IN ('1', '4', '7')) AS DOUBLE) AS treatment, CAST(sum(orders) FILTER (geo_id IN ('0', '2', '3')) AS DOUBLE) AS control FROM events_panel GROUP BY 1")
def power_daily_arms(spark: SparkSession, d: str) -> DataFrame:
    return power.daily_arms(events_panel(spark, d), ORDERS, ["1", "4", "7"], ["0", "2", "3"])


@query("power_detection_curve")
def power_detection_curve(spark: SparkSession, d: str) -> DataFrame:
    return power.detection_curve(events_panel(spark, d), ORDERS, ["1", "4", "7"], ["0", "2", "3"], 7, [0.0, 0.1, 0.25, 0.5, 1.0, 2.0])
