"""Queries of assignments, registry, stored artefacts and small rules, held to SQL or to values worked out by hand."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.functions import linear
from terralift.functions.metrics import CountMetric, MetricCatalog, RatioMetric, delta_method_difference, metric_info
from terralift.functions.stats import binomial_two_sided
from terralift.operators import analysis, contracts, estimators, inference, markets, portfolio, power, reports
from terralift.operators import candidates as designs
from terralift.operators import report_payloads as payloads
from terralift.operators.assignments import AssignmentMatrix, classify_usage
from terralift.operators.panel import GeoPanel
from terralift.operators.registry_store import ExperimentRegistry
from terralift.operators.specs import EstimatorSuiteSpec, FrameworkSpec, InferenceEngineSpec, PortfolioDecisionSpec, RoadmapDefaults, RoadmapSpec
from terralift.plans.panels import ORDERS_SQL, orders_panel
from terralift.plans.portfolio_queries import CANDIDATES_SQL, candidates
from terralift.sources.synthetic import Lift, generate_panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def fixed(values: dict[str, float]) -> str:
    """Expected values as SQL rows."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({round(float(v), 8)} AS DOUBLE))" for k, v in values.items()) + ") t(name, value)"


def facts(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), 8)) for k, v in values.items()], "name string, value double")


def folder(spark: SparkSession) -> str:
    """A fresh folder, in the shared one if the session names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = shared.removeprefix("file://") if shared else tempfile.gettempdir()
    return f"{base.rstrip('/')}/terralift-{uuid.uuid4().hex}"


# ---- assignments ---------------------------------------------------------------------------------------------


@query("assignment_of_candidates", f"""WITH {CANDIDATES_SQL}, x AS (SELECT test_name AS test_id, unnest(treatment_markets) AS geo_id, 'treatment' AS role, start_date, end_date FROM candidates UNION ALL SELECT test_name, unnest(control_markets), 'control', start_date, end_date FROM candidates)
SELECT test_id, geo_id, role, min(start_date) AS start_date, max(end_date) AS end_date FROM x GROUP BY 1, 2, 3""")
def assignment_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    return AssignmentMatrix.from_candidates(candidates(spark, d)).intervals()


MEMBERS = [{"test_id": "a", "geo_id": "m1", "role": "treatment", "start_date": "2027-04-01", "end_date": "2027-04-03"}, {"test_id": "a", "geo_id": "m2", "role": "control", "start_date": "2027-04-01", "end_date": "2027-04-07"}, {"test_id": "b", "geo_id": "m2", "role": "control", "start_date": "2027-04-03", "end_date": "2027-04-10"}]


@query("assignment_rules", "SELECT * FROM (VALUES ('dates', '18'), ('m1 on 04-02', 'treatment'), ('m1 on 04-05', 'none'), ('usage', 'shared_controls'), ('most', '2'), ('usage of one at most', 'invalid_shared_control_usage'), ('with a second treatment', 'invalid_treatment_overlap'), ('with a treated control', 'invalid_treatment_control_conflict'), ('validate', 'passes'), ('validate without sharing', 'raises')) t(rule, value)")
def assignment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Roles, usage classes and validation of a small matrix."""
    m = AssignmentMatrix.from_records(spark, MEMBERS)
    more = lambda geo: AssignmentMatrix.from_records(spark, [{**MEMBERS[0], "test_id": "c", "geo_id": geo}])
    m.validate()
    try:
        m.validate(allow_shared=False)
        said = "passes"
    except contracts.ValidationError:
        said = "raises"
    rows = [("dates", str(m.dates().count())), ("m1 on 04-02", m.market_role("a", "m1", "2027-04-02")), ("m1 on 04-05", m.market_role("a", "m1", "2027-04-05") or "none"), ("usage", classify_usage(m).usage), ("most", str(m.max_shared_control_usage())), ("usage of one at most", classify_usage(m, most_shared=1).usage), ("with a second treatment", classify_usage(m, more("m1")).usage), ("with a treated control", classify_usage(m.combine(more("m2"))).usage), ("validate", "passes"), ("validate without sharing", said)]
    return spark.createDataFrame(rows, "rule string, value string")


# ---- registry ------------------------------------------------------------------------------------------------


@query("registry_store", "SELECT * FROM (VALUES ('experiments', 'e1,e2,e3,e4'), ('planned', 'e2,e4'), ('added', '2 5'), ('imported', '1 2'), ('dry', '1 2'), ('treated in June', 'm1'), ('control in June', 'm2,m3'), ('not for control', 'm1'), ('cooling in July', 'm1'), ('blocked', 'x:m1'), ('artifact', 'report'), ('conflict', 'raises')) t(what, value)")
def registry_store(spark: SparkSession, d: str) -> DataFrame:
    """Writes, imports, blocks and artefacts of a registry in a fresh folder."""
    r = ExperimentRegistry(spark, folder(spark))
    record = lambda i, t, c, status="planned", **more: {"experiment_id": i, "start_date": "2027-06-01", "end_date": "2027-06-20", "treatment_geos": t, "control_geos": c, "status": status, **more}
    added = r.add_experiments([record("e1", ["m1"], ["m2", "m3"], "active", cooldown_until="2027-07-15"), record("e3", ["m5"], ["m6"], "completed")])
    r.add_planned(record("e2", ["m7"], ["m2"], "active"))
    rows = spark.createDataFrame([("e4", "m8", "Treated", "2027-08-01", "2027-08-09"), ("e4", "m9", "holdout", "2027-08-01", "2027-08-09")], "experiment_id string, geo_id string, role string, start_date string, end_date string")
    imported = r.import_assignments(rows)
    dry = r.add_experiment(record("e5", ["m1"], ["m4"]), dry_run=True)
    try:
        r.add_experiment(record("e6", ["m2"], ["m4"], "active"))
        said = "passes"
    except contracts.ValidationError:
        said = "raises"
    r.add_artifact("e1", "report", "e1.html", {"bytes": 3})
    x = portfolio.Candidate("x", "x", date(2027, 6, 5), date(2027, 6, 9), frozenset(["m1"]), frozenset(["m4"]), 1.0)
    ids = lambda df: ",".join(v["experiment_id"] for v in df.collect())
    june = ("2027-06-10", "2027-06-12")
    out = [("experiments", ids(r.list_experiments())), ("planned", ids(r.list_experiments(["planned"]))), ("added", f"{added['experiments']} {added['assignments']}"), ("imported", f"{imported['experiments']} {imported['assignments']}"), ("dry", f"{dry['experiments']} {dry['assignments']}"), ("treated in June", ",".join(r.active_treatment_blocks(*june))), ("control in June", ",".join(r.active_control_blocks(*june))), ("not for control", ",".join(r.markets_blocked_from_control(*june))), ("cooling in July", ",".join(r.cooldown_blocks("2027-07-01"))), ("blocked", ";".join(f"{k}:{','.join(v)}" for k, v in portfolio.blocked_candidates([x], r).items())), ("artifact", r.artifacts("e1").first()["artifact_type"]), ("conflict", said)]
    return spark.createDataFrame(out, "what string, value string")


# ---- sources and files ---------------------------------------------------------------------------------------


@query("panel_sources", f"""WITH {ORDERS_SQL}, s AS (SELECT sum(orders) AS n FROM orders_panel WHERE date >= DATE '1998-01-01' AND geo_id IN ('1', '2'))
SELECT k AS source, CAST(n AS BIGINT) AS orders FROM s, (SELECT unnest(['query', 'table', 'parquet', 'callable', 'adapter']) AS k)""")
def panel_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same markets and dates through every kind of source."""
    p, name, path = orders_panel(spark, d), f"panel_{uuid.uuid4().hex}", folder(spark)
    p.df.createOrReplaceTempView(name)
    p.to_parquet(path)
    how, start, geos = {"validate": False}, "1998-01-01", ["1", "2"]
    made = {
        "query": GeoPanel.from_query(spark, f"SELECT * FROM {name} WHERE geo_id IN (:a, :b)", {"a": "1", "b": "2"}, start=start, **how),
        "table": GeoPanel.from_table(spark, name, "geo_id IN ('1', '2')", **how).slice(start),
        "parquet": GeoPanel.from_parquet(spark, path, ["orders"], **how).slice(start, geos=geos),
        "callable": GeoPanel.from_callable(lambda geos: p.df, geos, start, **how),
        "adapter": GeoPanel.from_adapter(p, geos, start),
    }
    out = None
    for k, v in made.items():
        one = v.aggregate("orders", by=[]).select(F.lit(k).alias("source"), "orders")
        out = one if out is None else out.unionByName(one)
    return out


@query("panel_dates", f"WITH {ORDERS_SQL} SELECT DISTINCT date, (SELECT max(date) FROM orders_panel) AS last FROM orders_panel")
def panel_dates(spark: SparkSession, d: str) -> DataFrame:
    p = orders_panel(spark, d)
    return p.dates().withColumn("last", F.lit(p.time_range()[1]).cast("timestamp"))


@query("synthetic_panel", "SELECT 'geo_' || lpad(CAST(i AS VARCHAR), 3, '0') AS geo_id, CAST(14 AS BIGINT) AS days, CAST(CASE WHEN i <= 2 THEN 35 ELSE 0 END AS BIGINT) AS lifted FROM range(1, 7) t(i)")
def synthetic_panel(spark: SparkSession, d: str) -> DataFrame:
    """Two generated panels of a seed, one with five orders more a day in two markets for a week."""
    lift = Lift(("geo_001", "geo_002"), "2027-01-04", "2027-01-10", 5, mode="absolute")
    a, b = (generate_panel(spark, 6, periods=14, seed=9, lifts=x) for x in (None, [lift]))
    both = a.select("geo_id", "date", F.col("orders").alias("x")).join(b.select("geo_id", "date", F.col("orders").alias("y")), ["geo_id", "date"])
    return both.groupBy("geo_id").agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("y") - F.col("x")).alias("lifted"))


ROUND_TRIPS = {"metrics": 2, "evidence": 2, "solution": 1, "solution score": 7, "manifest files": 1, "report": 1, "plan report": 1, "series": 3, "roadmap tests": 1, "windows": 2, "graph edges": 2}


@query("file_round_trips", fixed(ROUND_TRIPS))
def file_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """What is written comes back: catalogs, evidence, plans, manifests, reports, specifications, graphs."""
    at = Path(folder(spark))
    at.mkdir(parents=True)
    file = lambda n: str(at / n)
    MetricCatalog([CountMetric("orders"), RatioMetric("rate", numerator="orders", denominator="sessions")]).to_file(file("m.json"))
    store = contracts.EvidenceStore()
    for i in (1, 2):
        store.add(contracts.EvidenceRecord(f"t{i}", "orders", 0.1 * i, 0.05, tags=("x",)))
    store.save(file("e.json"))
    c = portfolio.Candidate("c1", "t1", date(2027, 1, 1), date(2027, 1, 28), frozenset(["a"]), frozenset(["b"]), 7.0, {"mde:orders": 0.1})
    solved = portfolio.solve([c])
    contracts.save_solution(solved, file("s.json"))
    back = contracts.load_solution(file("s.json"))
    manifest = portfolio.write_manifest(file("manifest.json"), "plan", [file("s.json")])
    found = [estimators.Estimate("did", "orders", 1.0, (0.5, 1.5), 0.01)]
    payload = reports.analysis_payload("T", found)
    reports.render_analysis(payload, file("a.html"))
    reports.render_plan("P", solved, file("p.html"))
    Path(file("r.json")).write_text(json.dumps(payload))
    payloads.write_visuals(file("r.visuals.json"), "r.json", {"orders": [1, 2, 3]})
    roadmap = {"name": "R", "metrics": {"orders": {"type": "count"}}, "tests": [{"name": "t", "metrics": ["orders"], "treatment_count": 1, "earliest_start": "2027-01-01", "latest_end": "2027-02-11", "blackouts": [{"start": "2027-02-11", "end": "2027-02-12"}]}]}
    Path(file("roadmap.json")).write_text(json.dumps(roadmap))
    Path(file("edges.csv")).write_text("from,to,weight\na,b,0.5\nb,c,1\nc,c,1\n")
    spec = RoadmapSpec.from_file(file("roadmap.json"))
    got = {
        "metrics": len(MetricCatalog.from_file(file("m.json")).select(["rate", "orders"]).metrics), "evidence": len(contracts.EvidenceStore.load(file("e.json")).records), "solution": len(back["selected"]), "solution score": back["selected"][0].score,
        "manifest files": len(manifest["artifacts"]), "report": Path(file("a.html")).read_text().count("<h2>"), "plan report": "c1" in Path(file("p.html")).read_text(), "series": len(payloads.load_analysis(file("r.json"))["series"]["orders"]),
        "roadmap tests": len(spec.tests), "windows": len(designs.starts(spec.tests[0])), "graph edges": markets.MarketGraph.from_path(spark, file("edges.csv")).edges.count(),
    }
    return facts(spark, got)


# ---- plans ---------------------------------------------------------------------------------------------------


@query("plan_best_objective", f"""WITH RECURSIVE {CANDIDATES_SQL}, k AS (SELECT *, round_even(1000 * score, 0) AS v, dense_rank() OVER (ORDER BY test_name) AS t FROM candidates),
x AS (SELECT a.candidate_id, list(b.candidate_id) AS bad FROM k a JOIN k b ON a.t <> b.t AND a.start_date <= b.end_date AND b.start_date <= a.end_date AND (list_has_any(a.treatment_markets, b.treatment_markets) OR list_has_any(a.treatment_markets, b.control_markets) OR list_has_any(a.control_markets, b.treatment_markets)) GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS t, CAST([] AS VARCHAR[]) AS chosen, CAST(0 AS DOUBLE) AS v UNION ALL
  SELECT g.t + 1, CASE WHEN c.candidate_id IS NULL THEN g.chosen ELSE list_append(g.chosen, c.candidate_id) END, g.v + coalesce(c.v, 0)
  FROM g JOIN (SELECT k.t, k.candidate_id, k.v, coalesce(x.bad, CAST([] AS VARCHAR[])) AS bad FROM k LEFT JOIN x USING (candidate_id) UNION ALL SELECT DISTINCT t, NULL, 0, CAST([] AS VARCHAR[]) FROM k) c ON c.t = g.t + 1 AND NOT list_has_any(g.chosen, c.bad))
SELECT round(max(v) / 1000, 3) AS objective, true AS optimal FROM g""")
def plan_best_objective(spark: SparkSession, d: str) -> DataFrame:
    """The best set of candidates, one a test, that can run together; branch and bound to its end."""
    cs = [portfolio.Candidate(r["candidate_id"], r["test_name"], r["start_date"], r["end_date"], frozenset(r["treatment_markets"]), frozenset(r["control_markets"]), r["score"]) for r in candidates(spark, d).collect()]
    s = portfolio.solve(cs)
    return spark.createDataFrame([(round(float(s["objective"]), 3), s["optimal"])], "objective double, optimal boolean")


# ---- rules with values worked out by hand --------------------------------------------------------------------

INFERENCE = {
    "normal low": 1.08007203, "normal high": 8.91992797, "normal p": 0.04550026, "empirical p": 2 / 6, "conformal low": 21, "conformal high": 29, "conformal p": 0.2, "jackknife error": 1.15470054, "long-run variance": 0.0795, "randomization statistic": 3, "randomization p": 2 / 6,
    "covariance": 2, "largest influence": -1, "delta difference": 0.2, "delta error": 0.2236068, "coin": 0.125, "holm a": 0.03, "holm b": 0.06, "holm c": 0.06, "relative low": 0.11111111, "relative high": 0.25, "welch without spread": 1, "inversion p": 0.25, "boot frames": 4,
}


@query("inference_values", fixed(INFERENCE))
def inference_values(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda rows: sum(rows) / len(rows)
    normal = inference.normal_interval(5, 2)
    empirical = inference.empirical_interval(5, [-4, -1, 0, 2, 8], 0.8, "greater")
    conformal = inference.split_conformal([112, 118], [100, 105], [0.5, 1, -1.5, 2], 0.8)
    exact = inference.randomization_test({"a": 4, "b": 3, "c": 1, "d": 0}, ["a", "b"])
    arms = spark.createDataFrame([("t", 2.0, 10.0), ("t", 6.0, 10.0), ("c", 1.0, 10.0), ("c", 3.0, 10.0)], "arm string, n double, d double")
    delta = delta_method_difference(arms, RatioMetric("r", numerator="n", denominator="d"), "arm", "t", "c")
    holm = analysis.apply_multiplicity(spark, [estimators.Estimate("did", m, 1.0, p_value=p) for m, p in (("a", 0.01), ("b", 0.04), ("c", 0.03))], "did", "holm")
    lift = inference.relative_interval((10, 20), 100)
    frames = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, 3.0), ("d", 1, 4.0)], "geo string, arm long, v double")
    drawn = contracts.bootstrap_frames(frames, "geo", "arm", lambda f: float(len(f)), draws=5)
    got = {
        "normal low": normal[0], "normal high": normal[1], "normal p": inference.normal_p_value(2.0, 1.0), "empirical p": empirical.p_value, "conformal low": conformal.interval[0], "conformal high": conformal.interval[1], "conformal p": conformal.p_value, "jackknife error": inference.jackknife([1, 3, 5], mean).standard_error,
        "long-run variance": inference.long_run_variance([1, -0.5, 0.75, -0.25, 0.5], 1), "randomization statistic": inference.difference_in_means({"a": 4, "b": 3, "c": 1, "d": 0}, ["a", "b"]), "randomization p": exact.p_value, "covariance": inference.covariance_from_pairs([(1, 2), (2, 4), (3, 6)]),
        "largest influence": inference.leave_one_out_sensitivity([1, 3, 5], mean)[0]["influence"], "delta difference": delta["estimate"], "delta error": delta["standard_error"], "coin": binomial_two_sided(4, 4), "holm a": holm["a"], "holm b": holm["b"], "holm c": holm["c"], "relative low": lift[0], "relative high": lift[1],
        "welch without spread": inference.welch([2, 2], [2, 2]).p_value, "inversion p": inference.conformal_inversion([5.0], [0.0, 1.0, -1.0]).p_value, "boot frames": drawn.agg(F.avg("value")).first()[0],
    }
    return facts(spark, got)


RULES = {
    "days": 28, "overlap": 5, "no ratio": 0, "finite": 2.5, "alpha": 0.05, "names": 2, "claim passed": 1, "claim failed": 1, "claim inconclusive": 1, "improved": 3, "improved low": 1, "usage limit": 1, "null": -0.1, "greater": 1, "looks": 3, "wider": 9, "calibration": 1, "lift comparable": 1, "spaces": 0, "mde": 0.1, "curve": 2, "variance": 4,
    "covariance": -6, "correlation": 0.5, "alignment": -1, "kept correlation": 0.3, "flags": 2, "actions": 2, "items": 1, "parts": 3, "posterior": 1, "business": 0, "blocks": 1, "primary": 1, "role": 1, "margin": 0.2, "least treated": 5, "rerandomized": 0, "weight": 0.75, "policy": 2, "ratio metric": 1, "family": 1, "consensus": 0.15, "draws": 2,
    "best weight": 0.6, "clears": 1, "crosses": 1, "evidence": 1, "planned effects": 2, "score": 9, "pool mean": 0.2, "solution rows": 2,
}


@query("rule_values", fixed(RULES))
def rule_values(spark: SparkSession, d: str) -> DataFrame:
    """Contracts, decisions, monitoring rules, specifications and payloads on small inputs."""
    d1, d2, d3, d4 = date(2027, 1, 1), date(2027, 1, 28), date(2027, 1, 24), date(2027, 2, 9)
    cover = {"items": 3, "reaching": 1}
    flags = portfolio.risk_flags([], ["m"], [], cover)
    actions = [{"priority": p, "action": "refresh_power", "test_id": t} for p, t in ((4, "a"), (3, "a"), (4, "b"))]
    one = portfolio.Candidate("c1", "t1", d1, d2, frozenset(["a"]), frozenset(["b"]), 7.0, {"mde:orders": 0.1, "mde:rate": 0.3, "priority": 3.0})
    two = portfolio.Candidate("c2", "t2", d1, d2, frozenset(["c"]), frozenset(["b"]), 3.0, {})
    a, b = {"treatment": {"x"}, "control": {"y"}}, {"treatment": {"y"}, "control": {"x"}}
    pairs = spark.createDataFrame([("alpha", "beta", -1.0)], "a string, b string, correlation double")
    cov = contracts.estimate_covariance({"alpha": 4.0, "beta": 9.0}, pairs)
    most = portfolio.most_correlated(spark.createDataFrame([("u", "v", -0.3), ("v", "u", 0.2)], "a string, b string, correlation double")).first()
    did = lambda lift, name: estimators.Estimate(name, "orders", 1.0, (0.5, 1.5), 0.01, relative_lift=lift)
    store = contracts.EvidenceStore([contracts.EvidenceRecord(f"t{i}", "orders", v, 0.1, domain="d") for i, v in ((1, 0.1), (2, 0.3))])
    weights = contracts.ObjectiveWeights(shared_control_risk=1.0)
    inputs = contracts.optimizer_inputs(spark, [one, two], weights)
    solution = contracts.solve_portfolio(spark, [one, two], weights)
    draws = [estimators.Estimate("did", m, 1.0, artifacts={"draws": [1.0, 2.0, 4.0, k]}) for m, k in (("x", 8.0), ("y", 9.0))]
    suite, roles = EstimatorSuiteSpec(primary_estimators={"rate": "cuped"}), PortfolioDecisionSpec(guardrail_metrics=["cost"])
    policy = analysis.assignment_policy("candidate_constrained", analysis.Design.of("e", ["a"], ["b", "c"], d1, d2), allowed=[["a"], ["b"], ["z"]])
    InferenceEngineSpec(methods=["jackknife"], primary_method="jackknife")
    got = {
        "days": contracts.inclusive_days(d1, d2), "overlap": contracts.overlap_days(d1, d2, d3, d4), "no ratio": contracts.safe_ratio(1, 0), "finite": contracts.finite("2.5"), "alpha": contracts.confidence_alpha(0.95), "names": len(contracts.string_list("a, b,")),
        "claim passed": portfolio.claim(True, True)[0] == "passed", "claim failed": portfolio.claim(False, True)[0] == "failed", "claim inconclusive": portfolio.claim(True, False)[0] == "inconclusive", "improved": portfolio.improvement(-3, "decrease")[0], "improved low": portfolio.improvement(-3, "decrease", (-5, -1))[1][0],
        "usage limit": portfolio.control_usage_limit(False, 3), "null": analysis.null_value("non_inferiority", 0.1)[0], "greater": analysis.alternative_of("superiority") == "greater", "looks": len(analysis.planned_looks(10, [0.25, 0.5, 1.0])), "wider": analysis.monitoring_bounds((-1, 9), (-2, 5))[0][1],
        "calibration": analysis.calibration_status_of({"a": {"status": "warning"}, "b": {"status": "pass"}}, True) == "warning", "lift comparable": analysis.Estimand("additive").lift_comparable(analysis.Estimand("ratio")), "spaces": power.placebo_applies("paired_iroas", "space"), "mde": power.mde_from_curve([(0.05, 0.5), (0.1, 0.9)]), "curve": len(power.power_curve({0.1: 0.2, 0.2: 0.9})),
        "variance": portfolio.resolved_variance(None, 2.0, None), "covariance": cov.frame().loc["alpha", "beta"], "correlation": portfolio.covariance_to_correlation(np.array([[4.0, 3.0], [3.0, 9.0]]))[0, 1], "alignment": portfolio.signed_role_alignment(a, b), "kept correlation": most["correlation"], "flags": len(flags), "actions": len(portfolio.deduplicated(actions)),
        "items": len(portfolio.roadmap_items({"selected": [one]})), "parts": portfolio.score_decomposition([one, two])["priority"], "posterior": contracts.posterior_ok(0.96), "business": contracts.business_ok(1.0, 2.0), "blocks": contracts.blocks_decision("guardrail", False, ""), "primary": suite.primary_for("rate") == "cuped", "role": roles.role_of("cost") == "guardrail",
        "margin": FrameworkSpec(test_type="equivalence", margin=0.2).margin_of("orders"), "least treated": RoadmapDefaults().treatment_counts(100)[0], "rerandomized": designs.passes_rerandomization([{"feature": "x", "smd": 0.3, "variance_ratio": 1.0}], 0.25), "weight": designs.metric_weights(["a"], {"b": 3.0}, {"a": 0.1, "b": 0.1})["b"],
        "policy": len(policy.enumerate()), "ratio metric": metric_info({"name": "r", "type": "ratio", "numerator": "n", "denominator": "d"}).kind == "ratio", "family": contracts.MethodRegistry().family("sdid") == "synthetic", "consensus": estimators.consensus([did(0.1, "did"), did(0.2, "tbr")])["median"], "draws": analysis.joint_draws(draws)[1].shape[1],
        "best weight": payloads.top_weights({"a": 0.4, "b": 0.6})[0][1], "clears": payloads.interval_status((0.1, 0.2), "superiority", 0.05) == "clears", "crosses": payloads.interval_status((-0.1, 0.2), "two_sided", 0.0) == "crosses", "evidence": payloads.decision_evidence([did(0.1, "did")])["intervals"],
        "planned effects": len(payloads.planning_payload("P", solution, [one, two])["effects"]), "score": contracts.score_portfolio([one, two], inputs)["total"], "pool mean": store.priors(spark, "orders").first()["mean"], "solution rows": contracts.PortfolioSolution("R", [one]).to_frame(spark).count(),
    }
    return facts(spark, got)


STEPS = {"eta": 0.025, "sparsified": 2 / 3, "held out": 10, "none held out": 0, "half slope": 2, "outliers": 1, "row and column effects": 0, "first fill": 0, "completed": 0, "low risk": 1, "trims": 1, "fit": 0, "features": 1, "dropped": 1, "weekday flags": 9, "names": 1, "default": 7, "nearest": 1, "collapsed": 4}


@query("estimator_steps", fixed(STEPS))
def estimator_steps(spark: SparkSession, d: str) -> DataFrame:
    """Parts of estimators on inputs whose result is known."""
    additive = np.add.outer(np.array([0.0, 1.0, 3.0]), np.array([0.0, 2.0, 5.0, 6.0]))
    seen = np.ones_like(additive, bool)
    hidden = seen.copy()
    hidden[0, 3] = False
    x = np.arange(10.0)
    features, dropped = linear.centred_features({"a": x, "b": np.ones(10)})
    donors = estimators.Donors(np.array([1.0, 2.0, 6.0]), np.array([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]), ["u", "v"], np.array([False, False, True]), [1, 2, 3])
    fit = estimators.pre_fit(x, np.column_stack([x, x + 1]), x)
    estimators.check_pre_fit(fit)
    dates = [date(2027, 1, k) for k in range(1, 15)]
    got = {
        "eta": estimators.eta_of_times(1, 20)[0], "sparsified": estimators.sparsified(np.array([0.6, 0.3, 0.1]))[0], "held out": estimators.validation_periods(40), "none held out": estimators.validation_periods(5), "half slope": estimators.half_slopes(x, 2 * x + 1)[1], "outliers": estimators.outlier_count(np.array([*([0.1, -0.1] * 10), 9.0])),
        "row and column effects": np.abs(estimators.two_way_effects(additive) - additive).max(), "first fill": np.abs(estimators.initial_fill(additive, seen) - additive).max(), "completed": abs(estimators.block_mask_errors(additive, seen, np.array([1]), np.array([False, False, False, True]), lambda m: estimators.soft_impute(additive, m, 1.0, 1, tolerance=1e-12, rounds=5000))[0]) > 0.01,
        "low risk": estimators.denominator_risk(10, 1.0) == "low", "trims": len(estimators.trim_sensitivity([("a", "b", 2.0, 1.0), ("c", "d", 4.0, 2.0), ("e", "f", 1.0, 1.0)], lambda r: 1.0)) == 3, "fit": fit["pre_rmse"], "features": len(features), "dropped": len(dropped), "weekday flags": estimators.calendar_features(dates)[0].shape[1], "names": "sdid" in estimators.estimator_names(),
        "default": len(estimators.default_estimators()), "nearest": estimators.nearest_pairs({"a": 5.0, "b": 1.0, "c": 4.0}, analysis.Design.of("e", ["a"], ["b", "c"], "2027-01-01", "2027-01-02"))[0][1] == "c", "collapsed": estimators.collapsed(donors)[1, 1],
    }
    return facts(spark, got)


@query("portfolio_readiness", "SELECT * FROM (VALUES ('has_valid_interim_inference', 'a', 'b'), ('reportable_decision', 'a,b', ''), ('spillover_diagnostics_ready', '', 'a,b')) t(\"check\", ready, blocked)")
def portfolio_readiness(spark: SparkSession, d: str) -> DataFrame:
    items = spark.createDataFrame([("a", True, False, True), ("b", False, None, True)], "test_id string, has_valid_interim_inference boolean, spillover_diagnostics_ready boolean, reportable_decision boolean")
    return portfolio.method_readiness(items).select("check", F.array_join("ready", ",").alias("ready"), F.array_join("blocked", ",").alias("blocked"))


@query("portfolio_risk", "SELECT CAST(0.04 AS DOUBLE) AS max_p, CAST(0.05 AS DOUBLE) AS max_alpha, CAST(0.3 AS DOUBLE) AS max_false_negative, CAST(30 AS DOUBLE) AS expected_loss")
def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = [("primary", 0.04, 0.05, 0.8, 10.0, "usd"), ("guardrail", 0.6, 0.1, 0.7, 20.0, "usd")]
    r = portfolio.risk_summary(spark.createDataFrame(rows, "role string, adjusted double, alpha double, power double, expected_loss double, unit string"))
    return r.withColumn("max_false_negative", F.round("max_false_negative", 8))
