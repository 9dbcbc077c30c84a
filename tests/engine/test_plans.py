import json
from datetime import date, datetime, timedelta

import pytest

from terralift import cli
from terralift.errors import ValidationError
from terralift.operators import markets, portfolio, reports
from terralift.operators.assignments import AssignmentMatrix, classify_usage
from terralift.operators.candidates import Generator
from terralift.operators.panel import GeoPanel
from terralift.operators.registry_store import ExperimentRegistry
from terralift.operators.specs import RoadmapSpec
from terralift.sources.registry_import import load_registry_import
from terralift.sources.synthetic import balanced_round, generate_panel
from terralift.streaming.monitoring import daily_arms, running_evidence


def row(test, geo, role, start, end):
    return {"test_id": test, "geo_id": geo, "role": role, "start_date": start, "end_date": end}


def test_assignments(spark):
    m = AssignmentMatrix.from_records(spark, [row("a", "g1", "treatment", "2027-04-01", "2027-04-03")])
    assert m.dates().count() == 3
    c = AssignmentMatrix.from_records(spark, [row("a", "c1", "control", "2027-04-01", "2027-04-07"), row("b", "c1", "control", "2027-04-03", "2027-04-10")])
    assert c.max_shared_control_usage() == 2
    assert c.market_role("a", "c1", "2027-04-07") == "control" and c.market_role("a", "c1", "2027-04-08") is None
    both = m.combine(c)
    assert classify_usage(both).usage == "shared_controls"
    assert classify_usage(both, allow_shared=False).usage == "invalid_shared_control_usage"
    clash = both.combine(AssignmentMatrix.from_records(spark, [row("z", "g1", "control", "2027-04-02", "2027-04-02")]))
    assert classify_usage(clash).usage == "invalid_treatment_control_conflict"
    with pytest.raises(ValidationError):
        clash.validate()
    twice = m.combine(AssignmentMatrix.from_records(spark, [row("z", "g1", "treatment", "2027-04-03", "2027-04-09")]))
    assert classify_usage(twice).usage == "invalid_treatment_overlap"
    assert classify_usage(m).usage == "disjoint"


def test_registry(spark, tmp_path):
    reg = ExperimentRegistry(spark, str(tmp_path / "reg"))
    one = {"experiment_id": "e1", "status": "active", "start_date": "2027-01-01", "end_date": "2027-01-31", "treatment_geos": "g1, g2", "control_geos": ["g3"], "cooldown_until": "2027-02-14"}
    assert reg.add_experiment(one, dry_run=True) == {"experiments": 1, "assignments": 3}
    assert reg.list_experiments().count() == 0
    reg.add_experiment(one)
    with pytest.raises(ValidationError):
        reg.add_experiment(one)
    with pytest.raises(ValidationError):
        reg.add_experiment({"experiment_id": "e2", "status": "active", "start_date": "2027-01-15", "end_date": "2027-02-01", "treatment_geos": ["g3"], "control_geos": ["g9"]})
    reg.add_planned({"experiment_id": "e3", "start_date": "2027-01-15", "end_date": "2027-02-01", "treatment_geos": ["g7"], "control_geos": ["g3"]})
    assert reg.active_market_blocks("2027-01-10")["blocked_from_treatment"] == ["g1", "g2", "g3"]
    assert reg.cooldown_blocks("2027-02-01", "2027-02-05") == ["g1", "g2"] and reg.cooldown_blocks("2027-03-01") == []
    assert reg.shared_control_usage("2027-01-01", "2027-01-31").count() == 17
    assert reg.assignments(statuses=[]).count() == 0
    reg.add_artifact("e1", "plan", "file:/x", {"a": 1})
    assert reg.artifacts("e1").count() == 1
    with pytest.raises(ValidationError):
        reg.add_artifact("nope", "plan", "file:/x")
    path = tmp_path / "r.csv"
    path.write_text("experiment_id,name,status,start_date,end_date,role,geo_id,cooldown_until,primary_metrics\ne9,N,active,2027-03-01,2027-03-10,treated,g4,,orders\ne9,N,planned,2027-03-02,2027-03-12,control,g5,2027-03-20,orders\n")
    (e,) = load_registry_import(spark, str(path))
    assert e["status"] == "active" and e["treatment_geos"] == ["g4"] and e["end_date"] == date(2027, 3, 12) and e["cooldown_until"] == date(2027, 3, 20)
    assert reg.import_assignments(str(path)) == {"experiments": 1, "assignments": 2}
    assert reg.get_experiment("e9")["control_geos"] == ["g5"]


def test_markets(spark):
    g = markets.MarketGraph.from_edges(spark, [("m1", "m2", 1.0), ("m3", "m4", 0.5)])
    assert g.contaminated_controls(["m1"], ["m2", "m3", "m4"]) == ["m2"]
    assert g.contamination(["m1"], ["m2", "m3", "m4"])["rate"] == pytest.approx(1 / 3)
    s = markets.MarketGraph.from_edges(spark, [("t", "c1", 0.75), ("t", "c2", 0.25)])
    assert s.spillover(["t"], ["c1", "c2"], 10, [4.0]) == [{"spillover": 4.0, "bias": -2.0, "adjusted": 12.0}]
    rows = [(g, datetime(2027, 1, 1) + timedelta(days=d), r, float(b + d), 10.0 * (b + d)) for g, r, b in (("m1", "East", 10), ("m2", "East", 11), ("m3", "West", 50), ("m4", "West", 53)) for d in range(5)]
    panel = GeoPanel(spark.createDataFrame(rows, "geo_id string, date timestamp, region string, orders double, sessions double"))
    assert [p[:2] for p in markets.matched_pairs(panel, exact=["region"])] == [("m1", "m2"), ("m3", "m4")]
    v = spark.createDataFrame([("m1", 4.0), ("m2", 7.0), ("m3", 12.0)], "geo string, volume double")
    assert sorted(r["markets"] for r in markets.supergeos(v, 10).collect()) == [["m1", "m2"], ["m3"]]
    p = markets.Policy(tuple("abcd"), 2, "stratified", {"a": "x", "b": "x", "c": "y", "d": "y"})
    assert p.count() == len(p.enumerate()) == 4 and p.feasible(("a", "c")) and not p.feasible(("a", "b"))
    q = markets.Policy(tuple("abcd"), 2, "matched_pairs", pairs=(("a", "b"), ("c", "d")), required=frozenset("a"))
    assert q.enumerate() == [("a", "c"), ("a", "d")] and q.count() == 2
    eight = markets.Policy(tuple("abcdefgh"), 4)
    assert eight.count() == 70
    with pytest.raises(ValidationError):
        eight.enumerate(10)
    assert len(eight.sample(12, 1)) == 12 and eight.sample(12, 1) == eight.sample(12, 1)
    f = spark.createDataFrame([(x, float(i)) for i, x in enumerate("abcd")], "geo string, v double")
    ranked = markets.rank_assignments(f, [("a", "b"), ("a", "d"), ("a", "c")], ["v"]).collect()
    assert list(ranked[0]["treated"]) == ["a", "d"] and ranked[0]["max_smd"] == pytest.approx(0)


def candidate(i, test, t, c, score, start=date(2027, 1, 1), days=10):
    return portfolio.Candidate(i, test, start, start + timedelta(days=days), frozenset(t), frozenset(c), score)


def test_solver_against_all_sets():
    import itertools
    import random

    draw = random.Random(3)
    for _ in range(25):
        cs = [candidate(f"{t}{k}", t, draw.sample("abcdef", 2), draw.sample("uvwxyz", 2), draw.uniform(0, 10), date(2027, 1, draw.randint(1, 20))) for t in "PQRS" for k in range(3)]
        best = 0
        for choice in itertools.product(*[[None, *[c for c in cs if c.test_name == t]] for t in "PQRS"]):
            chosen = [c for c in choice if c]
            if portfolio.feasible(chosen, 2):
                best = max(best, sum(portfolio.objective(c) for c in chosen))
        got = portfolio.solve(cs, most_controls=2)
        assert round(got["objective"] * 1000) == best and got["optimal"] and portfolio.feasible(got["selected"], 2)
    assert portfolio.solve([candidate("x", "P", "a", "b", 5.0)], blocked=frozenset("a"))["selected"] == []


def test_monitoring_and_replanning(spark):
    items = spark.createDataFrame(
        [("a", "active", date(2027, 1, 1), date(2027, 1, 20), ["m1"], ["m2"], 0.9), ("b", "planned", date(2027, 1, 5), date(2027, 1, 30), ["m1"], ["m2"], None), ("c", "completed", date(2026, 12, 1), date(2026, 12, 25), ["m5"], ["m6"], None)],
        "test_id string, status string, start_date date, end_date date, treatment_markets array<string>, control_markets array<string>, calibrated_power double",
    )
    s = portfolio.monitor(items, date(2027, 1, 10))
    assert s["clusters"] == [["a", "b"]] and s["cooldown_debt"] == ["m5", "m6"] and s["overused_markets"] == ["m1"]
    assert [a["action"] for a in portfolio.recommend(s)] == ["resolve_market_overuse", "decouple_tests", "wait_for_cooldown", "refresh_power"]
    later = portfolio.monitor(items, date(2027, 3, 10))
    assert portfolio.difference(s, later)["cooldown_debt"]["removed"] == ["m5", "m6"]
    quiet = portfolio.monitor(items.where("test_id = 'a'"), date(2027, 3, 10))
    assert portfolio.recommend(quiet) == [{"priority": 9, "action": "keep_roadmap"}]
    d = portfolio.learning_values(spark.createDataFrame([("x", {"orders": 0.02}), ("y", {"orders": 0.2})], "candidate_id string, metric_mde map<string,double>"), spark.createDataFrame([("orders",)], "metric string"))
    got = {r["candidate_id"]: r["value"] for r in d.collect()}
    assert got["x"] == pytest.approx(100) and got["y"] < 100
    import numpy as np

    c = portfolio.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]]))
    assert np.linalg.eigvalsh(c).min() > -1e-9 and np.allclose(np.diag(c), 1)


def test_rounding(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate((1.5, 2.25, 3.25))], "g string, i int, v double")
    assert [r["rounded"] for r in balanced_round(df, "v", 7, ["g"], ["i"]).orderBy("i").collect()] == [2, 2, 3]


def test_command_line(spark, tmp_path):
    panel = str(tmp_path / "panel")
    assert cli.main(["synthetic", panel, "--markets", "16", "--periods", "120", "--seed", "5"]) == 0
    out = tmp_path / "v.json"
    assert cli.main(["validate-panel", panel, "--complete", "--out", str(out)]) == 0
    roadmap = {"name": "r", "metrics": {"orders": {"type": "count"}, "cr": {"type": "ratio", "numerator": "orders", "denominator": "sessions"}}, "max_shared_control_usage": 2, "tests": [
        {"name": n, "metrics": ["orders", "cr"], "treatment_count": 2, "earliest_start": "2027-03-15", "latest_end": "2027-04-20", "durations": [14, 21]} for n in ("one", "two")]}
    config = tmp_path / "roadmap.json"
    config.write_text(json.dumps(roadmap))
    plan, html = tmp_path / "plan.json", tmp_path / "plan.html"
    assert cli.main(["solve", panel, str(config), "--most", "4", "--out", str(plan), "--report", str(html), "--manifest", str(tmp_path / "m.json")]) == 0
    solved = json.loads(plan.read_text())
    assert {c["test_name"] for c in solved["selected"]} == {"one", "two"} and "<h1>r</h1>" in html.read_text()
    assert cli.main(["monitor", str(plan), "--as-of", "2027-03-20", "--out", str(tmp_path / "mon.json")]) == 0
    assert json.loads((tmp_path / "mon.json").read_text())["actions"]
    same = Generator(RoadmapSpec.from_file(str(config)), GeoPanel.from_parquet(spark, panel)).generate(4)
    assert {c.candidate_id for c in same["one"]} >= {c["candidate_id"] for c in solved["selected"] if c["test_name"] == "one"}
    done = tmp_path / "done.json"
    done.write_text(json.dumps({"experiment_id": "e", "metrics": {"orders": {"type": "count"}}, "treatment": ["geo_001", "geo_002"], "control": [f"geo_{i:03d}" for i in range(5, 15)], "start": "2027-04-01", "end": "2027-04-14", "estimators": ["did", "ratio_delta"], "inference": ["jackknife"]}))
    assert cli.main(["analyze", panel, str(done), "--out", str(tmp_path / "a.json"), "--report", str(tmp_path / "a.html")]) == 0
    assert json.loads((tmp_path / "a.json").read_text())["groups"][0]["status"] in ("supported", "inconclusive", "rejected")
    assert reports.clean({"a": float("inf"), "b": [1.5, float("nan")]}) == {"a": None, "b": [1.5, None]}


def test_streams(spark, tmp_path):
    rows = [(datetime(2027, 1, 1 + d, h), f"g{g}", float(g + d)) for d in range(5) for h in (1, 13) for g in range(4)]
    spark.createDataFrame(rows, "ts timestamp, geo string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, geo string, v double").parquet(str(tmp_path / "in"))
    q = daily_arms(stream, "ts", "geo", "v", ["g0"]).writeStream.format("memory").queryName("arms").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r["day"].day: (r["treatment"], r["control"]) for r in spark.table("arms").collect()}
    assert got == {d + 1: (float(d), 2.0 + d) for d in range(5)}
    spark.createDataFrame([("t", 0.9)] * 40, "test_id string, gap double").write.parquet(str(tmp_path / "gaps"))
    gaps = spark.readStream.schema("test_id string, gap double").parquet(str(tmp_path / "gaps"))
    q = running_evidence(gaps, 0.0, 1.0).writeStream.format("memory").queryName("evidence").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("evidence").orderBy("looks").collect()[-1]
    assert last["looks"] == 40 and last["mean"] == pytest.approx(0.9) and last["p_value"] < 0.01 and last["lower"] < 0.9 < last["upper"] + 1e-9
