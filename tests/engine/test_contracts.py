from datetime import date

import numpy as np
import pytest

from terralift.errors import ValidationError
from terralift.operators import contracts, markets, portfolio
from terralift.operators.estimators import Estimate


def test_small_contracts():
    assert contracts.MetricFormat("percent", 1).text(0.1234) == "12.3%"
    assert contracts.MetricFormat(compact=True, currency="$").text(1_234_567) == "$1.23M"
    assert contracts.MetricFormat().text(float("nan")) == "n/a"
    assert contracts.string_list('["a", " b"]') == contracts.string_list("a, b,") == ["a", "b"]
    assert contracts.overlap_days(date(2027, 1, 1), date(2027, 1, 5), date(2027, 1, 4), date(2027, 1, 9)) == 2
    assert contracts.safe_ratio(1, 0) == 0 and contracts.finite("x") is None and contracts.finite("2") == 2
    with pytest.raises(ValidationError):
        contracts.confidence_alpha(1.5)
    assert contracts.estimand_from_label("cumulative lift").aggregation == "cumulative_total"
    r = contracts.MethodRegistry()
    assert r.family("sdid") == "synthetic" and r.family("mine") == "mine"
    with pytest.raises(ValidationError):
        r.register(contracts.MethodRecord("did", "x"))
    assert contracts.blocks_decision("guardrail", False, "") and not contracts.blocks_decision("primary", False, "")


def test_evidence(spark, tmp_path):
    store = contracts.EvidenceStore()
    for i, (e, v) in enumerate(((0.1, 0.01), (0.2, 0.02), (0.15, 0.01))):
        store.add(contracts.EvidenceRecord(f"t{i}", "orders", e, variance=v, domain="pricing", tags=("a",)))
    store.save(str(tmp_path / "e.json"))
    again = contracts.EvidenceStore.load(str(tmp_path / "e.json"))
    assert again == store
    r = again.pool(spark, ["metric"]).first()
    w = np.array([100, 50, 100])
    assert r["tau2"] == pytest.approx(0) and r["mean"] == pytest.approx((w * [0.1, 0.2, 0.15]).sum() / w.sum())
    assert again.priors(spark, "orders", domain="pricing").count() == 1
    assert again.priors(spark, "orders", domain="other").count() == 0
    assert again.pool(spark, ["channel"]).first()["channel"] == "unknown"


def test_covariance_and_solution(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.9), ("b", "c", 0.9)], "a string, b string, correlation double")
    c = contracts.estimate_covariance({"a": 1.0, "b": 4.0, "c": 1.0}, pairs)
    assert c.projected and np.linalg.eigvalsh(c.correlation).min() > -1e-9 and c.frame().loc["b", "b"] == pytest.approx(4)
    make = lambda i, t, control, score: portfolio.Candidate(i, t, date(2027, 1, 1), date(2027, 1, 10), frozenset({f"x{t}"}), frozenset(control), score, {"mde:orders": 0.05})
    cs = [make("p1", "p", {"u", "v"}, 10.0), make("q1", "q", {"u", "v"}, 10.0), make("q2", "q", {"w", "z"}, 9.5)]
    plain = contracts.solve_portfolio(spark, cs, contracts.ObjectiveWeights())
    assert {x.candidate_id for x in plain["selected"]} == {"p1", "q1"}
    spread = contracts.solve_portfolio(spark, cs, contracts.ObjectiveWeights(shared_control_risk=2.0))
    assert {x.candidate_id for x in spread["selected"]} == {"p1", "q2"}
    contracts.save_solution(spread, str(tmp_path / "s.json"))
    assert contracts.load_solution(str(tmp_path / "s.json"))["selected"] == spread["selected"]
    assert contracts.solution_assignments(spark, spread).df.count() == 6
    with pytest.raises(ValidationError):
        contracts.ObjectiveWeights(learning_value=-1)


def test_callers_functions(spark):
    df = spark.createDataFrame([(f"g{i}", int(i < 3), float(i)) for i in range(8)], "geo string, arm int, y double")
    rows = contracts.bootstrap_frames(df, "geo", "arm", lambda f: f[f.arm == 1].y.mean() - f[f.arm == 0].y.mean(), draws=60).collect()
    assert len(rows) == 60 and np.mean([r["value"] for r in rows]) == pytest.approx(1 - 5, abs=0.6)
    p = markets.Policy(tuple("abcd"), 2)
    r = contracts.randomize_with({"a": 4, "b": 3, "c": 1, "d": 0}, ["a", "b"], p.enumerate(), lambda y, t: sum(y[k] for k in t), "greater")
    assert r.p_value == pytest.approx(1 / 6)
    rng = np.random.default_rng(0)
    d = rng.normal(size=200)
    found = contracts.westfall_young(spark, [Estimate("did", "m1", 4.0, artifacts={"draws": d}), Estimate("did", "m2", 0.1, artifacts={"draws": d + 0.01 * rng.normal(size=200)})])
    assert found["m1"] < 0.02 and found["m2"] > 0.5
