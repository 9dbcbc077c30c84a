import math
from datetime import date, datetime, timedelta

import pytest

from terralift.errors import ValidationError
from terralift.functions.metrics import CountMetric, ContinuousMetric, MetricCatalog, RatioMetric, delta_method_difference
from terralift.operators import estimators, power
from terralift.operators.analysis import analyze, methodology_status
from terralift.operators.design import Design
from terralift.operators.panel import GeoPanel, checked_filter
from terralift.operators.specs import CompletedSpec
from terralift.operators.validation import infer_frequency
from terralift.sources.synthetic import Lift, generate_panel


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "2027-01-01", 10, 100), ("a", "2027-01-02", 12, 110), ("b", "2027-01-01", 8, 90), ("b", "2027-01-02", 9, 95)]
    return spark.createDataFrame(rows, "geo_id string, date string, orders long, sessions long")


def test_small_panel(spark, small):
    p = GeoPanel.from_dataframe(small, complete=True)
    assert p.aggregate("orders", by=[]).first()["orders"] == 39
    assert p.metric_columns() == ["orders", "sessions"]
    holed = GeoPanel.from_dataframe(small.where("not (geo_id = 'b' and date = '2027-01-02')"), frequency="D")
    assert holed.validate().n_missing == 1
    with pytest.raises(ValidationError):
        GeoPanel.from_dataframe(small.union(small))
    with pytest.raises(ValidationError):
        checked_filter("1 = 1; drop table x")
    small.createOrReplaceTempView("small_panel")
    q = GeoPanel.from_query(spark, "select * from small_panel where orders > :least", {"least": 8}, start="2027-01-02", validate=False)
    assert q.df.count() == 2
    assert p.slice(geos=[]).df.count() == 0
    pulled = GeoPanel.from_callable(lambda geos: small, geos=["a"])
    assert pulled.df.count() == 2
    assert GeoPanel.from_adapter(p, ["b"]).df.count() == 2


def test_frequencies(spark):
    days = lambda *d: spark.createDataFrame([(datetime.fromisoformat(x),) for x in d], "t timestamp")
    assert infer_frequency(days("2027-01-01", "2027-02-01", "2027-04-01"), "t") == "MS"
    assert infer_frequency(days("2027-01-01", "2027-01-02", "2027-01-03"), "t") == "D"
    assert infer_frequency(days("2027-01-04", "2027-01-11", "2027-01-18"), "t") == "W-MON"
    assert infer_frequency(days("2027-01-01"), "t") is None
    gap = spark.createDataFrame([("a", datetime(2027, m, 1)) for m in (1, 2, 4, 5)], "geo_id string, date timestamp")
    assert GeoPanel(gap, frequency="MS").validate(complete=True).n_missing == 1


def test_delta_method(spark):
    df = spark.createDataFrame([("t", 2.0, 10.0), ("t", 6.0, 10.0), ("c", 1.0, 10.0), ("c", 3.0, 10.0)], "arm string, n double, d double")
    out = delta_method_difference(df, RatioMetric("r", numerator="n", denominator="d"), "arm", "t", "c")
    assert out["estimate"] == pytest.approx(0.2) and out["standard_error"] == pytest.approx(math.sqrt(0.05))


def test_catalog_round_trip(tmp_path):
    c = MetricCatalog([CountMetric("orders"), RatioMetric("cr", numerator="orders", denominator="sessions")])
    for name in ("c.json", "c.yaml"):
        c.to_file(str(tmp_path / name))
        assert MetricCatalog.from_file(str(tmp_path / name)).metrics == c.metrics
    assert c.required_columns() == ["orders", "sessions"]


def forecast_panel(spark, latent=False):
    rows = []
    for i in range(12 if latent else 6):
        for d in range(84):
            base = 100 + 4 * i + 8 * math.sin(2 * math.pi * d / 7) + 0.45 * d
            if latent:
                base += (0.5 + 0.1 * i) * 6 * math.sin(d / 9) + (1.2 - 0.07 * i) * 4 * math.cos(d / 5)
            rows.append((f"m{i + 1:02d}", datetime(2027, 1, 1) + timedelta(days=d), base + (12.0 if i < 2 and d >= 56 else 0.0)))
    return GeoPanel(spark.createDataFrame(rows, "geo_id string, date timestamp, outcome double"), frequency="D")


def test_recovery(spark):
    panel = forecast_panel(spark)
    design = Design.of("x", ["m01", "m02"], ["m03", "m04", "m05", "m06"], "2027-02-26", "2027-03-25")
    m = ContinuousMetric("outcome")
    assert estimators.did(panel, design, m).estimate == pytest.approx(12, abs=1e-8)
    assert estimators.ratio_delta(panel, design, m).estimate == pytest.approx(12, abs=1e-8)
    assert estimators.synthetic_did(panel, design, m).estimate == pytest.approx(12, abs=1e-6)
    assert estimators.tbr(panel, design, m).estimate == pytest.approx(12 * 2 * 28, rel=0.02)
    sc = estimators.synthetic_control(panel, design, m)
    assert sc.estimate == pytest.approx(12 * 28, rel=0.02)
    got = {e.estimator: e for e in estimators.fit_all(panel, design, [m], list(estimators.ESTIMATORS))}
    assert not [e.error for e in got.values() if e.error]
    assert got["matrix_completion"].estimate == pytest.approx(12 * 28 * 2, rel=0.05)
    assert got["forecast"].estimate == pytest.approx(12 * 28 * 2, rel=0.25)
    assert all(e.relative_lift > 0 for e in got.values() if e.relative_lift is not None)
    assert estimators.consensus(list(got.values()))["agree"]


def test_unbalanced_did_is_exact(spark):
    panel = forecast_panel(spark)
    holed = GeoPanel(panel.df.where("not (geo_id = 'm04' and day(date) % 5 = 0)"), frequency="D")
    design = Design.of("x", ["m01", "m02"], ["m03", "m04", "m05", "m06"], "2027-02-26", "2027-03-25")
    assert estimators.did(holed, design, ContinuousMetric("outcome")).estimate == pytest.approx(12, abs=1e-7)


def test_latent_factors(spark):
    panel = forecast_panel(spark, latent=True)
    design = Design.of("x", ["m01", "m02"], [f"m{i:02d}" for i in range(3, 13)], "2027-02-26", "2027-03-25")
    assert estimators.synthetic_did(panel, design, ContinuousMetric("outcome")).estimate == pytest.approx(12, abs=0.8)


def test_analysis_of_synthetic_panel(spark):
    lift = Lift(("geo_001", "geo_002", "geo_003"), "2027-05-01", "2027-05-21", 0.3)
    panel = GeoPanel(generate_panel(spark, 14, "2027-01-01", 150, seed=9, lifts=[lift]).cache(), frequency="D")
    spec = CompletedSpec(
        experiment_id="e", metrics={"orders": {"type": "count"}, "cr": {"type": "ratio", "numerator": "orders", "denominator": "sessions"}},
        treatment=["geo_001", "geo_002", "geo_003"], control=[f"geo_{i:03d}" for i in range(6, 15)], start=date(2027, 5, 1), end=date(2027, 5, 21), pre_start=date(2027, 2, 1),
        estimators=["did", "ratio_delta"], inference=["randomization_inference", "jackknife", "market_bootstrap", "few_cluster_robust"], looks=[0.5, 1.0], injected_lifts=[0.1],
    )
    found = analyze(panel, spec)
    main = next(r for r in found.results if r.metric == "orders" and r.estimator == "did")
    assert main.relative_lift == pytest.approx(0.3, abs=0.12)
    assert {i.method for i in found.inference["orders"]} >= {"randomization_test", "jackknife", "bootstrap"}
    assert len(found.monitoring["orders"]["looks"]) == 2
    assert found.calibration["orders"]["injected_lift"]["median_bias"] == pytest.approx(0, abs=0.06)
    assert methodology_status(found)["failed"] == 0
    same = generate_panel(spark, 14, "2027-01-01", 150, seed=9, lifts=[lift]).repartition(7)
    assert same.exceptAll(panel.df).count() == 0


def test_power_functions():
    assert power.mde_from_curve([(0.1, 0.5), (0.2, 0.9)]) == 0.2
    t, c = [100.0] * 7, [100 + d for d in (-14, -7, 0, 7, 14, 0, 0)]
    short, long = power.count_mde(t, c, 14), power.count_mde(t, c, 56)
    assert long == pytest.approx(short / 2)
    assert power.calibration_status(1, 20, 19, 0.05, 0) == "pass"
    assert power.calibration_status(15, 20, 3, 0.05, 0) == "fail"
