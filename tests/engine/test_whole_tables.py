"""Registered queries over small tables, against plain Python over every row."""

import math
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from terralift.plans.assignment_queries import QUERIES as ASSIGNMENTS
from terralift.plans.extra_queries import QUERIES as EXTRA
from terralift.plans.method_queries import QUERIES as METHODS
from terralift.plans.portfolio_queries import QUERIES as PORTFOLIO

NATIONS = 6


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, k * 5 % 90, datetime(1997, 1, 1) + timedelta(days=k * 3 % 200), 100000.0 + k * 37 % 11 * 10000) for k in range(1, 121)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(c, c % NATIONS) for c in range(90)], "c_custkey long, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    return d


def plain_intervals(spark, d):
    """(test, market, role, first day) of every order."""
    rows = spark.read.parquet(f"{d}/orders.parquet").collect()
    return [(f"t{r['o_custkey'] % 40}", str(r["o_custkey"] % NATIONS), "treatment" if r["o_totalprice"] > 150000 else "control", r["o_orderdate"].date()) for r in rows]


def test_every_order_makes_an_interval(spark, folder):
    plain = plain_intervals(spark, folder)
    uses = {role: defaultdict(set) for role in ("treatment", "control")}
    for test, geo, role, start in plain:
        for n in range(28):
            uses[role][geo, start + timedelta(days=n)].add(test)
    run = lambda name: (PORTFOLIO.get(name) or ASSIGNMENTS[name])(spark, folder).collect()
    assert sum(r["n_intervals"] for r in run("assignment_interval_usage")) == sum(role == "control" for _, _, role, _ in plain)
    assert run("assignment_max_usage")[0]["most"] == max(map(len, uses["control"].values()))
    both = {k: (",".join(sorted(uses["treatment"][k])), ",".join(sorted(uses["control"][k]))) for k in set(uses["treatment"]) & set(uses["control"])}
    assert {(r["geo_id"], r["date"]): (r["treatment_tests"], r["control_tests"]) for r in run("assignment_conflicts")} == both
    overlaps = {k: len(t) for k, t in uses["treatment"].items() if len(t) > 1}
    assert {(r["geo_id"], r["date"]): r["n_tests"] for r in run("assignment_treatment_overlaps")} == overlaps
    weeks = defaultdict(set)
    for test, geo, _, start in plain:
        assert start <= date(1997, 12, 31)
        day, end = start - timedelta(days=start.weekday()), start + timedelta(days=27)
        while day <= end:
            weeks[geo, day].add(test)
            day += timedelta(days=7)
    assert {(r["geo_id"], r["week"]): set(r["tests"].split(",")) for r in run("plan_calendar")} == weeks


def test_no_date_prefix(spark, folder, tmp_path):
    rows = EXTRA["rounding_to_total"](spark, folder).collect()
    plain = defaultdict(int)
    for r in spark.read.parquet(f"{folder}/orders.parquet").collect():
        plain[str(r["o_custkey"] % NATIONS), r["o_orderdate"].month] += 1
    assert {(r["geo_id"], r["date"].month) for r in rows} == set(plain)
    for geo in {g for g, _ in plain}:
        assert sum(r["rounded"] for r in rows if r["geo_id"] == geo) == round(1.08 * sum(n for (g, _), n in plain.items() if g == geo))
    events = [(datetime(2024, 1, day), u, "purchase", 1.0) for u in (1, 2) for day in range(1, 11) for _ in range(2 if u == 1 or day < 9 else 1)]
    spark.createDataFrame(events, "ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert {r["geo_id"]: r["monotone"] for r in EXTRA["metric_lift_monotone"](spark, str(tmp_path)).collect()} == {"1": True, "2": False}


def test_monitoring_keeps_declared_bounds(spark, tmp_path):
    """Sixty times the usual daily gaps leave the bounds of 50; SQL's stay, and so do the query's."""
    orders = lambda u, day: 400 + 7 * u + day * (u + 3) % 11 + (190 if u in (1, 4, 7) and day >= 15 else 0)
    spark.createDataFrame([(u, day, orders(u, day)) for u in range(10) for day in range(1, 31)], "u long, day int, n int").selectExpr("u AS user_id", "timestampadd(DAY, day - 1, TIMESTAMP '2024-01-01') AS ts", "'purchase' AS event_type", "1.0D AS value", "explode(sequence(1, n))").drop("col").write.parquet(str(tmp_path / "events.parquet"))
    gap = {day: sum(orders(u, day) for u in (1, 4, 7)) / 3 - sum(orders(u, day) for u in (0, 2, 3, 5, 6, 8, 9)) / 7 for day in range(1, 31)}
    level = sum(gap[day] for day in range(1, 15)) / 14
    x, most = [gap[day] - level for day in range(15, 31)], 0.0
    assert min(x) > 100
    found = {r["look"]: r for r in METHODS["analysis_monitoring"](spark, str(tmp_path)).collect()}
    assert set(found) == {4, 8, 16}
    for look in range(1, 17):
        s = sum(x[:look])
        e = (math.exp(s / 100 - look / 8) + math.exp(-s / 100 - look / 8)) / 2
        most = max(most, e)
        if r := found.get(look):
            lower = max(s / look - 100 * math.sqrt(math.log(2 * look * (look + 1) / 0.05) / (2 * look)), -50)
            assert [r["mean"], r["lower"], r["e_value"], r["p_value"]] == pytest.approx([s / look, lower, e, min(1, 1 / most)], rel=1e-7, abs=1e-6)
