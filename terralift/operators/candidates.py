"""Candidate designs of planned tests: drawn on the driver, measured together in a few plans."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralift.errors import MDEComputationError, ValidationError
from terralift.functions.metrics import Metric, RatioMetric
from terralift.functions.stats import two_sided_ncp
from terralift.operators import power
from terralift.operators.design import Design
from terralift.operators.markets import MarketGraph, Policy, matched_pairs, strata_values, supergeos
from terralift.operators.panel import GeoPanel
from terralift.operators.portfolio import Candidate
from terralift.operators.registry_store import ExperimentRegistry
from terralift.operators.specs import RoadmapSpec, TestSpec


def seed_of(seed: int, name: str) -> int:
    """A test's own seed, the same wherever it stands in the roadmap."""
    return int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:16], 16)


def starts(spec: TestSpec) -> list[tuple[date, int]]:
    """(start, duration) pairs that fit and meet no blackout."""
    out = []
    for days in spec.durations:
        at = spec.earliest_start
        while at + timedelta(days=days - 1) <= spec.latest_end:
            end = at + timedelta(days=days - 1)
            if not any(b.overlaps(at, end) for b in spec.blackouts):
                out.append((at, days))
            at += timedelta(days=spec.step_days)
    return out


@dataclass
class Generator:
    """Draws candidates for a roadmap over a panel, a registry's blocks and a market graph."""

    spec: RoadmapSpec
    panel: GeoPanel
    registry: ExperimentRegistry | None = None
    graph: MarketGraph | None = None

    def markets(self, t: TestSpec) -> list[str]:
        names = t.universe.eligible or [r[0] for r in self.panel.markets().collect()]
        return sorted({*names} - {*t.universe.excluded})

    def volumes(self, t: TestSpec) -> DataFrame:
        m = self.spec.catalog.metrics[t.metrics[0]]
        return self.panel.df.groupBy(F.col(self.panel.geo).alias("geo")).agg(F.coalesce(F.sum(F.col(m.columns[0]).cast("double")), F.lit(0.0)).alias("volume"))

    def policy(self, t: TestSpec, markets: list[str]) -> tuple[Policy, dict[str, list[str]]]:
        """The policy over markets or, for supergeos, over units with their markets."""
        required, forbidden = frozenset(t.required_treatment), frozenset(t.forbidden_treatment)
        kind = t.policy.kind
        if kind == "matched_pairs":
            pairs = t.policy.pairs or [(a, b) for a, b, _ in matched_pairs(self.panel, markets, t.treatment_count)]
            return Policy(tuple(m for p in pairs for m in p), len(pairs), kind, pairs=tuple(pairs), required=required, forbidden=forbidden), {}
        if kind == "stratified":
            strata = {r["geo"]: r["stratum"] for r in strata_values(self.panel, t.policy.strata_columns, markets).collect()}
            return Policy(tuple(markets), t.treatment_count, kind, strata, required=required, forbidden=forbidden), {}
        if kind == "supergeo":
            v = self.volumes(t).where(F.col("geo").isin(markets))
            units = {r["unit"]: r["markets"] for r in supergeos(v, t.policy.min_volume, t.policy.max_markets_per_unit).collect()}
            return Policy(tuple(sorted(units)), t.treatment_count), units
        return Policy(tuple(markets), t.treatment_count, required=required, forbidden=forbidden), {}

    def controls(self, t: TestSpec, markets: list[str], treated: list[str], blocked: set[str], rng: np.random.Generator, volume: dict[str, float]) -> list[str]:
        """All that are left, for designs whose complement is the control; else a draw from volume strata."""
        left = [m for m in markets if m not in blocked and m not in treated]
        if self.graph is not None:
            near = set(self.graph.contaminated_controls(treated, left))
            left = [m for m in left if m not in near]
        if t.policy.kind in ("stratified", "matched_pairs", "supergeo"):
            return sorted(left)
        most = min(len(left), 3 * t.min_controls)
        order = sorted(left, key=lambda m: (-volume.get(m, 0.0), m))
        strata = [list(rng.permutation(s)) for s in np.array_split(np.array(order, dtype=object), min(4, max(1, len(order)))) if len(s)]
        out = [m for m in t.fixed_controls if m in left]
        while len(out) < most and any(strata):
            for s in strata:
                if s and len(out) < most and (m := str(s.pop(0))) not in out:
                    out.append(m)
        return sorted(out)

    def designs(self, t: TestSpec, most: int) -> list[tuple[date, int, list[str], list[str]]]:
        """Different (start, duration, treated, control) by seeded draws, at most 100 tries a candidate."""
        markets, windows = self.markets(t), starts(t)
        if not windows:
            raise ValidationError(f"{t.name} has no window outside its blackouts.", "Widen its dates.")
        policy, units = self.policy(t, markets)
        rng = np.random.default_rng(seed_of(self.spec.seed, t.name))
        pool = policy.enumerate(20 * most) if policy.count() <= 20 * most else policy.sample(20 * most, int(rng.integers(2**31)))
        volume = {r["geo"]: r["volume"] for r in self.volumes(t).collect()}
        out: dict[tuple, tuple] = {}
        blocks: dict[tuple[date, int], tuple[set[str], set[str]]] = {}
        for _ in range(100 * most):
            if len(out) >= most or not pool:
                break
            start, days = windows[int(rng.integers(len(windows)))]
            treated = list(pool[int(rng.integers(len(pool)))])
            treated = sorted({m for u in treated for m in units[u]}) if units else treated
            if (start, days) not in blocks:
                blocks[start, days] = self.blocked(start, start + timedelta(days=days - 1))
            no_treat, no_control = blocks[start, days]
            if no_treat & {*treated}:
                continue
            control = self.controls(t, markets, treated, no_control, rng, volume)
            if len(control) >= t.min_controls:
                out.setdefault((start, days, tuple(treated)), (start, days, treated, control))
        return list(out.values())

    def blocked(self, start: date, end: date) -> tuple[set[str], set[str]]:
        """Markets blocked from treatment and from control in a window."""
        if self.registry is None:
            return set(), set()
        b = self.registry.active_market_blocks(start, end)
        return {*b["blocked_from_treatment"], *self.registry.cooldown_blocks(start, end)}, {*b["blocked_from_control"]}

    def detectable(self, t: TestSpec, designs: list[tuple[date, int, list[str], list[str]]]) -> list[dict[str, float]]:
        """Relative detectable effect of each metric of each design: all designs against the panel in one plan a metric."""
        spark = self.panel.df.sparkSession
        rows = [(i, s - timedelta(days=self.spec.pre_period_days), s, d, tr, co) for i, (s, d, tr, co) in enumerate(designs)]
        table = F.broadcast(spark.createDataFrame(rows, "design long, low date, start date, days int, treated array<string>, control array<string>"))  # the candidates of one test
        out: list[dict[str, float]] = [{} for _ in designs]
        day = F.to_date(F.col(self.panel.time))
        for name in t.metrics:
            m: Metric = self.spec.catalog.metrics[name]
            p = self.panel.df.select(F.col(self.panel.geo).alias("geo"), day.alias("day"), *[F.col(c).cast("double") for c in dict.fromkeys(m.columns)])
            x = p.join(table, (F.col("day") >= F.col("low")) & (F.col("day") < F.col("start")))
            arm = F.when(F.array_contains("treated", F.col("geo")), 1).when(F.array_contains("control", F.col("geo")), 0)
            x = x.withColumn("arm", arm).where("arm is not null")
            if isinstance(m, RatioMetric):
                v = lambda a: F.sum(F.when(F.col("arm") == a, F.col(m.numerator))) / F.nullif(F.sum(F.when(F.col("arm") == a, F.col(m.denominator))), F.lit(0.0))  # noqa: E731, B023
            else:
                v = lambda a: F.sum(F.when(F.col("arm") == a, m.row()))  # noqa: E731, B023
            daily = x.groupBy("design", "days", "day").agg(v(1).alias("t"), v(0).alias("c")).where("t is not null and c is not null")
            means = daily.groupBy("design", "days").agg(F.avg("t").alias("mt"), F.avg("c").alias("mc"), F.var_samp("t").alias("vt"), F.var_samp("c").alias("vc"), F.covar_samp("t", "c").alias("tc"), F.count(F.lit(1)).alias("n"))
            for r in means.collect():
                if r["n"] < 3 or not r["mt"] or not r["mc"]:
                    continue
                k = r["mt"] / r["mc"]  # the control path at the treated level
                sd = math.sqrt(max(r["vt"] - 2 * k * r["tc"] + k * k * r["vc"], 0.0))
                out[r["design"]][name] = two_sided_ncp(t.alpha, t.power, r["n"] - 1) * sd / math.sqrt(r["days"]) / abs(r["mt"])
        for d, got in zip(designs, out, strict=True):
            if len(got) < len(t.metrics):
                raise MDEComputationError(f"{t.name}, start {d[0]}: too little history for {sorted({*t.metrics} - {*got})}.")
        return out

    def generate_for(self, t: TestSpec, most: int = 8) -> list[Candidate]:
        designs = self.designs(t, most)
        if not designs:
            return []
        out = []
        for (start, days, treated, control), mde in zip(designs, self.detectable(t, designs), strict=True):
            used = [mde[m] for m in (t.primary_metrics or t.metrics)]
            parts = {"priority": 100 * t.priority, "mde": -100 * t.mde_penalty * float(np.mean(used)), "controls": -self.spec.control_overuse_penalty * len(control), **{f"mde:{k}": v for k, v in mde.items()}}
            score = parts["priority"] + parts["mde"] + parts["controls"]
            name = hashlib.sha256(f"{t.name}|{start}|{days}|{','.join(treated)}|{','.join(control)}".encode()).hexdigest()[:10]
            out.append(Candidate(f"{t.name}-{name}", t.name, start, start + timedelta(days=days - 1), frozenset(treated), frozenset(control), score, parts))
        return sorted(out, key=lambda c: (-c.score, c.candidate_id))

    def generate(self, most: int = 8) -> dict[str, list[Candidate]]:
        return {t.name: self.generate_for(t, most) for t in self.spec.tests}


def profile(panel: GeoPanel, treated: list[str], control: list[str], volume: str) -> dict[str, Any]:
    """Size of the arms: counts, quartiles of market volume and totals."""
    arm = F.when(F.col(panel.geo).isin(treated), "treatment").when(F.col(panel.geo).isin(control), "control").alias("arm")
    v = panel.df.groupBy(arm, F.col(panel.geo).alias("geo")).agg(F.sum(volume).alias("v")).where("arm is not null")
    rows = v.groupBy("arm").agg(F.count(F.lit(1)).alias("markets"), F.min("v").alias("min"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("max"), F.sum("v").alias("total"), F.slice(F.sort_array(F.collect_list("geo")), 1, 40).alias("first"))
    return {r["arm"]: r.asDict() for r in rows.collect()}


def daily_totals(panel: GeoPanel, metric: Metric, geos: list[str]) -> DataFrame:
    """``day, value``: the metric of each market and day, added up over the markets; a value that is no number stops it."""
    rows = panel.df.where(F.col(panel.geo).isin(geos)).groupBy(F.to_date(F.col(panel.time)).alias("day"), panel.geo).agg(metric.aggregate().alias("v"))
    bad = F.raise_error(F.concat(F.lit(f"metric {metric.name} has no value on "), F.col("day").cast("string"))).cast("double")
    rows = rows.withColumn("v", F.when(F.col("v").isNull() | F.isnan("v"), bad).otherwise(F.col("v")))
    return rows.groupBy("day").agg(F.sum("v").alias("value"))


def passes_rerandomization(balance: list[dict[str, Any]], most_smd: float | None = None, variance_ratios: tuple[float, float] | None = None, most_trend: float | None = None) -> bool:
    """Whether rows ``feature, smd, variance_ratio`` keep within the limits; trends are the features called so."""
    for r in balance:
        if most_smd is not None and abs(r["smd"]) > most_smd:
            return False
        if most_trend is not None and r["feature"].endswith("_trend") and abs(r["smd"]) > most_trend:
            return False
        if variance_ratios and r.get("variance_ratio") is not None and not variance_ratios[0] <= r["variance_ratio"] <= variance_ratios[1]:
            return False
    return True


def metric_weights(primary: list[str], weights: dict[str, float], mde: dict[str, float]) -> dict[str, float]:
    """Weights of a score's effects: the weighted metrics and the primary ones (weight 1), adding up to one."""
    out = {m: weights.get(m, 1.0) for m in dict.fromkeys([*primary, *weights])}
    if missing := sorted({*out} - {*mde}):
        raise MDEComputationError(f"no detectable effect of {missing}.")
    total = sum(out.values())
    return {m: w / total for m, w in out.items()} if total else out


def replay_mde(panel: GeoPanel, metric: Metric, treated: list[str], control: list[str], start: date, days: int, name: str = "did", lifts: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2), **how: Any) -> float:
    """Least lift that an estimator finds often enough on past windows of a design's arms."""
    design = Design.of("replay", treated, control, start, start + timedelta(days=days - 1))
    return power.replay_power(panel, design, metric, name, days, list(lifts), **how)["mde"]
