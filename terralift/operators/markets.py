"""Market features, matching, supergeos, interference, assignment policies and balance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations, product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralift.errors import ValidationError
from terralift.operators.panel import GeoPanel

# ---- features and matching -----------------------------------------------------------------------------------


def market_features(panel: GeoPanel, markets: list[str] | None = None, start: Any = None, end: Any = None, metrics: list[str] | None = None, exact: list[str] | None = None) -> DataFrame:
    """``geo`` with mean, sd, total and daily trend of up to eight metrics, and the first label of exact-match columns."""
    p = panel.slice(start, end, markets)
    metrics = (metrics or p.metric_columns())[:8]
    day = F.datediff(F.to_date(F.col(panel.time)), F.lit("1970-01-01")).cast("double")
    aggs: list[Column] = []
    for m in metrics:
        v = F.col(m).cast("double")
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std"), F.sum(v).alias(f"{m}_total"), F.coalesce(F.regr_slope(v, day), F.lit(0.0)).alias(f"{m}_trend")]
    labels = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(panel.time))).alias(c) for c in exact or ()]
    return p.df.groupBy(F.col(panel.geo).alias("geo")).agg(*aggs, *labels)


def standardized(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with nulls at the median, centred and scaled by their population deviation; no spread gives zero."""
    medians = features.agg(*[F.percentile(c, 0.5).alias(f"{c}_m") for c in columns])
    filled = features.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"{c}_m") for c in columns}).drop(*[f"{c}_m" for c in columns])
    moments = filled.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("a", F.avg), ("s", F.stddev_pop))])
    out = filled.crossJoin(F.broadcast(moments))  # one row each
    return out.withColumns({c: F.when(F.col(f"{c}_s") > 1e-12, (F.col(c) - F.col(f"{c}_a")) / F.col(f"{c}_s")).otherwise(0.0) for c in columns}).drop(*[f"{c}_{k}" for c in columns for k in "as"])


def pair_distances(z: DataFrame, columns: list[str], exact: list[str] | None = None) -> DataFrame:
    """``a, b, distance``: root mean square difference of standardised features, of markets with equal labels.

    The pairs of markets within a group are what was asked for; markets are few hundreds.
    """
    left = z.select(F.col("geo").alias("a"), F.struct(*columns).alias("x"), *[F.col(c) for c in exact or ()])
    right = z.select(F.col("geo").alias("b"), F.struct(*columns).alias("y"), *[F.col(c).alias(f"{c}_b") for c in exact or ()])
    on = F.col("a") < F.col("b")
    for c in exact or ():
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    total = sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) ** 2 for c in columns), F.lit(0.0))
    return left.join(right, on).select("a", "b", F.sqrt(total / len(columns)).alias("distance"))


def matched_pairs(panel: GeoPanel, markets: list[str] | None = None, n_pairs: int | None = None, metrics: list[str] | None = None, exact: list[str] | None = None, max_distance: float | None = None, start: Any = None, end: Any = None) -> list[tuple[str, str, float]]:
    """Greedy: each market in order takes the nearest that is free; one too far from all is left."""
    features = market_features(panel, markets, start, end, metrics, exact)
    columns = [c for c in features.columns if c != "geo" and c not in (exact or ())]
    near: dict[str, list[tuple[float, str]]] = {}
    rows = pair_distances(standardized(features, columns), columns, exact).collect()
    for r in rows:
        near.setdefault(r["a"], []).append((r["distance"], r["b"]))
        near.setdefault(r["b"], []).append((r["distance"], r["a"]))
    used: set[str] = set()
    out: list[tuple[str, str, float]] = []
    for a in sorted(near):
        if a in used or (n_pairs is not None and len(out) >= n_pairs):
            continue
        free = sorted((d, b) for d, b in near[a] if b not in used)
        if not free or (max_distance is not None and free[0][0] > max_distance):
            continue
        d, b = free[0]
        used |= {a, b}
        out.append((a, b, d))
    return out


def strata_values(panel: GeoPanel, columns: list[str], markets: list[str] | None = None) -> DataFrame:
    """``geo, stratum``: a market's first values, joined by a pipe."""
    first = F.row_number().over(Window.partitionBy(panel.geo).orderBy(panel.time))
    rows = panel.slice(geos=markets).df.withColumn("__n", first).where("__n = 1")
    return rows.select(F.col(panel.geo).alias("geo"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("stratum"))


# ---- supergeos -----------------------------------------------------------------------------------------------


def supergeos(volumes: DataFrame, min_volume: float | None = None, max_markets: int | None = None, group: list[str] | None = None) -> DataFrame:
    """``unit, markets, volume`` from ``geo, volume``: in order of volume, bins are filled up to the least volume.

    A scan with resets is no window, so each group is one pandas call; groups are regions, of some hundred markets.
    """
    if min_volume is None:
        min_volume = volumes.agg(F.percentile("volume", 0.5)).first()[0]
    keyed = volumes.withColumn("part", F.concat_ws("|", *[F.col(c).cast("string") for c in group]) if group else F.lit("all"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bins: list[tuple[list[str], float]] = []
        now: list[str] = []
        total = 0.0
        for r in frame.sort_values(["volume", "geo"]).itertuples():
            now.append(r.geo)
            total += r.volume
            if total >= min_volume or (max_markets and len(now) >= max_markets):
                bins.append((now, total))
                now, total = [], 0.0
        if now:
            if bins:
                bins[-1] = (bins[-1][0] + now, bins[-1][1] + total)
            else:
                bins.append((now, total))
        part = frame["part"].iloc[0]
        return pd.DataFrame([(f"{part}:{i:03d}", sorted(m), v) for i, (m, v) in enumerate(bins)], columns=["unit", "markets", "volume"])

    return keyed.groupBy("part").applyInPandas(fill, "unit string, markets array<string>, volume double")


def expand_units(units: DataFrame, ids: list[str]) -> list[str]:
    rows = units.where(F.col("unit").isin(ids)).select(F.explode("markets").alias("g")).distinct().orderBy("g").collect()
    return [r["g"] for r in rows]


# ---- interference --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class InterferenceEdge:
    """A tie between two markets."""

    source: str
    target: str
    weight: float = 1.0
    distance: float | None = None


@dataclass(frozen=True)
class Supergeo:
    """Markets that are assigned as one."""

    unit: str
    markets: tuple[str, ...]
    volume: float
    labels: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, units: DataFrame) -> list[Supergeo]:
        """One for each row of ``supergeos``; units are fewer than markets."""
        return [cls(r["unit"], tuple(r["markets"]), r["volume"], {"part": r["unit"].rsplit(":", 1)[0]}) for r in units.orderBy("unit").collect()]


@dataclass(frozen=True)
class MatchedPair:
    """Two markets that are alike."""

    first: str
    second: str
    distance: float
    exact_match_key: str | None = None

    def other(self, market: str) -> str:
        return self.second if market == self.first else self.first


SOURCE_NAMES, TARGET_NAMES = ("source", "from", "left", "market_a", "geo_a"), ("target", "to", "right", "market_b", "geo_b")


@dataclass(frozen=True)
class MarketGraph:
    """Edges ``a, b, weight, distance`` between markets; undirected unless said."""

    edges: DataFrame
    directed: bool = False

    @classmethod
    def from_frame(cls, df: DataFrame, weight: str = "weight", distance: str = "distance", default_weight: float = 1.0, directed: bool = False) -> MarketGraph:
        pick = lambda names: next((c for c in names if c in df.columns), None)
        a, b = pick(SOURCE_NAMES), pick(TARGET_NAMES)
        if not a or not b:
            raise ValidationError("edges lack their two market columns.", f"Name them one of {SOURCE_NAMES} and {TARGET_NAMES}.")
        w = F.coalesce(F.col(weight).cast("double"), F.lit(default_weight)) if weight in df.columns else F.lit(default_weight)
        d = F.col(distance).cast("double") if distance in df.columns else F.lit(None).cast("double")
        return cls(df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), w.alias("weight"), d.alias("distance")).where("a <> b"), directed)

    @classmethod
    def from_edges(cls, spark: SparkSession, edges: Iterable[tuple], directed: bool = False) -> MarketGraph:
        return cls(spark.createDataFrame([(str(e[0]), str(e[1]), float(e[2]) if len(e) > 2 else 1.0, float(e[3]) if len(e) > 3 else None) for e in edges], "a string, b string, weight double, distance double"), directed)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, **how: Any) -> MarketGraph:
        return cls.from_frame(spark.read.csv(path, header=True), **how)

    @classmethod
    def from_metadata(cls, panel: GeoPanel, columns: dict[str, float] | None = None) -> MarketGraph:
        """Markets of one state (weight 1) or region (weight 0.5); the strongest tie of a pair counts."""
        columns = columns or {c: w for c, w in (("state", 1.0), ("region", 0.5)) if c in panel.df.columns}
        if not columns:
            raise ValidationError("the panel has no state or region.", "Name columns that tie markets.")
        geos = panel.df.groupBy(F.col(panel.geo).alias("g")).agg(*[F.min(c).alias(c) for c in columns])
        out = None
        for c, w in columns.items():
            left, right = geos.select(F.col("g").alias("a"), F.col(c).alias("k")), geos.select(F.col("g").alias("b"), F.col(c).alias("k"))
            e = left.join(right, "k").where("a < b").select("a", "b", F.lit(w).alias("weight"))
            out = e if out is None else out.unionByName(e)
        return cls(out.groupBy("a", "b").agg(F.max("weight").alias("weight")).withColumn("distance", F.lit(None).cast("double")))

    def both_ways(self, max_distance: float | None = None, min_weight: float | None = None) -> DataFrame:
        e = self.edges
        if max_distance is not None:
            e = e.where(F.col("distance").isNull() | (F.col("distance") <= max_distance))
        if min_weight is not None:
            e = e.where(F.col("weight") >= min_weight)
        return e if self.directed else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "distance"))

    def neighbors(self, market: str, **limits: Any) -> list[str]:
        return [r[0] for r in self.both_ways(**limits).where(F.col("a") == market).select("b").distinct().orderBy("b").collect()]

    def crossing(self, treated: list[str], control: list[str], **limits: Any) -> DataFrame:
        return self.both_ways(**limits).where(F.col("a").isin(treated) & F.col("b").isin(control)).dropDuplicates(["a", "b"])

    def contaminated_controls(self, treated: list[str], control: list[str], **limits: Any) -> list[str]:
        return [r[0] for r in self.crossing(treated, control, **limits).select("b").distinct().orderBy("b").collect()]

    def contamination(self, treated: list[str], control: list[str], **limits: Any) -> dict[str, Any]:
        r = self.crossing(treated, control, **limits).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.count_distinct("b").alias("controls")).first()
        return {**r.asDict(), "rate": r["controls"] / len(control) if control else 0.0}

    def exposures(self, treated: list[str], control: list[str], **limits: Any) -> DataFrame:
        return self.crossing(treated, control, **limits).groupBy(F.col("b").alias("geo")).agg(F.sum("weight").alias("exposure"))

    def spillover(self, treated: list[str], control: list[str], effect: float, grid: list[float], **limits: Any) -> list[dict[str, float]]:
        """The effect without the spillover that controls of this exposure would carry."""
        total = self.exposures(treated, control, **limits).agg(F.coalesce(F.sum("exposure"), F.lit(0.0))).first()[0]
        mean = total / len(control) if control else 0.0
        return [{"spillover": s, "bias": -mean * s, "adjusted": effect + mean * s} for s in grid]


def graph_from_spec(spark: SparkSession, spec: Any, panel: GeoPanel | None = None) -> MarketGraph | None:
    """The graph that a specification names: its adjacency file, else its distances, else its exposures, else the
    panel's states and regions; none if its mode is off."""
    if spec.mode == "none":
        return None
    for path, how in ((spec.adjacency_path, {}), (spec.distance_path, {}), (spec.exposure_path, {"weight": "exposure", "directed": True})):
        if path:
            return MarketGraph.from_path(spark, path, **how)
    if panel is None:
        raise ValidationError("the specification names no file and there is no panel.", "Give one of them.")
    return MarketGraph.from_metadata(panel)


# ---- policies ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """How treated markets are chosen: a fixed number, within strata, or one of each pair."""

    markets: tuple[str, ...]
    treatment_count: int
    kind: str = "complete"
    strata: dict[str, str] = field(default_factory=dict)
    pairs: tuple[tuple[str, str], ...] = ()
    required: frozenset[str] = frozenset()
    forbidden: frozenset[str] = frozenset()

    def quotas(self) -> dict[str, int]:
        """Treated markets of each stratum: proportional, at least one, and the last takes the rest."""
        sizes: dict[str, int] = {}
        for m in self.markets:
            sizes[self.strata.get(m, "")] = sizes.get(self.strata.get(m, ""), 0) + 1
        names, left, out = sorted(sizes), self.treatment_count, {}
        for i, s in enumerate(names):
            if i == len(names) - 1:
                out[s] = left
            else:
                share = round(self.treatment_count * sizes[s] / len(self.markets))
                out[s] = max(min(1, sizes[s]), min(share, sizes[s], left - (len(names) - 1 - i)))
            left -= out[s]
        if any(not 0 <= n <= sizes[s] for s, n in out.items()):
            raise ValidationError("the strata can't hold this number of treated markets.", "Change the count or the strata.")
        return out

    def feasible(self, treated: Iterable[str]) -> bool:
        t = frozenset(treated)
        if not t <= frozenset(self.markets) or t & self.forbidden or not self.required <= t:
            return False
        if self.kind == "matched_pairs":
            return all((a in t) != (b in t) for a, b in self.pairs) and len(t) == len(self.pairs)
        if len(t) != self.treatment_count:
            return False
        if self.kind == "stratified":
            return all(sum(self.strata.get(m, "") == s for m in t) == n for s, n in self.quotas().items())
        return True

    def every(self) -> Iterator[tuple[str, ...]]:
        if self.kind == "matched_pairs":
            made = (tuple(sorted(c)) for c in product(*self.pairs))
        elif self.kind == "stratified":
            groups = [combinations([m for m in self.markets if self.strata.get(m, "") == s], n) for s, n in sorted(self.quotas().items())]
            made = (tuple(sorted(m for part in c for m in part)) for c in product(*groups))
        else:
            made = combinations(sorted(self.markets), self.treatment_count)
        return (a for a in made if self.feasible(a))

    def enumerate(self, most: int = 10_000) -> list[tuple[str, ...]]:
        out = []
        for a in self.every():
            out.append(a)
            if len(out) > most:
                raise ValidationError(f"more than {most} assignments.", "Sample them.")
        return out

    def count(self) -> int:
        """Feasible assignments, without listing them."""
        if self.kind == "matched_pairs":
            fixed = sum(bool({a, b} & (self.required | self.forbidden)) for a, b in self.pairs)
            return 2 ** (len(self.pairs) - fixed)
        free = [m for m in self.markets if m not in self.required | self.forbidden]
        if self.kind == "stratified":
            total = 1
            for s, n in self.quotas().items():
                inside = sum(self.strata.get(m, "") == s for m in free)
                total *= math.comb(inside, n - sum(self.strata.get(m, "") == s for m in self.required))
            return total
        return math.comb(len(free), self.treatment_count - len(self.required))

    def sample(self, n: int, seed: int = 0) -> list[tuple[str, ...]]:
        """Different assignments, at most ``100 n`` tries; all of them if there are no more than ``n``."""
        if self.count() <= n:
            return self.enumerate(n)
        rng = np.random.default_rng(seed)
        out: dict[tuple[str, ...], None] = {}
        for _ in range(100 * n):
            if self.kind == "matched_pairs":
                t = tuple(sorted(p[rng.integers(2)] for p in self.pairs))
            elif self.kind == "stratified":
                t = tuple(sorted(m for s, k in self.quotas().items() for m in rng.choice([m for m in sorted(self.markets) if self.strata.get(m, "") == s], k, replace=False)))
            else:
                free = sorted(m for m in self.markets if m not in self.required | self.forbidden)
                t = tuple(sorted([*self.required, *rng.choice(free, self.treatment_count - len(self.required), replace=False)]))
            if self.feasible(t):
                out[t] = None
            if len(out) >= n:
                break
        return list(out)


@dataclass(frozen=True)
class ListedPolicy(Policy):
    """One of listed assignments; any object with ``feasible``, ``enumerate`` and ``sample`` can stand in for a policy."""

    listed: tuple[tuple[str, ...], ...] = ()

    def feasible(self, treated: Iterable[str]) -> bool:
        return tuple(sorted(treated)) in self.listed

    def every(self) -> Iterator[tuple[str, ...]]:
        return iter(self.listed)

    def count(self) -> int:
        return len(self.listed)

    def sample(self, n: int, seed: int = 0) -> list[tuple[str, ...]]:
        order = np.random.default_rng(seed).permutation(len(self.listed))[:n]
        return [self.listed[i] for i in sorted(order)]


def smd(value: Column, treated: Column) -> Column:
    """Standardised mean difference; without spread zero, or infinite if the means differ."""
    t, c = F.when(treated, value), F.when(~treated, value)
    gap = F.avg(t) - F.avg(c)
    pooled = F.sqrt((F.coalesce(F.var_samp(t), F.lit(0.0)) + F.coalesce(F.var_samp(c), F.lit(0.0))) / 2)
    return F.when(pooled > 1e-12, gap / F.greatest(pooled, F.lit(1e-300))).when(F.abs(gap) < 1e-12, 0.0).otherwise(F.signum(gap) * F.lit(float("inf")))


def variance_ratio(value: Column, treated: Column) -> Column:
    t, c = F.var_samp(F.when(treated, value)), F.var_samp(F.when(~treated, value))
    return F.when(c > 0, t / c)


def balance(features: DataFrame, treated: list[str], columns: list[str]) -> DataFrame:
    """``feature, smd, variance_ratio, warn`` of one assignment."""
    z = F.col("geo").isin(treated)
    long = features.select("geo", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f")).select("geo", "f.*")
    out = long.groupBy("feature").agg(smd(F.col("v"), z).alias("smd"), variance_ratio(F.col("v"), z).alias("variance_ratio"))
    return out.withColumn("warn", (F.abs("smd") > 0.25) | (F.col("variance_ratio") > 2) | (F.col("variance_ratio") < 0.5))


def rank_assignments(features: DataFrame, assignments: list[tuple[str, ...]], columns: list[str], most: int = 200) -> DataFrame:
    """``assignment, max_smd``, best first: all assignments against all features in one aggregate."""
    spark = features.sparkSession
    rows = [(i, list(a)) for i, a in enumerate(assignments[:most])]
    a = spark.createDataFrame(rows, "assignment long, treated array<string>")
    long = features.select("geo", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f")).select("geo", "f.*")
    pairs = long.crossJoin(F.broadcast(a))  # 200 assignments at most
    per = pairs.groupBy("assignment", "feature").agg(smd(F.col("v"), F.array_contains("treated", F.col("geo"))).alias("smd"))
    return per.groupBy("assignment").agg(F.max(F.abs("smd")).alias("max_smd")).join(F.broadcast(a), "assignment").orderBy("max_smd", "assignment")
