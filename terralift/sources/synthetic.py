"""Synthetic geo panels: markets by a seeded generator on the driver, their days grown in parallel, one task per market."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.errors import ValidationError

REGIONS = ("North", "South", "East", "West")
US = {"Northeast": ("NY", "PA", "MA"), "South": ("TX", "FL", "GA"), "Midwest": ("IL", "OH", "MI"), "West": ("CA", "WA", "AZ")}
SCHEMA = "geo_id string, date timestamp, country string, geo_grain string, region string, state string, population long, market_size double, orders long, sessions long, revenue double, spend double, eligible_users long, latent_seasonality double, local_shock double"


@dataclass(frozen=True)
class Lift:
    """A lift put in on some markets and dates; ``mode`` is relative, absolute or ratio (numerator / denominator)."""

    markets: tuple[str, ...]
    start: str
    end: str
    lift: float
    metric: str = "orders"
    mode: str = "relative"
    denominator: str | None = None
    affect_denominator: bool = False


def market_table(n: int, seed: int, country: str = "US", us: bool = False, prefix: str = "geo") -> pd.DataFrame:
    """One row per market: region, state, population and size."""
    draw = np.random.default_rng(seed)
    names = list(US) if us else list(REGIONS)
    region = draw.choice(names, n, p=np.array([0.2, 0.35, 0.2, 0.25]))
    population = np.clip(draw.lognormal(13.2, 0.8, n), 60_000, 2e7).astype(np.int64)
    state = [draw.choice(US[r]) for r in region] if us else [None] * n
    return pd.DataFrame({"geo_id": [f"{prefix}_{i + 1:03d}" for i in range(n)], "country": country, "region": region, "state": state, "population": population, "market_size": np.clip(population / 2200, 80, 5000)})


def ar1(draw: np.random.Generator, n: int, rho: float, sigma: float) -> np.ndarray:
    out, x = np.empty(n), 0.0
    for i, e in enumerate(draw.normal(0, sigma, n)):
        x = rho * x + e
        out[i] = x
    return out


def generate_panel(spark: SparkSession, n_markets: int = 100, start: str = "2027-01-01", periods: int = 730, frequency: str = "D", seed: int = 2027, country: str = "US", us: bool = False, grain: str = "dma", diagnostics: bool = False, lifts: list[Lift] | None = None) -> DataFrame:
    """A deterministic panel: the same seed gives the same cells however the work is dealt."""
    times = pd.date_range(start, periods=periods, freq=frequency)
    day = np.arange(periods)
    season = 1 + 0.12 * np.sin(2 * np.pi * day / 7) + 0.08 * np.sin(2 * np.pi * day / 365.25) + 0.0002 * day
    common = ar1(np.random.default_rng([seed, 1]), periods, 0.6, 0.02)
    table = market_table(n_markets, seed, country, us, grain if us else "geo")
    rows = [(i, r.geo_id, r.country, r.region, r.state, int(r.population), float(r.market_size)) for i, r in enumerate(table.itertuples())]
    markets = spark.createDataFrame(rows, "number long, geo_id string, country string, region string, state string, population long, market_size double")

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m in frame.itertuples():
                draw = np.random.default_rng([seed, 2, int(m.number)])
                shock = ar1(draw, periods, 0.5, 0.04)
                level = m.market_size * season * np.exp(common + shock) * draw.lognormal(0, 0.1)
                sessions = draw.poisson(level * 12)
                orders = draw.binomial(sessions, 0.08)
                yield pd.DataFrame({
                    "geo_id": m.geo_id, "date": times, "country": m.country, "geo_grain": grain, "region": m.region, "state": m.state, "population": m.population, "market_size": m.market_size,
                    "orders": orders, "sessions": sessions, "revenue": orders * draw.gamma(20, 2.5, periods), "spend": draw.gamma(4, level * 0.05), "eligible_users": draw.poisson(level * 30), "latent_seasonality": season, "local_shock": shock,
                })

    out = markets.repartition(min(n_markets, spark.sparkContext.defaultParallelism), "number").mapInPandas(grow, SCHEMA)
    for lift in lifts or ():
        out = apply_lift(out, lift)
    return out if diagnostics else out.drop("latent_seasonality", "local_shock", *([] if us else ["state"]))


def apply_lift(df: DataFrame, lift: Lift, geo: str = "geo_id", time: str = "date") -> DataFrame:
    """Put a lift in; counts stay whole numbers."""
    if lift.metric not in df.columns:
        raise ValidationError(f"no metric {lift.metric!r} to lift.", f"Columns are {df.columns}.")
    where = F.col(geo).isin(list(lift.markets)) & F.col(time).between(F.lit(lift.start).cast("timestamp"), F.lit(lift.end).cast("timestamp"))
    metric = F.col(lift.metric)
    kind = df.schema[lift.metric].dataType
    made = metric + lift.lift if lift.mode == "absolute" else metric * (1 + lift.lift)
    if kind.typeName() in ("long", "integer"):
        made = F.round(made)
    changes: dict[str, Any] = {lift.metric: F.when(where, made.cast(kind)).otherwise(metric)}
    if lift.mode == "ratio" and lift.denominator and lift.affect_denominator:
        d = F.col(lift.denominator)
        changes[lift.denominator] = F.when(where, F.round(d * (1 + lift.lift)).cast(df.schema[lift.denominator].dataType)).otherwise(d)
    return df.withColumns(changes)


def balanced_round(df: DataFrame, value: str, total: int | Column, by: list[str], order: list[str]) -> DataFrame:
    """``value`` rounded to whole numbers that add up to ``total`` in each group, largest remainders first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    low = F.floor(value)
    rank = F.row_number().over(w.orderBy(F.desc(F.col(value) - low), *order))
    return df.withColumn("rounded", (low + F.when(rank <= F.lit(total) - F.sum(low).over(w), 1).otherwise(0)).cast("long"))
