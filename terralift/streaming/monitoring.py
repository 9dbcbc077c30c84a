"""Anytime-valid monitoring of a running test as a stream: late rows are let in up to a watermark, totals are state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_arms(events: DataFrame, time: str, geo: str, value: str, treated: list[str], delay: str = "2 days") -> DataFrame:
    """``day, treatment, control``: mean value by arm and day; a day is closed when the watermark has passed it."""
    z = F.col(geo).isin(treated)
    v = F.col(value).cast("double")
    days = events.withWatermark(time, delay).groupBy(F.window(time, "1 day"))
    return days.agg(F.avg(F.when(z, v)).alias("treatment"), F.avg(F.when(~z, v)).alias("control")).select(F.col("window.start").alias("day"), "treatment", "control")


STATE = "n long, total double, most double"
OUTPUT = "test_id string, looks long, mean double, lower double, upper double, e_value double, p_value double"


def running_evidence(gaps: DataFrame, low: float, high: float, alpha: float = 0.05, bet: float = 1.0) -> DataFrame:
    """From a stream ``test_id, gap`` (bounded values): mean, confidence sequence and e-value after all rows so far.

    State of a test is three numbers: rows, their sum, and the largest e-value yet.
    """
    width = high - low

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, total, most = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            for x in frame["gap"].dropna():
                n, total = n + 1, total + float(x)
                most = max(most, math.exp(min(709.0, max(-745.0, bet * total - n * bet * bet * width * width / 8))))
        state.update((n, total, most))
        if n:
            radius = width * math.sqrt(math.log(2 * n * (n + 1) / alpha) / (2 * n))
            mean = total / n
            yield pd.DataFrame([(key[0], n, mean, max(low, mean - radius), min(high, mean + radius), most, min(1.0, 1 / most) if most > 0 else 1.0)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return gaps.groupBy("test_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
