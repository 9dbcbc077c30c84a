"""Intervals and tests over small aggregated data, and their plan forms where many groups are tested at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralift.errors import EstimationError, ValidationError
from terralift.functions.stats import NORMAL, t_cdf, t_ppf, t_sf, tail

Interval = tuple[float, float]


@dataclass(frozen=True)
class Inference:
    """Result of one procedure."""

    method: str
    estimate: float
    interval: Interval | None = None
    p_value: float | None = None
    standard_error: float | None = None
    confidence: float = 0.95
    details: dict[str, Any] = field(default_factory=dict)


def t_interval(estimate: float, se: float | None, df: float, confidence: float = 0.95) -> Interval | None:
    if se is None or not math.isfinite(se) or se <= 0 or not df > 0:
        return None
    half = t_ppf((1 + confidence) / 2, df) * se
    return estimate - half, estimate + half


def t_p_value(estimate: float, se: float | None, df: float, null: float = 0.0, alternative: str = "two-sided") -> float | None:
    if se is None or not math.isfinite(se) or se <= 0 or not df > 0:
        return None
    t = (estimate - null) / se
    return tail(alternative, t_cdf(t, df), t_sf(t, df))


def normal_interval(estimate: float, se: float | None, confidence: float = 0.95) -> Interval | None:
    return t_interval(estimate, se, math.inf, confidence)


def normal_p_value(estimate: float, se: float | None, null: float = 0.0, alternative: str = "two-sided") -> float | None:
    return t_p_value(estimate, se, math.inf, null, alternative)


def welch(treatment: Sequence[float], control: Sequence[float], confidence: float = 0.95, alternative: str = "two-sided", null: float = 0.0) -> Inference:
    """Difference in means with Welch-Satterthwaite degrees of freedom; without any spread the interval is the point."""
    t, c = np.asarray(treatment, float), np.asarray(control, float)
    if len(t) < 2 or len(c) < 2:
        raise EstimationError("each arm needs two values at least.")
    diff = float(t.mean() - c.mean())
    vt, vc = t.var(ddof=1) / len(t), c.var(ddof=1) / len(c)
    se = math.sqrt(vt + vc)
    if se == 0:
        return Inference("welch", diff, (diff, diff), 1.0 if diff == null else 0.0, 0.0, confidence)
    df = (vt + vc) ** 2 / (vt**2 / (len(t) - 1) + vc**2 / (len(c) - 1))
    return Inference("welch", diff, t_interval(diff, se, df, confidence), t_p_value(diff, se, df, null, alternative), se, confidence, {"df": df})


def welch_by(df: DataFrame, keys: list[str], value: str, treated: str) -> DataFrame:
    """``*keys, estimate, standard_error, df, n_treated, n_control``: Welch terms of every group in one aggregate."""
    is_t, is_c = F.col(treated) == 1, F.col(treated) == 0
    v = F.col(value)
    a = df.groupBy(*keys).agg(
        F.avg(F.when(is_t, v)).alias("mt"), F.avg(F.when(is_c, v)).alias("mc"), F.var_samp(F.when(is_t, v)).alias("st"), F.var_samp(F.when(is_c, v)).alias("sc"),
        F.count(F.when(is_t, v)).alias("n_treated"), F.count(F.when(is_c, v)).alias("n_control"),
    )
    a = a.withColumns({"vt": F.col("st") / F.col("n_treated"), "vc": F.col("sc") / F.col("n_control")})
    total = F.col("vt") + F.col("vc")
    parts = F.col("vt") ** 2 / (F.col("n_treated") - 1) + F.col("vc") ** 2 / (F.col("n_control") - 1)
    ok = (F.col("n_treated") > 1) & (F.col("n_control") > 1) & (total > 0)
    return a.select(*keys, (F.col("mt") - F.col("mc")).alias("estimate"), F.when(ok, F.sqrt(total)).alias("standard_error"), F.when(ok, total**2 / parts).alias("df"), "n_treated", "n_control")


def empirical_interval(estimate: float, null_draws: Sequence[float], confidence: float = 0.95, alternative: str = "two-sided", null: float = 0.0, center: bool = True, add_one: bool = True) -> Inference:
    """Null draws turned over around the estimate; p counts draws as far out as the estimate."""
    d = np.asarray(null_draws, float)
    d = d[np.isfinite(d)]
    if not len(d):
        raise EstimationError("no finite draws.")
    d = d - d.mean() if center else d
    a = 1 - confidence
    if alternative == "greater":
        interval = (estimate - float(np.quantile(d, 1 - a)), math.inf)
    elif alternative == "less":
        interval = (-math.inf, estimate - float(np.quantile(d, a)))
    else:
        interval = (estimate - float(np.quantile(d, 1 - a / 2)), estimate - float(np.quantile(d, a / 2)))
    return Inference("empirical_quantile", estimate, interval, plus_one_p(estimate - null, d, alternative, add_one), float(d.std(ddof=1)) if len(d) > 1 else None, confidence)


def plus_one_p(observed: float, null: np.ndarray, alternative: str = "two-sided", add_one: bool = True) -> float:
    k = {"greater": null >= observed - 1e-12, "less": null <= observed + 1e-12}.get(alternative, np.abs(null) >= abs(observed) - 1e-12).sum()
    return float((k + add_one) / (len(null) + add_one))


def bca_interval(estimate: float, draws: Sequence[float], jackknife: Sequence[float], confidence: float = 0.95) -> tuple[Interval, dict[str, float]]:
    """Bias-corrected and accelerated interval; half of the ties count as below."""
    d, j = (np.asarray(x, float)[np.isfinite(np.asarray(x, float))] for x in (draws, jackknife))
    if len(d) < 20 or len(j) < 3:
        raise EstimationError("BCa needs 20 draws and 3 jackknife values.")
    below = ((d < estimate).sum() + 0.5 * (d == estimate).sum()) / len(d)
    below = min(max(below, 0.5 / len(d)), 1 - 0.5 / len(d))
    z0 = NORMAL.inv_cdf(below)
    e = j.mean() - j
    a = float((e**3).sum() / (6 * max((e**2).sum(), 1e-300) ** 1.5))
    ends = []
    for p in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + NORMAL.inv_cdf(p)
        ends.append(float(np.quantile(d, NORMAL.cdf(z0 + z / (1 - a * z)))))
    return (ends[0], ends[1]), {"z0": z0, "acceleration": a}


def fieller(numerator: float, denominator: float, v_num: float, v_den: float, cov: float, confidence: float = 0.95, df: float = math.inf) -> tuple[str, list[Interval]]:
    """Set of ratios that a t test doesn't reject: bounded, two half-lines, all numbers, or none."""
    q = t_ppf((1 + confidence) / 2, df) ** 2
    a, b, c = denominator**2 - q * v_den, -2 * (numerator * denominator - q * cov), numerator**2 - q * v_num
    disc = b * b - 4 * a * c
    if abs(a) < 1e-15:
        if abs(b) < 1e-15:
            return ("all_real", [(-math.inf, math.inf)]) if c <= 0 else ("empty", [])
        return "half_line", [(-math.inf, -c / b) if b > 0 else (-c / b, math.inf)]
    if disc < 0:
        return ("all_real", [(-math.inf, math.inf)]) if a < 0 else ("empty", [])
    low, high = sorted(((-b - math.sqrt(disc)) / (2 * a), (-b + math.sqrt(disc)) / (2 * a)))
    return ("bounded", [(low, high)]) if a > 0 else ("disjoint", [(-math.inf, low), (high, math.inf)])


def long_run_variance(values: Sequence[float], lags: int | None = None) -> float:
    """Newey-West variance with Bartlett weights."""
    x = np.asarray(values, float)
    n = len(x)
    if not n:
        return 0.0
    x = x - x.mean()
    lags = min(n - 1, int(4 * (n / 100) ** (2 / 9)) if lags is None else lags)
    total = float(x @ x) / n
    for k in range(1, lags + 1):
        total += 2 * (1 - k / (lags + 1)) * float(x[k:] @ x[:-k]) / n
    return max(total, 0.0)


def long_run_variance_by(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """``*keys, variance`` of every group in one pass of lag windows."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("x", F.col(value) - F.avg(value).over(w))
    ordered = w.orderBy(order)
    x = x.withColumns({f"l{k}": F.lag("x", k).over(ordered) for k in range(1, lags + 1)})
    total = F.sum(F.col("x") * F.col("x"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("x") * F.col(f"l{k}")), F.lit(0.0))
    return x.groupBy(*keys).agg(F.greatest(total / F.count(F.lit(1)), F.lit(0.0)).alias("variance"))


def block_length(residuals: np.ndarray) -> int:
    """Longer blocks for stronger first-order correlation."""
    n = len(residuals)
    if n < 3:
        return 1
    x = residuals - residuals.mean()
    rho = float(np.clip((x[1:] @ x[:-1]) / max(x @ x, 1e-300), -0.95, 0.95))
    grown = (2 * rho * rho / max((1 - rho * rho) ** 2, 1e-6)) ** (1 / 3) * n ** (1 / 3)
    return int(np.clip(round(max(grown, n ** (1 / 3))), 1, max(1, n // 2)))


def cumulative_residual_interval(estimate: float, residuals: Sequence[float], n_post: int, parameter_variance: float = 0.0, df: float | None = None, confidence: float = 0.95, alternative: str = "two-sided", draws: int = 4000, seed: int = 0) -> Inference:
    """Sums of circular blocks of residuals as the noise of a cumulative effect; few blocks widen the interval."""
    r = np.asarray(residuals, float)
    r = r[np.isfinite(r)]
    n = len(r)
    if n < 2:
        raise EstimationError("two residuals are needed at least.")
    r = r - r.mean()
    b = min(block_length(r), max(1, n_post))
    rng = np.random.default_rng(seed)
    blocks = -(-n_post // b)
    starts = rng.integers(0, n, (draws, blocks))
    at = (starts[:, :, None] + np.arange(b)) % n
    noise = r[at].reshape(draws, -1)[:, :n_post].sum(1)
    if parameter_variance > 0:
        noise = noise + rng.normal(0, math.sqrt(parameter_variance), draws)
    eff = df if df is not None else max(1.0, n / b - 1)
    noise = noise * (t_ppf((1 + confidence) / 2, eff) / NORMAL.inv_cdf((1 + confidence) / 2)) * math.sqrt(n / max(1, n - 1))
    out = empirical_interval(estimate, noise, confidence, alternative)
    return Inference("block_residual_bootstrap", estimate, out.interval, out.p_value, float(noise.std(ddof=1)), confidence, {"block_length": b, "df": eff})


def jackknife(values: Sequence[Any], statistic: Callable[[list[Any]], float], confidence: float = 0.95, null: float = 0.0, alternative: str = "two-sided") -> Inference:
    """Leave one unit out; t with n - 1 degrees of freedom."""
    rows = list(values)
    n = len(rows)
    if n < 3:
        raise EstimationError("three units are needed at least.")
    left = np.array([statistic(rows[:i] + rows[i + 1 :]) for i in range(n)])
    whole = statistic(rows)
    se = math.sqrt((n - 1) / n * float(((left - left.mean()) ** 2).sum()))
    return Inference("jackknife", whole, t_interval(whole, se, n - 1, confidence), t_p_value(whole, se, n - 1, null, alternative), se, confidence, {"leave_one_out": left.tolist(), "influence": (whole - left).tolist()})


def bootstrap(values: Sequence[Any], statistic: Callable[[list[Any]], float], strata: Sequence[Any] | None = None, draws: int = 1000, seed: int = 0, confidence: float = 0.95, method: str = "bca", null: float = 0.0, alternative: str = "two-sided") -> Inference:
    """Units drawn with replacement, within strata if given; draws that fail are left out."""
    rows = list(values)
    groups: dict[Any, list[int]] = {}
    for i, s in enumerate(strata if strata is not None else [0] * len(rows)):
        groups.setdefault(s, []).append(i)
    rng = np.random.default_rng(seed)
    got = []
    for _ in range(draws):
        pick = [rows[i] for g in groups.values() for i in np.array(g)[rng.integers(0, len(g), len(g))]]
        try:
            v = statistic(pick)
        except (EstimationError, ZeroDivisionError, FloatingPointError):
            continue
        if math.isfinite(v):
            got.append(v)
    if len(got) < 2:
        raise EstimationError("too few draws gave a value.")
    d, whole = np.array(got), statistic(rows)
    low, high = (float(np.quantile(d, p)) for p in ((1 - confidence) / 2, (1 + confidence) / 2))
    interval, details = (low, high), {"draws": len(got), "interval": "percentile"}
    if method == "basic":
        interval, details["interval"] = (2 * whole - high, 2 * whole - low), "basic"
    elif method == "bca":
        left = []
        for i in range(len(rows)):
            try:
                left.append(statistic(rows[:i] + rows[i + 1 :]))
            except (EstimationError, ZeroDivisionError):
                continue
        try:
            interval, extra = bca_interval(whole, d, left, confidence)
            details |= {**extra, "interval": "bca"}
        except EstimationError:
            pass
    return Inference("bootstrap", whole, interval, plus_one_p(whole - null, d - d.mean(), alternative), float(d.std(ddof=1)), confidence, details)


def difference_in_means(outcomes: dict[Any, float], treated: Iterable[Any]) -> float:
    chosen = set(treated)
    t = [v for k, v in outcomes.items() if k in chosen]
    c = [v for k, v in outcomes.items() if k not in chosen]
    return sum(t) / len(t) - sum(c) / len(c)


def randomization_test(outcomes: dict[Any, float], treated: Sequence[Any], assignments: Iterable[Sequence[Any]] | None = None, exact: bool = True, alternative: str = "two-sided", null: float = 0.0, confidence: float = 0.95, grid: int = 401, most: int = 100_000) -> Inference:
    """Fisher test over all (or the given) assignments, with an interval by inverting the test on a grid."""
    units = list(outcomes)
    if assignments is None:
        if math.comb(len(units), len(treated)) > most:
            raise ValidationError(f"more than {most} assignments.", "Pass a sample of assignments and exact=False.")
        assignments = combinations(units, len(treated))
    rows = [frozenset(a) for a in assignments]
    if exact and frozenset(treated) not in rows:
        raise ValidationError("the observed assignment isn't among the feasible ones.", "Check the policy.")
    z = np.array([[u in a for u in units] for a in rows], float)
    y = np.array([outcomes[u] for u in units], float)
    seen = np.array([u in set(treated) for u in units], float)
    n1, n0 = z.sum(1), (1 - z).sum(1)
    stat = lambda v: (z @ v) / n1 - ((1 - z) @ v) / n0
    whole = float(seen @ y / seen.sum() - (1 - seen) @ y / (1 - seen).sum())

    def p_at(tau: float) -> float:
        shifted = y - tau * seen
        return plus_one_p(whole - tau, stat(shifted), alternative, not exact)

    spread = max(float(np.ptp(y)), abs(whole), 1e-9)
    interval = None
    for _ in range(5):
        taus = np.linspace(whole - spread, whole + spread, grid)
        kept = [t for t in taus if p_at(t) >= 1 - confidence]
        if kept and kept[0] > taus[0] and kept[-1] < taus[-1]:
            interval = (float(kept[0]), float(kept[-1]))
            break
        spread *= 2
    if kept and interval is None:
        interval = (-math.inf if kept[0] == taus[0] else float(kept[0]), math.inf if kept[-1] == taus[-1] else float(kept[-1]))
    if interval and alternative == "greater":
        interval = (interval[0], math.inf)
    if interval and alternative == "less":
        interval = (-math.inf, interval[1])
    return Inference("randomization_test", whole, interval, p_at(null), None, confidence, {"assignments": len(rows), "exact": exact, "null_statistics": sorted(stat(y - null * seen).tolist())})


def randomization_by(df: DataFrame, unit: str, value: str, treated: str) -> DataFrame:
    """``assignment, statistic, observed``: difference in means under every assignment of as many units.

    Assignments are the bit masks with as many bits as treated units, for up to 20 units, which bounds both sides.
    """
    order = Window.orderBy(unit)
    units = df.select(F.col(value).cast("double").alias("y"), F.col(treated).cast("int").alias("z"), (F.row_number().over(order) - 1).alias("i"))
    total = units.agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("k"), F.sum(F.col("z") * F.pow(F.lit(2), F.col("i"))).cast("long").alias("mask")).first()
    if total["n"] > 20:
        raise ValidationError("more than 20 units.", "Sample assignments instead.")
    masks = df.sparkSession.range(1 << total["n"]).where(F.bit_count("id") == total["k"])
    flag = F.getbit(F.col("id"), F.col("i"))
    pairs = masks.crossJoin(F.broadcast(units))  # 20 units at most
    return pairs.groupBy("id").agg((F.avg(F.when(flag == 1, F.col("y"))) - F.avg(F.when(flag == 0, F.col("y")))).alias("statistic")).select(F.col("id").alias("assignment"), "statistic", (F.col("id") == total["mask"]).alias("observed"))


def split_conformal(observed: Sequence[float], counterfactual: Sequence[float], calibration: Sequence[float], confidence: float = 0.9) -> Inference:
    """The ceil((n+1)(1-a))-th largest absolute calibration residual, as radius of each post period."""
    scores = np.sort(np.abs(np.asarray(calibration, float)))
    rank = math.ceil((len(scores) + 1) * confidence)
    if rank > len(scores):
        raise EstimationError("too few calibration residuals for this confidence.")
    gaps = np.asarray(observed, float) - np.asarray(counterfactual, float)
    effect, radius = float(gaps.sum()), float(scores[rank - 1]) * len(gaps)
    p = (1 + (scores >= abs(effect) / len(gaps)).sum()) / (len(scores) + 1)
    return Inference("split_conformal", effect, (effect - radius, effect + radius), float(p), None, confidence, {"radius": float(scores[rank - 1])})


def block_conformal_p(pre: np.ndarray, post: np.ndarray, alternative: str = "two-sided") -> float:
    """Share of circular blocks of all residuals that score as high as the post block."""
    every = np.concatenate([pre, post])
    n, k = len(every), len(post)
    means = np.array([every[(i + np.arange(k)) % n].mean() for i in range(n)])
    score = {"greater": means, "less": -means}.get(alternative, np.abs(means))
    seen = score[len(pre)]
    return float((score >= seen - 1e-12).sum() / n)


def conformal_inversion(gaps: Sequence[float], pre: Sequence[float], confidence: float = 0.9, null: float = 0.0, alternative: str = "two-sided", grid: int = 201) -> Inference:
    """Constant effects that the circular block test keeps, as an interval of the cumulative effect."""
    g, r = np.asarray(gaps, float), np.asarray(pre, float)
    mean = float(g.mean())
    width = 4 * max(float(np.std(r)) if len(r) else 0.0, abs(mean), 1e-9)
    taus = np.linspace(mean - width, mean + width, grid)
    kept = [t for t in taus if block_conformal_p(r, g - t, alternative) > 1 - confidence]
    interval = None
    if kept:
        interval = (-math.inf if kept[0] == taus[0] else kept[0] * len(g), math.inf if kept[-1] == taus[-1] else kept[-1] * len(g))
    return Inference("conformal_inversion", float(g.sum()), interval, block_conformal_p(r, g - null / len(g), alternative), None, confidence)


def wild_bootstrap(treatment: Sequence[float], control: Sequence[float], draws: int = 1999, seed: int = 0, confidence: float = 0.95) -> Inference:
    """Rademacher wild bootstrap-t of a difference in means, under the null of no difference."""
    t, c = np.asarray(treatment, float), np.asarray(control, float)
    base = welch(t, c, confidence)
    if not base.standard_error:
        raise EstimationError("no spread within arms.")
    rng = np.random.default_rng(seed)
    e1, e0 = t - t.mean(), c - c.mean()
    a, b = e1 * rng.choice([-1.0, 1.0], (draws, len(t))), e0 * rng.choice([-1.0, 1.0], (draws, len(c)))
    se = np.sqrt(a.var(1, ddof=1) / len(t) + b.var(1, ddof=1) / len(c))
    ts = (a.mean(1) - b.mean(1)) / np.where(se > 0, se, np.inf)
    crit = float(np.quantile(np.abs(ts), confidence))
    return Inference("few_cluster_wild_bootstrap", base.estimate, (base.estimate - crit * base.standard_error, base.estimate + crit * base.standard_error), plus_one_p(base.estimate / base.standard_error, ts), base.standard_error, confidence)


def confidence_sequence(df: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, alpha: float = 0.05) -> DataFrame:
    """Running mean of bounded values with an interval valid at every look: level alpha / (t (t + 1)) at look t."""
    if not high > low:
        raise ValidationError("bounds are out of order.", "low < high.")
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = F.row_number().over(w).cast("double")
    radius = F.lit(high - low) * F.sqrt(F.log(2 * t * (t + 1) / alpha) / (2 * t))
    mean = F.avg(value).over(run)
    return df.select(*keys, order, t.cast("long").alias("look"), mean.alias("mean"), F.greatest(mean - radius, F.lit(float(low))).alias("lower"), F.least(mean + radius, F.lit(float(high))).alias("upper"))


def e_values(df: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, null: float = 0.0, bet: float | None = 1.0, two_sided: bool = False) -> DataFrame:
    """Running e-value exp(bet S - t bet^2 w^2 / 8) of values less ``null``; its running maximum gives an anytime p.

    Without a ``bet`` it is 1 / w, by division: at large S a rounded factor would show in the exponent.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t, s, width = F.row_number().over(w).cast("double"), F.sum(F.col(value) - null).over(run), high - low
    part, cost = (s / max(width, 1e-9), 1 / 8) if bet is None else (bet * s, bet * bet * width * width / 8)
    one = lambda sign: F.exp(F.least(F.lit(709.0), F.greatest(F.lit(-745.0), sign * part - t * cost)))
    e = (one(1.0) + one(-1.0)) / 2 if two_sided else one(1.0)
    rows = df.select(*keys, order, t.cast("long").alias("look"), e.alias("e_value"))
    most = F.max("e_value").over(Window.partitionBy(*keys).orderBy("look").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("p_value", F.least(F.lit(1.0), 1 / F.greatest(most, F.lit(1e-300))))


def adjusted(df: DataFrame, p: str, family: list[str], tie: str, method: str = "holm") -> DataFrame:
    """``adjusted``: Bonferroni, Holm (running maximum) or Benjamini-Hochberg (running minimum from above), by family."""
    names = {"bh": "benjamini_hochberg", "fdr": "benjamini_hochberg", "fdr_bh": "benjamini_hochberg"}
    method = names.get(method, method)
    w = Window.partitionBy(*family)
    tested = F.col(p).isNotNull()
    m = F.sum(tested.cast("int")).over(w)
    up = w.orderBy(F.col(p).asc_nulls_last(), tie)
    if method == "bonferroni":
        out = df.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * m))
    elif method in ("holm", "benjamini_hochberg"):
        rows = df.withColumns({"__m": m, "__r": F.row_number().over(up)})
        scaled = (F.col("__m") - F.col("__r") + 1) * F.col(p) if method == "holm" else F.col(p) * F.col("__m") / F.col("__r")
        rows = rows.withColumn("__s", F.when(tested, scaled))
        ends = F.max("__s").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) if method == "holm" else F.min("__s").over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
        out = rows.withColumn("adjusted", F.least(F.lit(1.0), ends)).drop("__m", "__r", "__s")
    elif method == "none":
        out = df.withColumn("adjusted", F.col(p))
    else:
        raise ValidationError(f"unknown method {method!r}.", "Use none, bonferroni, holm or benjamini_hochberg.")
    return out.withColumn("adjusted", F.when(tested, F.col("adjusted")))


def max_t_stepdown(observed: DataFrame, draws: DataFrame, add_one: bool = True) -> DataFrame:
    """Westfall-Young p of ``hypothesis, statistic`` from joint null draws ``draw, hypothesis, statistic``.

    Hypotheses are ranked by size; each draw's running maximum from the least up is compared at every rank, and p are
    made to rise with rank.
    """
    ranked = observed.select("hypothesis", F.abs("statistic").alias("seen"), F.row_number().over(Window.orderBy(F.desc(F.abs("statistic")), "hypothesis")).alias("rank"))
    joint = draws.select("draw", "hypothesis", F.abs("statistic").alias("null")).join(F.broadcast(ranked), "hypothesis")
    joint = joint.withColumn("most", F.max("null").over(Window.partitionBy("draw").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)))
    one = int(add_one)
    p = joint.groupBy("hypothesis", "seen", "rank").agg(((F.sum((F.col("most") >= F.col("seen") - 1e-12).cast("int")) + one) / (F.count(F.lit(1)) + one)).alias("p"))
    return p.select("hypothesis", "seen", "rank", F.max("p").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def block_conformal_by(series: DataFrame, key: str, length: int) -> DataFrame:
    """``key, p_value`` of the last ``length`` of ``key, i, n, e`` (places from 0, count, residual), by circular blocks.

    Each residual goes to the ``length`` blocks that hold it, so blocks are one aggregate, not a self-join.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("back")
    rows = series.select(key, "i", "n", "e", at).withColumn("start", F.pmod(F.col("i") - F.col("back"), F.col("n")))
    blocks = rows.groupBy(key, "start", "n").agg(F.abs(F.avg("e")).alias("score"))
    seen = F.max(F.when(F.col("start") == F.col("n") - length, F.col("score"))).over(Window.partitionBy(key))
    return blocks.withColumn("seen", seen).groupBy(key).agg(share(F.col("score") >= F.col("seen") - 1e-12).alias("p_value"))


def jackknife_by(units: DataFrame, unit: str, treated: str, value: str) -> DataFrame:
    """``standard_error, n`` of a difference in means when each unit is left out: arm totals less a unit's own part."""
    z, v = F.col(treated), F.col(value)
    arm = Window.partitionBy(treated)
    mean = lambda k: F.avg(F.when(z == k, v)).alias(f"m{k}")
    means = units.agg(mean(1), mean(0))  # one row
    left = (F.sum(v).over(arm) - v) / F.nullif(F.count(F.lit(1)).over(arm) - 1, F.lit(0))
    rows = units.select(unit, treated, left.alias("left")).crossJoin(F.broadcast(means))
    d = F.when(F.col(treated) == 1, F.col("left") - F.col("m0")).otherwise(F.col("m1") - F.col("left"))
    n = F.count(F.lit(1))
    return rows.select(d.alias("d")).agg(F.sqrt((n - 1) * F.var_pop("d")).alias("standard_error"), n.alias("n"))


def covariance_from_pairs(pairs: Sequence[tuple[float, float]]) -> float | None:
    """Sample covariance of pairs; none for fewer than two."""
    m = np.asarray([p for p in pairs if all(map(math.isfinite, p))], float)
    return float(np.cov(m.T, ddof=1)[0, 1]) if len(m) >= 2 else None


def leave_one_out_sensitivity(values: Sequence[Any], statistic: Callable[[list[Any]], float]) -> list[dict[str, float]]:
    """The statistic without each unit, and how far that moves it, the most influential first."""
    rows = list(values)
    whole = statistic(rows)
    out = [{"unit": i, "estimate": (left := statistic(rows[:i] + rows[i + 1 :])), "influence": whole - left} for i in range(len(rows))]
    return sorted(out, key=lambda r: (-abs(r["influence"]), r["unit"]))


def relative_interval(interval: Interval | None, observed_total: float) -> Interval | None:
    """Ends of an effect's interval as lifts over what there would have been without it."""
    if interval is None or not all(map(math.isfinite, interval)) or any(abs(observed_total - e) <= 1e-12 for e in interval):
        return None
    low, high = sorted(e / abs(observed_total - e) for e in interval)
    return low, high
