"""Distribution functions by series and continued fractions; only the standard library is needed."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

NORMAL = NormalDist()


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def bisect(f: Callable[[float], float], low: float, high: float, rounds: int = 200) -> float:
    """Root of an increasing function in [low, high]."""
    for _ in range(rounds):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_cdf(x: float, df: float) -> float:
    if math.isinf(df):
        return NORMAL.cdf(x)
    if math.isinf(x):
        return float(x > 0)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_sf(x: float, df: float) -> float:
    return t_cdf(-x, df)


def t_ppf(p: float, df: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    if math.isinf(df):
        return NORMAL.inv_cdf(p)
    high = 2.0
    while t_cdf(high, df) < max(p, 1 - p):
        high *= 2
    root = bisect(lambda x: t_cdf(x, df) - max(p, 1 - p), 0.0, high)
    return root if p >= 0.5 else -root


def beta_ppf(p: float, a: float, b: float) -> float:
    return bisect(lambda x: beta_inc(a, b, x) - p, 0.0, 1.0)


def noncentral_t_cdf(x: float, df: float, ncp: float) -> float:
    """P(T <= x): a Poisson mixture of incomplete beta terms; the left side by reflection."""
    if x < 0:
        return 1 - noncentral_t_cdf(-x, df, -ncp)
    y = x * x / (df + x * x)
    half = ncp * ncp / 2
    total = NORMAL.cdf(-ncp)
    if y == 0:
        return total
    middle = int(half)
    log_p = -half + middle * math.log(half) - math.lgamma(middle + 1) if half > 0 else (0.0 if middle == 0 else -math.inf)
    log_q = -half + middle * math.log(half) - math.lgamma(middle + 1.5) if half > 0 else -math.lgamma(1.5) if middle == 0 else -math.inf
    for direction in (1, -1):
        j = middle if direction == 1 else middle - 1
        p, q = math.exp(log_p), math.exp(log_q) * ncp / math.sqrt(2)
        if direction == -1:
            if j < 0:
                continue
            p, q = p * middle / half, q * (middle + 0.5) / half
        while j >= 0:
            term = p * beta_inc(j + 0.5, df / 2, y) + q * beta_inc(j + 1, df / 2, y)
            total += term / 2
            if abs(p) + abs(q) < 1e-17 and j > middle + 5 or abs(p) + abs(q) < 1e-17 and direction == -1:
                break
            if direction == 1:
                j += 1
                p, q = p * half / j, q * half / (j + 0.5)
            else:
                p, q = (p * j / half, q * (j + 0.5) / half) if half > 0 else (0.0, 0.0)
                j -= 1
    return min(1.0, max(0.0, total))


def two_sided_ncp(alpha: float, power: float, df: float) -> float:
    """Noncentrality at which a two-sided t test of level ``alpha`` has ``power``."""
    critical = t_ppf(1 - alpha / 2, df)

    def over(ncp: float) -> float:
        return 1 - noncentral_t_cdf(critical, df, ncp) + noncentral_t_cdf(-critical, df, ncp) - power

    high = 2.0
    while over(high) < 0 and high < 1e4:
        high *= 2
    return bisect(over, 0.0, high)


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval."""
    if trials <= 0:
        return 0.0, 1.0
    a = (1 - confidence) / 2
    low = 0.0 if successes == 0 else beta_ppf(a, successes, trials - successes + 1)
    high = 1.0 if successes == trials else beta_ppf(1 - a, successes + 1, trials - successes)
    return low, high


def binomial_two_sided(successes: int, trials: int) -> float:
    """Exact two-sided p of a fair coin: all outcomes no likelier than the one seen."""
    chance = [math.comb(trials, k) for k in range(trials + 1)]
    return min(1.0, sum(c for c in chance if c <= chance[successes]) / 2**trials)


def tail(alternative: str, lower: float, upper: float) -> float:
    """p of an alternative from the chances of so small and so large a value."""
    if alternative == "greater":
        return upper
    if alternative == "less":
        return lower
    return min(1.0, 2 * min(lower, upper))
