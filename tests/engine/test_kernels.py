import math

import numpy as np
import pytest

from terralift.errors import EstimationError
from terralift.functions import linear, stats
from terralift.operators import inference


def test_distributions():
    assert stats.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, abs=1e-12)
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert stats.t_ppf(0.975, math.inf) == pytest.approx(1.959963984540054)
    assert stats.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    low, high = stats.clopper_pearson(3, 10)
    assert (low, high) == pytest.approx((0.06673951, 0.65245285), abs=1e-7)
    assert stats.binomial_two_sided(3, 10) == pytest.approx(0.34375)


def test_noncentral_t_by_simulation():
    rng = np.random.default_rng(3)
    for df, ncp, x in ((5, 1.0, 2.0), (12, 2.8, 1.5), (30, -0.7, 0.2), (8, 0.0, 1.0), (40, 6.0, 5.0)):
        draws = (rng.normal(size=400_000) + ncp) / np.sqrt(rng.chisquare(df, 400_000) / df)
        assert stats.noncentral_t_cdf(x, df, ncp) == pytest.approx((draws <= x).mean(), abs=4e-3)
    ncp = stats.two_sided_ncp(0.05, 0.8, 20)
    crit = stats.t_ppf(0.975, 20)
    assert 1 - stats.noncentral_t_cdf(crit, 20, ncp) + stats.noncentral_t_cdf(-crit, 20, ncp) == pytest.approx(0.8, abs=1e-9)


def test_hand_checked_inference():
    r = inference.randomization_test({"a": 4, "b": 3, "c": 1, "d": 0}, ["a", "b"])
    assert (r.estimate, r.p_value) == (3, pytest.approx(2 / 6))
    assert sorted(r.details["null_statistics"]) == [-3, -1, 0, 0, 1, 3]
    assert inference.randomization_test({"a": 4, "b": 3, "c": 1, "d": 0}, ["a", "b"], alternative="greater").p_value == pytest.approx(1 / 6)
    e = inference.empirical_interval(5, [-4, -1, 0, 2, 8], 0.8, "greater")
    assert e.p_value == pytest.approx(2 / 6) and e.interval[1] == math.inf
    assert inference.long_run_variance([1, -0.5, 0.75, -0.25, 0.5], 1) == pytest.approx(0.0795)
    c = inference.split_conformal([112, 118], [100, 105], [1, -1, 1, -1], 0.8)
    assert c.details["radius"] == 1 and c.interval == (23, 27) and c.p_value == pytest.approx(1 / 5)
    j = inference.jackknife([1, 3, 5], lambda v: sum(v) / len(v))
    assert j.standard_error == pytest.approx(math.sqrt(4 / 3)) and j.details["leave_one_out"] == [4, 3, 2]
    assert inference.welch([2, 2], [2, 2]).interval == (0, 0)


def test_fieller_kinds():
    kind, ((low, high),) = inference.fieller(10, 5, 0.01, 0.01, 0.0)
    assert kind == "bounded" and low < 2 < high
    assert inference.fieller(10, 0.1, 1, 1, 0.0)[0] in ("disjoint", "all_real")


def test_block_conformal_counts_circular_blocks():
    assert inference.block_conformal_p(np.zeros(9), np.array([5.0])) == pytest.approx(0.1)


def test_coverage_of_cumulative_interval():
    rng = np.random.default_rng(11)
    for rho in (0.0, 0.5):
        hits = 0
        for s in range(120):
            x = np.zeros(74)
            for i in range(1, 74):
                x[i] = rho * x[i - 1] + rng.normal()
            out = inference.cumulative_residual_interval(float(x[60:].sum() - 14 * x[:60].mean()), x[:60] - x[:60].mean(), 14, parameter_variance=14**2 * float(x[:60].var()) / 60 * (1 + rho) / (1 - rho), draws=800, seed=s)
            hits += out.interval[0] <= 0 <= out.interval[1]
        assert hits / 120 >= 0.88


def test_simplex_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    w = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    assert linear.simplex_weights(x, x @ w) == pytest.approx(w, abs=1e-4)


def test_forward_selection_takes_what_helps():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(size=60), rng.normal(size=60)
    y = 3 * good + 0.1 * rng.normal(size=60)
    assert linear.forward_select(y, np.ones((60, 1)), {"bad": bad, "good": good}) == ["good"]
    with pytest.raises(EstimationError):
        inference.bca_interval(0, [1, 2], [1, 2])
