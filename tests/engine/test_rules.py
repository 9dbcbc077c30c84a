import numpy as np
import pytest

from terralift.operators import estimators
from terralift.plans import method_queries, store_queries


@pytest.mark.parametrize(("name", "expected"), [("inference_values", store_queries.INFERENCE), ("rule_values", store_queries.RULES), ("estimator_steps", store_queries.STEPS), ("file_round_trips", store_queries.ROUND_TRIPS)])
def test_values_worked_out_by_hand(spark, tmp_path, name, expected):
    got = {r["name"]: r["value"] for r in store_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: float(v) for k, v in expected.items()}, abs=1e-7)


def test_completion_of_an_additive_matrix():
    i, d = np.arange(6)[:, None], np.arange(84)[None, :]
    clean = 100 + 4 * i + 8 * np.sin(2 * np.pi * d / 7) + 0.45 * d
    hidden = (i < 2) & (d >= 56)
    for shrink, rank in ((0.0, 1), (0.0, 3), (5.0, 5)):
        made = estimators.soft_impute(clean, ~hidden, shrink, rank, rounds=20_000, tolerance=1e-10)
        assert np.abs(made - clean)[hidden].max() < 1e-4
    assert method_queries.RECOVERY["did"] == 1e-8
