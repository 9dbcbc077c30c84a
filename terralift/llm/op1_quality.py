"""Quality classifier: Bradley-Terry ranking on feature differences, threshold by score quantile.

Each document is a vector of whole-text statistics (case, symbols, repetition, line structure). A preference pair is
a document labelled 1 against one labelled 0; the weights minimise the logistic loss of the difference of their
scores, by Newton steps. The threshold is the score quantile of the training documents, weighted by the classes' true
shares, at which most labels come out right; the final score puts it at ``cut``.

Cases: null and empty texts are scored by their (zero) statistics; without labels of both classes every score is the
same, a half; repeated rows are scored each; other columns (``quality`` or ``text2`` in documents, say) are ignored
unless named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.llm.common import map_text
from terralift.llm.labelled import class_share, training_sample

PER_CLASS = 10_000
#: Symbols that prose seldom has.
SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
STOPS = b".,;:?"
N_FEATURES = 14


def features(texts: list[str]) -> np.ndarray:
    """One row of ``N_FEATURES`` statistics for each whole text."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        upper, lower = counts[65:91].sum(), counts[97:123].sum()
        total = counts.sum()
        kinds = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        again = sum(map(operator.eq, words, words[1:]))
        lines = text.split("\n")
        out[i] = (
            math.log1p(n),
            upper / max(1, upper + lower),
            min(3.0, counts[list(SYMBOLS)].sum() / n),
            min(3.0, counts[list(STOPS)].sum() / n),
            kinds / n,
            math.log(kinds + 1) / math.log(n + 2),
            pairs / max(1, n - 1) if n > 1 else 1.0,
            math.log(pairs + 2) / math.log(n + 2),
            again / max(1, n - 1),
            counts[48:58].sum() / total,
            counts[128:].sum() / total,
            math.log(total / n),
            len(set(lines)) / len(lines),
            min(1.0, len(lines) / n),
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    """Centre, scale and weights of the statistics, and the shift that puts the threshold at ``cut``."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.array(self.centre)) / np.array(self.scale), -6, 6) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not any(self.weights):
            return np.full(len(x), 0.5)
        z = self.raw(x) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, share: float, cut: float, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 17) -> QualityModel:
    """Bradley-Terry weights from random pairs of a good and a bad row, then the threshold."""
    if not len(good) or not len(bad):
        return QualityModel((0.0,) * N_FEATURES, (1.0,) * N_FEATURES, (0.0,) * N_FEATURES, 0.0, cut)
    both = np.concatenate([good, bad])
    centre, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    g, b = (np.clip((x - centre) / scale, -6, 6) for x in (good, bad))
    draw = np.random.default_rng(seed)
    d = g[draw.integers(0, len(g), pairs)] - b[draw.integers(0, len(b), pairs)]
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # chance that the pair comes out wrong
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model = QualityModel(tuple(centre), tuple(scale), tuple(w), 0.0, cut)
    scores = np.concatenate([model.raw(good), model.raw(bad)])
    truth = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    weight = np.concatenate([np.full(len(good), share / len(good)), np.full(len(bad), (1 - share) / len(bad))])
    order = np.argsort(scores)
    scores, truth, weight = scores[order], truth[order], weight[order]
    # cutting below place i: what is under it and good, and what is over it and bad, come out wrong
    wrong = np.concatenate([[0], np.cumsum(weight * truth)]) + (weight * (1 - truth)).sum() - np.concatenate([[0], np.cumsum(weight * (1 - truth))])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    at = int(best[len(best) // 2])
    low, high = scores[max(0, at - 1)], scores[min(at, len(scores) - 1)]
    return QualityModel(tuple(centre), tuple(scale), tuple(w), float((low + high) / 2), cut)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cut: float = 0.3) -> QualityModel:
    """Learn from at most ``per_class`` labelled documents of each class that are not held out."""
    sample = training_sample(docs, labels, "quality", per_class)
    rows = map_text(sample, lambda texts: {"x": list(features(texts))}, [T.StructField("x", T.ArrayType(T.DoubleType()))], keep=["label"]).limit(4 * per_class).collect()
    x, y = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["label"] for r in rows])
    return fit_pairs(x[y == 1], x[y == 0], class_share(labels, "quality"), cut)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``."""
    scored = map_text(docs, lambda texts: {"score": model.score(features(texts))}, [T.StructField("score", T.DoubleType())], keep=keep)
    return scored.withColumn("predicted", (F.col("score") >= model.cut).cast("int"))
