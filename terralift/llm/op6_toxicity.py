"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration.

Learning: labelled documents give counts of words and word beginnings by class. Their log-odds are smoothed by a
hierarchy of Dirichlet priors, each beginning's prior being the odds of the shorter one, so that unseen forms of a
known stem are scored by the stem. Every other token has one slightly negative score.

Scoring: a linear-time scan finds all maximal scoring segments of the whole token sequence. A segment of score ``s``
among ``n`` tokens is significant if ``lam * s > ln(K * n)``, the centre of the extreme-value distribution of chance
segments; ``lam`` solves ``E[exp(lam * x)] = 1`` over clean tokens and ``K`` is fitted to clean documents. The excess of
all significant segments is turned to a probability by logistic calibration.

Cases: null and empty texts have no segment and get the lowest score; without labels of both classes every score is a
half less a hair (not toxic); repeated rows are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.llm.common import map_text
from terralift.llm.labelled import class_share, training_sample

PER_CLASS = 8_000
TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7, 8)
PRIOR = 1.0
LEAST_G = 15.0
LEAST_ODDS = 20.0
LEAST_DOCS = 4
CACHE = 200_000


def units(word: str) -> list[str]:
    """A word's beginnings from short to long, marked as such, then the word; capitals are marked, then dropped."""
    if not word.islower():
        word = ("^^" if word.isupper() and len(word) > 1 else "^") + word.lower()
    marks = len(word) - len(word.lstrip("^"))
    return [*[word[: k + marks] + "~" for k in STEMS if len(word) >= k + marks], word]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time.

    Candidates are kept with the sums of scores before and through them. A new positive score joins the nearest
    earlier candidate that starts lower and ends no higher, with all between them.
    """
    left: list[float] = []
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []  # nearest earlier candidate with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        l, r, a = before, total, i
        while True:
            j = len(spans) - 1
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                left.append(l)
                right.append(r)
                spans.append((a, i + 1))
                lower.append(j)
                break
            l, a = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:], lower[j:]
    return [(a, b, r - l) for (a, b), l, r in zip(spans, left, right, strict=True)]


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of units, the score of all other tokens, and the calibration."""

    lexicon: dict[str, float]
    other: float
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    length: float = 0.0
    offset: float = -1e-6


class Scanner:
    """Scores texts by a model; keeps the scores of words it has seen, up to a bound."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.seen: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.seen.get(w)
        if got is None:
            lexicon, got = self.model.lexicon, self.model.other
            for u in reversed(units(w)):
                if u in lexicon:
                    got = lexicon[u]
                    break
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[w] = got
        return got

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments by token. Runs of ordinary tokens count as one step."""
        tokens = TOKEN.findall(text)
        word, other = self.word, self.model.other
        marks = [(i, s) for i, s in enumerate(map(word, tokens)) if s != other]
        if not any(s > 0 for _, s in marks):
            return len(tokens), []
        steps: list[float] = []
        places: list[int] = []
        at = 0
        for i, s in marks:
            if i > at:
                steps.append(other * (i - at))
                places.append(at)
            steps.append(s)
            places.append(i)
            at = i + 1
        return len(tokens), [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(steps)]

    def probability(self, excess: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Long texts hold more chance segments, so length counts against them."""
        z = self.model.slope * np.log1p(excess) + self.model.length * np.log1p(tokens) + self.model.offset
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class with each unit, summed within the task."""
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if y else clean).update({u for w in set(TOKEN.findall(text)) for u in units(w)})
    names = list(toxic)  # what no toxic document has can't raise a score
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["unit", "c1", "c0"])
    names = list(clean)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([clean[u] for u in names], pa.int64())], ["unit", "c1", "c0"])


def lexicon(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of the units that significantly more toxic documents have, each smoothed towards its stem's."""
    out: dict[str, float] = {}
    rate = n1 / n0

    def stems(u: str) -> list[str]:
        marks = len(u) - len(u.lstrip("^"))
        core = u.rstrip("~")
        return [x for k in STEMS if k + marks <= len(core) and (x := core[: k + marks] + "~") != u]

    def odds(u: str) -> float:
        ratio = 1.0
        for x in [*stems(u), u]:
            if x in counts:
                ratio = (counts[x][0] + PRIOR * ratio) / (counts[x][1] * rate + PRIOR)
        return ratio

    for u, (c1, c0) in counts.items():
        expected = (c1 + c0) * n1 / (n1 + n0)
        if c1 < LEAST_DOCS or c1 <= expected:
            continue
        spread = 2 * (c1 * math.log(c1 / expected) + (c0 * math.log(c0 / (c0 + c1) * (n1 + n0) / n0) if c0 else 0.0))
        ratio = odds(u)
        if spread > LEAST_G and ratio > LEAST_ODDS:
            out[u] = math.log(ratio)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled documents of each class that are not held out."""
    sample = training_sample(docs, labels, "toxic", per_class)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, -0.01)
    counted = sample.select("label", "text").mapInArrow(_count, "unit string, c1 long, c0 long").groupBy("unit").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    kept = counted.where(F.col("c1") >= LEAST_DOCS).where(F.col("c1") * n0 > F.col("c0") * (1.5 * n1)).collect()
    words = lexicon({r["unit"]: (r["c1"], r["c0"]) for r in kept}, n1, n0)
    # score of other tokens: the odds that a token is none of the lexicon's
    tokens, marks = _token_counts(sample, ToxicityModel(words, -1e-9))
    s1, s0 = tokens.get(1, 0) + 1, tokens.get(0, 0) + 1
    m1, m0 = (sum(n for _, n in marks.get(y, [])) for y in (1, 0))
    other = min(-0.005, math.log(max(1e-3, 1 - m1 / s1) / (1 - m0 / (s0 + m0))))
    values, counts = (np.array([x[k] for x in marks.get(0, [])], float) for k in (0, 1))
    lam = _lambda(values, counts, other, s0)
    model = ToxicityModel(words, other, lam)
    best = _per_document(sample, model, lambda n, found: max(found, default=0.0))
    clean = [lam * r["value"] - math.log(max(1, r["n"])) for r in best if r["label"] == 0]
    log_k = float(np.mean(clean)) - 0.5772
    model = ToxicityModel(words, other, lam, log_k)
    over = _per_document(sample, model, lambda n, found: sum(max(0.0, lam * s - log_k - math.log(max(1, n))) for s in found))
    x, y, n = (np.array([r[k] for r in over], float) for k in ("value", "label", "n"))
    return ToxicityModel(words, other, lam, log_k, *_logistic(np.log1p(x), np.log1p(n), y, class_share(labels, "toxic")))


def _token_counts(sample: DataFrame, model: ToxicityModel) -> tuple[dict[int, int], dict[int, list[tuple[float, int]]]]:
    """By class: tokens, and how often tokens of the lexicon have each score (no more scores than the lexicon has)."""
    fields = [T.StructField("n", T.LongType()), T.StructField("marks", T.ArrayType(T.DoubleType()))]

    def run(texts: list[str]) -> dict[str, object]:
        scan = Scanner(model)
        tokens = [TOKEN.findall(t) for t in texts]
        return {"n": [len(t) for t in tokens], "marks": [[s for w in t if (s := scan.word(w)) != model.other] for t in tokens]}

    marked = map_text(sample, run, fields, keep=["label"])
    totals = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    found: dict[int, list[tuple[float, int]]] = {}
    for r in marked.select("label", F.explode("marks").alias("score")).groupBy("label", "score").count().orderBy("label", "score").collect():
        found.setdefault(r["label"], []).append((r["score"], r["count"]))
    return totals, found


def _per_document(sample: DataFrame, model: ToxicityModel, value: Callable[[int, list[float]], float]) -> list:
    """``label, n, value``: three numbers of each document of the bounded sample, from its tokens and segment scores."""
    fields = [T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType())]

    def run(texts: list[str]) -> dict[str, object]:
        scan = Scanner(model)
        found = [scan.segments(t) for t in texts]
        return {"n": [n for n, _ in found], "value": [float(value(n, [s for _, _, s in f])) for n, f in found]}

    return map_text(sample, run, fields, keep=["label"]).collect()


def _lambda(marks: np.ndarray, counts: np.ndarray, other: float, tokens: int) -> float:
    """The positive root of E[exp(lam * x)] = 1 over the scores of clean tokens, which are given with their counts."""
    number = counts.sum()
    rest = max(1, tokens - number)

    def over(lam: float) -> float:
        return ((counts * np.exp(lam * marks)).sum() + rest * math.exp(lam * other)) / (rest + number) - 1

    low, high = 1e-3, 5.0
    if not len(marks) or over(high) < 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) > 0 else (mid, high)
    return max(0.05, high)


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Slope, length weight (none above zero) and offset of a logistic fit, classes weighted by their true shares."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    for design in (np.stack([x, n, np.ones_like(x)], 1), np.stack([x, 0 * n, np.ones_like(x)], 1)):
        w = np.array([1.0, 0.0, -1.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
            grad = design.T @ (weight * (p - y)) + 1e-4 * w * [1, 1, 0]
            hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(3)
            w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
        if w[1] <= 0:
            break
    return float(max(w[0], 1e-3)), float(min(w[1], 0.0)), float(w[2])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], cut: float = 0.5, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score``, ``predicted`` and ``n_segments`` (significant passages)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_segments", T.LongType())]
    scanner: list[Scanner] = []

    def run(texts: list[str]) -> dict[str, object]:
        if not scanner:
            scanner.append(Scanner(model))
        scan = scanner[0]
        excess, number, sizes = [], [], []
        for text in texts:
            n, found = scan.segments(text)
            level = model.log_k + math.log(max(1, n))
            over = [v for _, _, s in found if (v := model.lam * s - level) > 0]
            sizes.append(n)
            excess.append(sum(over))
            number.append(len(over))
        return {"score": scan.probability(np.array(excess), np.array(sizes)), "n_segments": number}

    return map_text(docs, run, fields, text=text, keep=keep).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``; rows with null text pass."""
    # the score travels under a name of its own, as documents may have a column "score"
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])
    scored = score_toxicity(renamed, model, keep=renamed.columns, cut=cut, text="__doc_text")
    return scored.where("predicted = 0").select(*[F.col(f"__doc_{c}").alias(c) for c in docs.columns])
