import random

import numpy as np
import pytest

from terralift.llm import op1_quality, op6_toxicity
from tests.llm.data import DOCS, documents, texts


def labelled(spark, number: int = 900):
    """Documents with planted insults and noise, and labels of two thirds of them."""
    draw = random.Random(7)
    words = "alpha beta gamma delta river stone cloud the of and über naïve".split()
    docs, labels = [], []
    for i in range(number):
        toxic, noisy = i % 4 == 0, i % 5 == 0
        w = draw.choices(words, k=draw.randint(20, 120))
        if toxic:
            for _ in range(draw.randint(2, 5)):
                w.insert(draw.randrange(len(w)), draw.choice(["idiot", "moron", "scum"]) if i % 8 else "vilo" + draw.choice("abcdefgh") + draw.choice("klm"))
        text = " ".join(w)
        if noisy:
            text = draw.choice([text.upper(), " ".join(x + "$$$" for x in w), " ".join(w[:1] * 40)]) if not toxic else text + " " + " ".join(["$$$"] * len(w) * 2)
        docs.append((i, text, "en", "s", None, "clash", "clash"))
        if i % 3:
            labels.append((i, int(not noisy), int(toxic)))
    labels += [labels[0], (None, 1, 1), (10**9, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def data(spark):
    return labelled(spark)


def test_quality_on_held_out(spark, data):
    docs, labels = data
    model = op1_quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in op1_quality.score_quality(docs, model, ["doc_id"]).collect()}
    wrong = [r["doc_id"] for r in labels.where("doc_id < 10000").collect() if rows[r["doc_id"]]["predicted"] != r["quality"]]
    assert len(wrong) < 0.05 * labels.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_toxicity_on_all(spark, data):
    docs, labels = data
    model = op6_toxicity.fit(docs, labels)
    assert any(u.startswith("vilo") for u in model.lexicon)
    rows = {r["doc_id"]: r for r in op6_toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    wrong = [r["doc_id"] for r in labels.where("doc_id < 10000").collect() if rows[r["doc_id"]]["predicted"] != r["toxic"]]
    assert len(wrong) < 0.04 * labels.count()
    kept = op6_toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if not r["predicted"]}


@pytest.mark.parametrize("module", [op1_quality, op6_toxicity])
def test_awkward_tables(spark, data, module):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    score = module.score_quality if module is op1_quality else module.score_toxicity
    for model in (module.fit(docs, none), module.fit(*data)):
        rows = score(docs, model, ["doc_id", "text", "n_chars"]).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert score(documents(spark, []), model, ["doc_id"]).count() == 0


def test_maximal_segments():
    def plain(scores):
        """All maximal segments by definition: the best segment, then the best on either side of it."""
        out = []

        def go(a, b):
            best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 1e-12:
                return
            i, j = -best[2], best[3]
            go(a, i)
            out.append((i, j, best[0]))
            go(j, b)

        go(0, len(scores))
        return out

    draw = random.Random(2)
    for _ in range(400):
        s = [draw.choice([-1, 1]) * draw.random() for _ in range(draw.randint(0, 14))]
        got, want = op6_toxicity.maximal_segments(s), plain(s)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_pairs_without_a_class():
    empty = np.zeros((0, op1_quality.N_FEATURES))
    model = op1_quality.fit_pairs(op1_quality.features([t or "" for t in texts()]), empty, 1.0, 0.3)
    assert (model.score(op1_quality.features(["x", ""])) == 0.5).all()
