import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralift.llm import op10_cws
from tests.llm.data import documents, texts


def terms(text: str) -> Counter:
    words = text.split()
    return Counter([*words, *zip(words, words[1:], strict=False)])


def jaccard(a: str, b: str) -> float:
    x, y = terms(a), terms(b)
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 1.0


def test_collisions_follow_generalised_jaccard():
    draw = random.Random(4)
    errors = []
    for _ in range(150):
        pool = [f"w{draw.randint(0, 60)}" for _ in range(120)]
        a = " ".join(draw.choices(pool, k=draw.randint(30, 200)))
        b = " ".join(a.split()[: draw.randint(1, 200)] + draw.choices(pool, k=draw.randint(0, 100)))
        got = op10_cws.likeness(op10_cws.signatures([a], 256), op10_cws.signatures([b], 256))[0]
        errors.append(got - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.045


def test_same_in_any_company():
    many = [t or "" for t in texts(8, 30)]
    together = op10_cws.signatures(many)
    for i, t in enumerate(many):
        assert (op10_cws.signatures([t])[0] == together[i]).all()
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    assert (op10_cws.signatures([long, "x"])[0] == op10_cws.signatures(["y", long])[1]).all()


@pytest.mark.parametrize(("parts", "hot"), [(1, False), (5, False), (5, True)])
def test_table(spark, parts, hot):
    docs = documents(spark, texts(6, 50))
    if hot:  # a third of the rows share an id, a third have none
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, 20).when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
        dealt = Counter(r["part"] for r in op10_cws.with_next(docs, parts=parts).where("not ahead").collect())
        assert max(dealt.values()) < 0.35 * docs.count()
    rows = op10_cws.edited_likeness(docs, parts=parts).collect()
    local = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) tie").collect()
    order = sorted(local, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tie"]))
    want = []
    for r, n in zip(order, [*order[1:], order[0]], strict=True):
        k = len(r["text"]) // 2
        changed = r["text"][: len(r["text"]) - k] + n["text"][:k]
        want.append((r["doc_id"], len(r["text"]), hashlib.sha256(changed.encode()).hexdigest(), op10_cws.packed(op10_cws.signatures([r["text"]]))[0], op10_cws.packed(op10_cws.signatures([changed]))[0]))
    assert Counter(want) == Counter(tuple(r)[:5] for r in rows)
    codes = lambda s: np.frombuffer(bytes.fromhex(s), ">u2")[None, :]
    for r in rows:
        assert r["near_edited"] == op10_cws.likeness(codes(r["fingerprint"]), codes(r["edited_fingerprint"]))[0]
    assert op10_cws.edited_likeness(docs.limit(0)).count() == 0
    if not hot:
        one = op10_cws.edited_likeness(docs.where("doc_id = 3")).collect()
        assert len(one) == 1 and one[0]["near_next"] == 1.0
    plain = op10_cws.fingerprints(docs, keep=["text"]).collect()
    assert {(r["text"] or "", r["fingerprint"]) for r in plain} == {(r["text"], w[3]) for r, w in zip(order, want, strict=True)}
