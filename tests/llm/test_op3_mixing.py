import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terralift.llm import op3_mixing
from tests.llm.data import documents, texts


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        rows = op3_mixing.permuted(op3_mixing.permutation_columns(spark.range(n), F.lit(n), "b_"), "id", "b_", F.lit(11)).collect()
        assert sorted(r["id"] for r in rows) == list(range(n))
    wide = op3_mixing.permuted(op3_mixing.permutation_columns(spark.range(1000), F.lit(1 << 40), "b_"), "id", "b_", F.lit(3)).collect()
    assert len({r["id"] for r in wide}) == 1000 and all(0 <= r["id"] < 1 << 40 for r in wide)


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **{s: 3 * sizes[s] for s in stopped}}
        stopped |= over


def test_mix(spark):
    rows = [t for i in range(12) for t in texts(i, 40)]
    docs = documents(spark, rows)
    local = docs.collect()
    sizes: dict = defaultdict(int)
    for r in local:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = plain_targets(sizes)
    got = op3_mixing.mix_sizes(docs, block=8).collect()
    assert len(got) == len(local)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in local)
    taken: dict = defaultdict(int)
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    for r in got:
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, n in taken.items():
        assert n == pytest.approx(want[s], abs=30, rel=0.02)
    assert Counter(map(tuple, got)) == Counter(map(tuple, op3_mixing.mix_sizes(docs.repartition(2), block=8).collect()))
    # texts of the mix hold just the words taken
    mixed = op3_mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts_of = {r["doc_id"]: set(plain(r["text"])) for r in local}
    for r in mixed.collect():
        if r["doc_id"]:
            assert set(plain(r["text"])) <= texts_of[r["doc_id"]]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert words == sum(taken.values())


@pytest.mark.parametrize("weights", [[10_240, 5_000, 77, 3], [1], [1024] * 40, [3_000_000, 1]])
def test_shards_draw_multinomial_counts(spark, weights):
    sources = spark.createDataFrame(list(enumerate(weights)), "rank long, weight long")
    rows = op3_mixing.shard_counts(sources, shard=16).collect()
    slots = (sum(weights) + 512) // 1024
    by_shard, numbers = Counter(), defaultdict(list)
    for r in rows:
        by_shard[r["shard"]] += r["n"]
        numbers[r["rank"]] += range(r["first"], r["first"] + r["n"])
    want = {i: min(16, slots - 16 * i) for i in range(-(-slots // 16))}
    assert dict(by_shard) == want
    for rank, found in numbers.items():  # a source's slots are numbered without gaps
        assert sorted(found) == list(range(len(found)))
        due = weights[rank] / 1024
        assert abs(len(found) - due) <= 1 + 4 * max(1, len(want)) ** 0.5
    drawn = {(r["rank"], r["shard"]): r["n"] for r in rows}
    assert len(drawn) <= len(rows)


def test_columns_called_like_the_plans(spark):
    names = ["plans", "ats", "tie", "rank", "size", "block", "at", "parts", "p", "bucket", "target"]
    docs = documents(spark, texts(3, 60))
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    mixed = op3_mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns and mixed.where("plans = 'clash'").count() == mixed.count() > 0
    assert op3_mixing.mix_sizes(docs, block=8).count() == docs.count()


def test_hot_and_missing_ids(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 50)), "hot") for i in range(300)] + [(7, " ".join(["v"] * (1 + i % 40)), "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op3_mixing.mix_sizes(docs, block=4).collect()
    assert len(got) == 600 and sum(r["taken"] for r in got) == pytest.approx(got[0]["target"], rel=0.02)


def test_nothing(spark):
    assert op3_mixing.mix_sizes(documents(spark, [])).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in op3_mixing.mix_sizes(only).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    one = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in op3_mixing.mix_sizes(one).collect()] == [(3.0, 3)]
