import math
import random
from collections import defaultdict

import numpy as np
import pytest

from terralift.llm import queries
from terralift.llm.op4_topk import exact_topk

TOP = 2**63 - 1


def plain(rows, asked, k):
    """Every query against every row, in Python integers."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [max(-TOP - 1, min(TOP, math.floor(256 * x) if math.isfinite(256 * x) else TOP * (1 if x > 0 else -1))) for x in v]

    kept = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = defaultdict(set)
    for q, v in kept:
        if asked(q):
            scored = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in kept if i != q and len(w) == len(v)]
            out[q].add(tuple((r + 1, i, s) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])))
    return {q: lists for q, lists in out.items() if lists != {()}}


def found(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: {tuple(sorted(rows))} for q, rows in out.items()}


SCHEMA = "vec_id long, embedding array<float>, id string, tile long, v string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in rows], schema).repartition(3)


def vectors(seed, n, dim=6):
    draw = random.Random(seed)
    return [[draw.choice([-1.0, -0.5, 0.0, 0.25, 1.0, draw.uniform(-2, 2)]) for _ in range(dim)] for _ in range(n)]


def test_against_every_pair(spark):
    rows = list(enumerate(vectors(1, 300)))
    rows += [(1000 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(5, rows[5][1]), (7, rows[7][1])]  # repeated rows
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] + [1.0] * 5), (403, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, -1.0]), (502, [])]  # other lengths
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = table(spark, rows)
    got = found(exact_topk(df.where("vec_id % 5 = 0"), df, k=5, query_tile=16, data_tile=24, fan_in=2))
    assert got == plain(rows, lambda i: i % 5 == 0, 5)
    assert 500 in got and [x[1] for x in sorted(next(iter(got[500])))] == [501]  # fewer than five


def test_large_components(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-3, 3) for _ in range(4)]) for i in range(40)]
    rows += [(50, [2.0**54, 1.0, 0.0, 0.0]), (51, [-(2.0**60), 0.0, 0.5, 0.0]), (52, [1e300, 0.0, 0.0, -1.0]), (53, [0.0, 2.0**40, 2.0**41, 0.0])]
    df = table(spark, rows, SCHEMA.replace("float", "double"))
    assert found(exact_topk(df, df, k=44, query_tile=8, data_tile=16)) == plain(rows, lambda i: True, 44)


def test_few_rows(spark):
    none = table(spark, [])
    assert exact_topk(none, none).count() == 0
    one = table(spark, [(0, [1.0])])
    assert exact_topk(one, one).count() == 0


def test_query(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(vectors(2, 120, 8))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert found(queries.op4_exact_topk(spark, str(tmp_path))) == plain(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("k", [1, 3])
def test_small_k(spark, k):
    rows = [(i, [float(i % 4), 1.0]) for i in range(30)]
    df = table(spark, rows)
    assert found(exact_topk(df, df, k=k, query_tile=4, data_tile=4, fan_in=3)) == plain(rows, lambda i: True, k)


def test_no_side_is_broadcast(spark):
    """Tiles of queries once grew by a copy for each tile of vectors after Spark had taken their size for a broadcast."""
    rows = list(enumerate(vectors(5, 200)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = table(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        best = exact_topk(df.where("vec_id % 5 = 0"), df, k=5, query_tile=8, data_tile=16)
        assert found(best) == plain(rows, lambda i: i % 5 == 0, 5)
        assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_blocks_ties_and_floods(spark):
    rows = [(i, [float(i // 40), 1.0, -1.0]) for i in range(400)]  # every tile better than the one before, and ties
    rows += [(1000 - i, [9.0, 1.0, -1.0]) for i in range(300)]
    df = table(spark, rows)
    got = found(exact_topk(df.where("vec_id % 3 = 0"), df, k=2, query_tile=4, data_tile=128, block_bytes=256))
    assert got == plain(rows, lambda i: i % 3 == 0, 2)
