"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta the of and river stone cloud über naïve 東京 ход x".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType())])


def texts(seed: int = 1, number: int = 40) -> list[str | None]:
    draw = random.Random(seed)
    made: list[str | None] = [" ".join(draw.choices(WORDS, k=draw.randint(1, 80))) for _ in range(number)]
    return [*made, made[0], made[0], made[1] + "\t\x0b" + made[2], made[3].upper(), None, "", " \n ", "a", "🙂" * 300, "z" * 5000, "!?" * 700]


def documents(spark, rows: list[str | None] | None = None):
    """Documents with null ids and texts, repeated rows and columns named like the operators' own."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "clash", "clash") for i, t in enumerate(rows)]
    if data:
        data += [data[0], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS).repartition(3)
