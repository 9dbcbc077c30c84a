"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralift.llm.common import is_held_out, materialize


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``label int, text``: at most ``per_class`` labelled ids of each class, none held out, in hash order.

    Repeated labels of an id count once (the mean, rounded up at one half); null labels and ids are left out. The id
    list has at most ``2 * per_class`` rows, which bounds what is broadcast; a repeated document counts each time.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(f"`{label}`").cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("__id").isNotNull() & ~is_held_out(F.col("__id")))
    known = known.groupBy("__id").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    order = [F.xxhash64(F.col("__id").cast("string"), F.lit(11)), F.col("__id")]
    chosen = known.where("label = 1").orderBy(*order).limit(per_class).union(known.where("label = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "__id").select("label", "text"))


def class_share(labels: DataFrame, label: str) -> float:
    """Share of 1 among all labels that may be learnt from; a half if there are none."""
    got = labels.where(~is_held_out(F.col("doc_id"))).agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
    return 0.5 if got is None else float(got)
