"""A training corpus from ``documents``: reject toxic texts, drop near-duplicates, mask personal data, mix, encode.

Each stage reads all that the one before kept and hands on the columns of ``documents``; the last returns token ids.
Every stage is written as Parquet in the shared checkpoint folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.llm import op3_mixing, op5_bpe, op6_toxicity, op7_pii, op8_simhash
from terralift.llm.common import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scorer doesn't reject."""
    model = op6_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op6_toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return op8_simhash.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, spans of personal data replaced by their kind."""
    return op7_pii.mask_pii(docs, op7_pii.fit(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return op3_mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decodes``: ids of each text, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op5_bpe.encode_checked(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "source"]).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("pii", personal_data), ("mixing", mixing), ("bpe", tokens)]

#: Learning, sketching and tokenising have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
