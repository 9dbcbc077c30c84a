import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from terralift.llm import op6_toxicity, op7_pii, op8_simhash
from terralift.llm.common import materialize
from tests.llm.test_op1_op6 import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(spark, 400)
    docs = docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" call +1 (555) 555-1234 now"))).otherwise(F.col("text")))
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder))
        done[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns
    before, after = done["toxicity"]
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id is not null and toxic is not null").distinct()
    left = {r["doc_id"] for r in after.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()} - {10**9}
    assert len(toxic & left) < 0.04 * len(toxic) and len(clean - left) < 0.04 * len(clean)
    before, after = done["simhash"]
    groups = op8_simhash.simhash_groups(before, similarity=0.8).select("component_id").distinct().count()
    assert after.count() == groups and not [r for r in after.select("doc_id").collect() if r["doc_id"] >= 1000]
    before, after = done["pii"]
    assert before.count() == after.count()
    assert before.where(F.col("text").contains("555-1234")).count() > 0
    for r in after.collect():
        assert not op7_pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    before, after = done["mixing"]
    words = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
    assert all(len(r["text"].split()) <= 3 * words[r["doc_id"]] for r in after.collect())
    before, after = done["bpe"]
    rows = after.collect()
    assert len(rows) == before.count() and all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_stage_names():
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    assert op6_toxicity.PER_CLASS > 0
