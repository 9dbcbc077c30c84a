"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralift.llm import op1_quality, op2_suffix, op3_mixing, op5_bpe, op6_toxicity, op7_pii, op8_simhash, op9_html, op10_cws
from terralift.llm.common import is_held_out, table
from terralift.llm.op4_topk import exact_topk


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op1_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = op1_quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_cws.edited_likeness(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op7_pii.find_pii(docs, op7_pii.fit(docs), keep=["doc_id"])


def op9_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", op8_simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op6_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = op6_toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_segments")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = exact_topk(rows.where(F.col("vec_id") % 50 == 0), rows, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

def _op3_sql() -> str:
    """The same mix in DuckDB; its permutation serves ranges below 2**31, as small tables have."""
    rounds, last = [], "x0"
    for k in range(3):
        rounds.append(f"a{k} AS (SELECT *, (y * CASE WHEN n % 2147483629 <> 0 THEN 2147483629 ELSE 2147483587 END + (salt * 1000003 + {(k + 1) * 7919}) % n) % n AS z FROM {last})")
        rounds.append(f"x{k + 1} AS (SELECT * EXCLUDE (y, z), CASE WHEN z < top THEN xor(z, z >> half) ELSE z END AS y FROM a{k})")
        last = f"x{k + 1}"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), soon AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS stop, stop / weight AS soon FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY soon, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY soon, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM soon
), sources AS (
  SELECT source, rank, source_size, least(stop, weight * coalesce(max(CASE WHEN level <= soon THEN level END) OVER (), CAST('inf' AS DOUBLE))) AS target,
    greatest(1, CAST(ceil(source_size / {op3_mixing.BLOCK}) AS BIGINT)) AS blocks,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(least(target * blocks / source_size, CAST(blocks * 3 AS DOUBLE)) * {op3_mixing.FINE} + 0.5) AS BIGINT) END AS weight
  FROM levels
), everything AS (
  SELECT CAST(sum(weight) AS BIGINT) AS w, CAST((sum(weight) + {op3_mixing.FINE // 2}) // {op3_mixing.FINE} AS BIGINT) AS n FROM sources
), shards AS (
  SELECT shard, w, CASE WHEN shard < n // {op3_mixing.SHARD} THEN {op3_mixing.SHARD} ELSE n % {op3_mixing.SHARD} END AS size
  FROM (SELECT w, n, unnest(range((n + {op3_mixing.SHARD - 1}) // {op3_mixing.SHARD})) AS shard FROM everything)
), parts AS (
  SELECT s.rank, h.shard, h.w, h.size, (h.size * s.weight) // h.w AS whole, (h.size * s.weight) % h.w AS rem FROM shards h CROSS JOIN sources s WHERE s.weight > 0
), laid AS (
  SELECT *, CAST(coalesce(sum(rem) OVER (PARTITION BY shard ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low,
    CAST(coalesce(sum(whole) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
    CAST(size - sum(whole) OVER (PARTITION BY shard) AS BIGINT) AS over, CAST(sum(rem) OVER (PARTITION BY shard) AS BIGINT) AS total,
    CAST(sum(whole) OVER (PARTITION BY rank) AS BIGINT) AS sure FROM parts
), draws AS (
  SELECT shard, draw, ('0x' || substr(md5(shard || ':' || draw), 1, 15))::BIGINT % total AS u
  FROM (SELECT DISTINCT shard, total, unnest(range(over)) AS draw FROM laid WHERE over > 0)
), numbered AS (
  SELECT l.rank, l.sure + row_number() OVER (PARTITION BY l.rank ORDER BY d.shard, d.draw) - 1 AS j
  FROM draws d JOIN laid l ON l.shard = d.shard AND d.u >= l.low AND d.u < l.low + l.rem
), slots AS (
  SELECT rank, j FROM numbered UNION ALL SELECT rank, unnest(range(first, first + whole)) FROM laid
), buckets AS (
  SELECT greatest(1, CAST(ceil(count(*) / {op3_mixing.BUCKET_ROWS}) AS BIGINT)) AS n FROM sized
), placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY (coalesce(s.doc_id, 0) + s.size) % b.n, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN buckets b WHERE s.size > 0
), pieces AS (
  SELECT *, unnest(range(CAST(pos // {op3_mixing.BLOCK} AS BIGINT), CAST((pos + size - 1) // {op3_mixing.BLOCK} + 1 AS BIGINT))) AS block FROM placed
), x0 AS (
  SELECT rank, j % blocks AS y, blocks AS n, rank * 31 + j // blocks AS salt, CAST(floor(log2(blocks + 0.5)) AS INTEGER) AS power,
    CAST(1 AS BIGINT) << power AS top, greatest(1, power // 2) AS half
  FROM slots JOIN sources USING (rank) WHERE j < blocks * 3
), {", ".join(rounds)}, uses AS (
  SELECT rank, y AS block, count(*) AS uses FROM {last} GROUP BY 1, 2
)
SELECT p.doc_id, p.size, p.source_size, p.target,
  CAST(sum((least(p.pos + p.size, (p.block + 1) * {op3_mixing.BLOCK}) - greatest(p.pos, p.block * {op3_mixing.BLOCK})) * coalesce(u.uses, 0)) AS BIGINT) AS taken
FROM pieces p LEFT JOIN uses u USING (rank, block) GROUP BY p.rank, p.pos, p.doc_id, p.size, p.source_size, p.target
UNION ALL
SELECT s.doc_id, s.size, t.source_size, t.target, 0 FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size = 0
"""


QUERIES = {
    "op1_quality_bradley_terry": op1_quality_bradley_terry,
    "op2_suffix_repeats": op2_suffix_repeats,
    "op3_source_mixing": op3_source_mixing,
    "op4_exact_topk": op4_exact_topk,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity_segments": op6_toxicity_segments,
    "op7_pii_tagger": op7_pii_tagger,
    "op8_simhash_gray": op8_simhash_gray,
    "op9_html_line_blocks": op9_html_line_blocks,
    "op10_weighted_sampling": op10_weighted_sampling,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op3_source_mixing": _op3_sql(), "op4_exact_topk": OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
