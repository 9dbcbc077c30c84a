"""Document fingerprints by consistent weighted sampling.

Terms are the words and the pairs of neighbouring words of a whole text, weighted by how often they occur. For each
sample a term of weight ``w`` has ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``; with ``t = floor(ln w / r + b)`` the
sample is the term of least ``ln c - r * (t + 1 - b)``, so two texts agree in a sample with a chance that equals the
generalised Jaccard similarity of their weights. The draws of a term come from three tables of ``TABLE`` rows, chosen
by separate bits of the term's hash: fixed memory whatever the vocabulary, and rarely two terms with the same three.

Cases: null counts as empty; texts without a word share one fingerprint, likeness 1 to each other and 0 to all else;
repeated rows have equal fingerprints; the next document follows by ascending ``doc_id`` (nulls last; ties by a hash
of the text), after the last comes the first, so a single row follows itself; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.llm.common import joined_bytes, map_text, mix64, text_slices, word_bounds, word_hashes

SAMPLES = 128
TABLE = 4096
AT_ONCE = 8192
HASH_BITS = 44


@lru_cache(maxsize=2)
def draws(samples: int, seed: int = 97) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of ln c, r and b."""
    draw = np.random.Generator(np.random.PCG64(seed))
    shape = (TABLE, samples)
    return (np.log(draw.gamma(2.0, 1.0, shape)).astype(np.float32), draw.gamma(2.0, 1.0, shape).astype(np.float32), draw.random(shape).astype(np.float32))


def weighted_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, weight) of the distinct terms, in order of text and hash."""
    data, starts = joined_bytes([t.encode("utf-8", "surrogatepass") for t in texts])
    a, b = word_bounds(data)
    of = np.searchsorted(starts, a, "right") - 1
    words = word_hashes(data, a, b)
    near = of[1:] == of[:-1]
    pairs = mix64(words[:-1] * np.uint64(0xD1342543DE82EF95) + words[1:])[near]
    shift = np.uint64(HASH_BITS)
    keys = np.concatenate([of.astype(np.uint64) << shift | words >> np.uint64(64 - HASH_BITS), of[1:][near].astype(np.uint64) << shift | pairs >> np.uint64(64 - HASH_BITS)])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    kinds = keys[first]
    return (kinds >> shift).astype(np.int64), kinds & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(first, len(keys)))


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 16-bit codes for each whole text; all zero for a text without words."""
    ln_c, r, b = draws(samples)
    of, terms, weight = weighted_terms(texts)
    best = np.full((len(texts), samples), np.inf, np.float32)
    low = np.uint64(TABLE - 1)
    ic, ir, ib = ((terms >> np.uint64(s) & low).astype(np.int64) for s in (0, 12, 24))
    one = weight == 1
    log_w = np.log(weight).astype(np.float32)
    for at in range(0, len(terms), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        rr, value = r[ir[part]], b[ib[part]]
        step = np.subtract(np.float32(1), value)
        if len(more := np.flatnonzero(~one[part])):
            t = np.floor(log_w[part][more, None] / rr[more] + value[more])
            step[more] = (t + np.float32(1)) - value[more]
        np.multiply(step, rr, out=step)
        np.subtract(ln_c[ic[part]], step, out=step)
        cuts = [0, *(np.flatnonzero(np.diff(of[part])) + 1).tolist(), len(step)]
        for a, z in zip(cuts, cuts[1:], strict=False):  # a plain minimum runs over whole vectors, unlike reduceat
            own = best[of[at + a]]
            np.minimum(own, step[a:z].min(0), out=own)
    bits = best.view(np.uint32).astype(np.uint64) << np.uint64(8) | np.arange(samples, dtype=np.uint64) % np.uint64(256)
    codes = (mix64(bits) >> np.uint64(48)).astype(np.uint16)
    codes[np.isinf(best[:, 0])] = 0
    return codes


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row; a text without words is like its kind alone."""
    none_a, none_b = ~a.any(1), ~b.any(1)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), (a == b).mean(1))


def packed(codes: np.ndarray) -> list[str]:
    """Codes as lowercase hex, four digits a sample."""
    return [row.tobytes().hex() for row in codes.astype(">u2")]


def fingerprints(docs: DataFrame, keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """The columns ``keep`` and ``fingerprint``."""
    return map_text(docs, lambda texts: {"fingerprint": packed(signatures(texts, samples))}, [T.StructField("fingerprint", T.StringType())], keep=keep)


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as many of the first code points of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _range_number(x: Column, bounds: list[int], strictly: bool = False) -> Column:
    """How many of the sorted ``bounds`` are at most (``strictly``: below) ``x``, by a search in two levels."""
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    array = lambda v: F.array(*[F.lit(e).cast("long") for e in v])
    reached = (lambda e: e < x) if strictly else (lambda e: e <= x)
    row = F.size(F.filter(array([v[0] for v in rows]), reached))  # rows whose first bound is reached
    within = F.size(F.filter(F.element_at(F.array(*[array(v) for v in rows]), F.greatest(row, F.lit(1))), reached))
    return F.when(row == 0, 0).otherwise((row - 1) * wide + within)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``part, doc_id, ahead, text`` dealt by ranges of ids and sorted; the row after each is its next document.

    Rows are in order of id (none last), then of a hash of the text. An id that fills several ranges, or rows without
    one, are dealt over as many ranges by that hash. Where a range ends, the first row of the next range that has any
    (after the last, of the first) stands as a row with ``ahead`` true. Only range bounds and first rows are gathered,
    one of each for each range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    known = rows.agg(F.percentile_approx("doc_id", shares, 10000).alias("bounds"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    bounds = sorted(known["bounds"] or []) if parts > 1 else []
    last = max(1, -(-parts * (known["n"] - known["ids"]) // max(1, known["n"])))  # ranges of rows without an id
    tie = F.xxhash64("text")
    share = (tie.cast("double") + 2.0**63) / 2.0**64  # rises with the hash, from 0 to 1
    spread = lambda n: F.least(n - 1, F.floor(share * n).cast("int"))
    below, reached = _range_number(F.col("doc_id"), bounds, True), _range_number(F.col("doc_id"), bounds)
    part = F.when(F.col("doc_id").isNull(), parts + spread(F.lit(last))).otherwise(below + spread(reached - below + 1))
    rows = rows.select(part.cast("int").alias("part"), "doc_id", F.col("doc_id").isNull().alias("last"), tie.alias("tie"), "text")
    heads = rows.groupBy("part").agg(F.min_by("text", F.struct("last", "doc_id", "tie")).alias("text"))
    heads = heads.select("part", "text")
    filled = rows.select("part").distinct()  # at most one row a range
    before = filled.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("to"))
    ahead = heads.join(before, "part").select(F.col("to").alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("last"), F.lit(0).cast("long").alias("tie"), "text", F.lit(True).alias("ahead"))
    # each range is one task's
    dealt = rows.withColumn("ahead", F.lit(False)).unionByName(ahead).repartitionById(parts + last, F.col("part"))
    return dealt.sortWithinPartitions("part", "ahead", "last", "doc_id", "tie").select("part", "doc_id", "ahead", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held: tuple[int, int | None, bool, str] | None = None
    for batch in batches:
        for part, texts in text_slices(batch, 2 << 20):
            rows = list(zip(*(part.column(k).to_pylist() for k in range(3)), texts, strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) < 2:
                continue
            at = [i for i, row in enumerate(rows[:-1]) if not row[2] and rows[i + 1][0] == row[0]]
            whole = [row[3] for row in rows]
            changed = [edited(whole[i], whole[i + 1]) for i in at]
            codes = signatures(whole, samples)
            new = signatures(changed, samples)
            own, following = codes[at], codes[[i + 1 for i in at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in at], pa.int64()),
                    pa.array([len(whole[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array(packed(own), pa.string()),
                    pa.array(packed(new), pa.string()),
                    pa.array(likeness(own, new), pa.float64()),
                    pa.array(likeness(own, following), pa.float64()),
                ],
                names,
            )


def edited_likeness(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to the edited and to the next text."""
    return with_next(docs, parts=parts).mapInArrow(lambda b: _compare(b, samples), SCHEMA)
