"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The one definition of a word that the contracts share: runs without ASCII white space.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; always through Spark's reader, as paths may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder of the session; without one only a local session will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"{tempfile.gettempdir()}/checkpoints"  # one process, so any folder is shared
    return f"{base.rstrip('/')}/terralift-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    Survives lost executors, unlike a local checkpoint, and a reader takes only the columns it needs. The table goes
    when the application ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no label may be learnt from; a null id counts as empty text, so held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def map_text(
    df: DataFrame,
    function: Callable[[list[str]], dict[str, object]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
    max_bytes: int = 4 << 20,
) -> DataFrame:
    """Add to the columns ``keep`` what ``function`` makes of whole texts, one value a row.

    ``function`` gets a list of texts (null: empty) of about ``max_bytes`` together, at least one text, and returns
    a list or array for each name of ``fields``. Rows never leave their partition.
    """
    keep = [] if keep is None else keep
    # a kept text travels once
    at = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else len(keep)
    columns = [F.col(f"`{c}`") for c in keep]
    source = df.select(*columns, *([F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")] if at == len(keep) else []))
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, max_bytes, at):
                made = function(texts)
                arrays = [*part.columns[: len(keep)], *[pa.array(made[n], from_pandas=False) for n in names]]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[: len(keep)], *names])

    return source.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, max_bytes: int, at: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch whose column ``at`` (or last) is text into runs of rows of about ``max_bytes`` of text, one row at
    least; null texts come as empty ones."""
    at = batch.num_columns - 1 if at is None else at
    column = batch.column(at)
    if not len(column):
        return
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    row = 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        part = batch.slice(row, to - row)
        yield part, [t or "" for t in part.column(at).to_pylist()]
        row = to


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by one space; the starts of the texts and, last, the end."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of a byte array that ends in a space."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside))
    starts = edge[0::2]
    ends = edge[1::2]
    return starts, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (fixed multipliers of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), 0x9E3779B97F4A7C15, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whatever its place; words are disjoint and in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    # place of each byte of a word in that word, without a loop over words
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    values *= _powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
