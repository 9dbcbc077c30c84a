"""Byte-level BPE with a segment tree over byte positions.

Each match of the pattern is encoded alone. The leaf of a byte position holds the rank of the pair that starts there,
with the position in its low bits, so the root is the leftmost pair of minimum rank. A merge changes the leaves of the
pair, of its right half and of its left neighbour: three updates of logarithmic cost.

Cases: null and empty texts give no ids and decode to nothing; a match that is itself in the vocabulary is one id;
special tokens' strings are ordinary text; repeated rows are encoded each; other columns are ignored unless kept; an
empty table gives no rows. Matches seen before are looked up in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terralift.llm.common import map_text

NONE = 1 << 62
MOST_KEPT = 300_000
LONGEST_KEPT = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        raise ValueError(f"the vocabulary lacks byte {piece!r}")
    get = ranks.get
    bits = n.bit_length()
    low = (1 << bits) - 1
    size = n - 1  # leaves; any number will do, as each leaf holds its own position
    tree = [NONE] * size
    for i in range(size):
        rank = get(piece[i : i + 2])
        tree.append(NONE if rank is None else rank << bits | i)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    following = list(range(1, n + 2))
    before = list(range(-1, n))
    while (best := tree[1]) < NONE:
        i = best & low
        j = following[i]
        after = following[j]
        following[i] = after
        leaves = [(j, NONE)]
        if after < n:
            before[after] = i
            rank = get(piece[i : following[after]])
            leaves.append((i, NONE if rank is None else rank << bits | i))
        else:
            leaves.append((i, NONE))
        h = before[i]
        if h >= 0:
            rank = get(piece[h:after])
            leaves.append((h, NONE if rank is None else rank << bits | h))
        for leaf, value in leaves:
            k = leaf + size
            if k >= 2 * size:
                continue  # the last byte starts no pair
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                if b < a:
                    a = b
                k >>= 1
                if tree[k] == a:
                    break
                tree[k] = a
    out, i = [], 0
    while i < n:
        after = following[i]
        out.append(ranks[piece[i:after]])
        i = after
    return out


class _Pieces(dict):
    """Packed ids of matches, made when first asked for.

    When full, all but the matches asked for since the last time are dropped: ``aged`` holds the former table, from
    which matches still in use come back.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.packed = [n.to_bytes(4, "little") for n in range(max(ranks.values()) + 1)]
        self.aged: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.aged.get(piece)
        if packed is None:
            packed = b"".join(map(self.packed.__getitem__, merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.aged = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.pieces = _Pieces(self.ranks)
        self.find = regex.compile(pattern).findall
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker, kept between tasks."""
    return Codec(path, pattern)


def encode_digests(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``n_tokens, ids_sha256, decoded_sha256``."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(texts: list[str]) -> dict[str, object]:
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts]
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
        }

    return map_text(docs, run, fields, keep=keep)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``ids array<int>``, one list for each whole text."""

    def run(texts: list[str]) -> dict[str, object]:
        c = codec(path, pattern)
        return {"ids": [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts]}

    return map_text(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep=keep)


def encode_checked(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``ids array<int>`` and ``decodes``, whether the ids decode to the text's bytes."""

    def run(texts: list[str]) -> dict[str, object]:
        c = codec(path, pattern)
        ids = [c.encode(t) for t in texts]
        return {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decodes": [c.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]}

    return map_text(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())], keep=keep)


def decode(rows: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``bytes binary``, decoded from ``ids``; null ids decode to nothing."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    source = rows.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            made = [c.decode(np.array(x, "<u4").tobytes()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)
