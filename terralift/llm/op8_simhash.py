"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: 64 majority bits of the XXH64 values of word shingles. Equal fingerprints are one node. Nodes are sorted
by Gray rank; consecutive ones share long bit patterns, which upper index nodes hold as (mask, value). Index nodes are
compared from the top; differences on the bits that both have fixed add up on the way down, and whole groups are left as
soon as they pass the limit. Every comparison goes down such a tree; only leaves of ``FAN`` codes are compared code by
code.

Up to ``GROUP`` nodes are one tree. More are dealt to trees of about that size by ``max_bits + 1`` disjoint blocks of
bits, of which two nodes within the limit share one at least. Each tree returns a spanning forest of its links, never
all pairs, and connected components of these links give the groups. A class beyond ``tile`` nodes is cut into tiles
whose trees meet in pairs, one task each, so one hot class is neither gathered nor capped.

Cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a shingle make one shingle;
repeated rows share a component; a component whose ids are all null has a null id; an empty table gives no rows;
other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralift.llm.common import map_text, materialize, mix64
from terralift.llm.components import connected_components, contracted

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FAN = 8
GROUP = 2048


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64-bit majority fingerprint of the word shingles of a whole text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends.tolist()]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    last = first[min(shingle, len(words)) :]
    values = np.array([digest(line[a : b - 1], seed) for a, b in zip(first[:n], last, strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        part = values[at : at + 16384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4, wide: bool = False) -> DataFrame:
    """The columns ``keep`` and ``fp long``; with ``wide`` also ``w0 .. w3 long``, of five-word shingles."""
    words = [f"w{k}" for k in range(WIDE)] if wide else []

    def run(texts: list[str]) -> dict[str, object]:
        made = np.array([wide_fingerprint(t) for t in texts]).reshape(-1, WIDE) if wide else None
        return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.int64), **{w: made[:, k] for k, w in enumerate(words)}}

    return map_text(docs, run, [T.StructField(c, T.LongType()) for c in ("fp", *words)], keep=keep)


WIDE = 4


def shingle_set(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 values of the different shingles of a whole text, in order; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    first = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    last = first[min(shingle, len(words)) :]
    return np.unique(np.array([digest(line[a : b - 1], seed) for a, b in zip(first[:n], last, strict=False)], np.uint64))


def wide_fingerprint(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """256 majority bits over the different shingles of a text: the share of differing bits of two texts is the angle
    between their shingle sets over pi, up to chance."""
    values = shingle_set(text, shingle, seed)
    if not len(values):
        return np.zeros(WIDE, np.int64)
    out = np.empty(WIDE, np.int64)
    for k in range(WIDE):
        ones = np.zeros(64, np.int64)
        mixed = mix64(values + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        for at in range(0, len(mixed), 16384):
            ones += np.unpackbits(mixed[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0]
    return out


def differing_bits(similarity: float, deviations: float = 3) -> int:
    """Bits of a wide fingerprint that sets of this Jaccard similarity differ in, on average and so many deviations
    more: with three, 998 of 1,000 pairs at just this similarity are within it."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * WIDE * share + deviations * math.sqrt(64 * WIDE * share * (1 - share)))


def gray_rank(x: Column) -> Column:
    """Place of a code in the Gray order of 64-bit codes (the inverse Gray code)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def block_masks(nodes: int, max_bits: int, group: int = GROUP) -> list[int]:
    """Masks of the classes that nodes are dealt by; about ``group`` random nodes share one, and two nodes that differ in
    at most ``max_bits`` bits share one of their classes.

    No bits if there are no more nodes than that; else blocks of as many bits as it takes; where the bits don't suffice
    (classes of eight times the size would not do), every choice of some of ``m`` blocks.
    """
    bits, most = math.ceil(math.log2(max(1, nodes / group))), 64 // (max_bits + 1)
    if not bits:
        return [0]
    if nodes / 2**most <= 8 * group:
        bits = min(bits, most)
        return [((1 << bits) - 1) << (bits * i) for i in range(max_bits + 1)]
    m = max_bits + 2
    while nodes / 2 ** (64 * (m - max_bits) / m) > group and m < 2 * max_bits + 4:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Forest:
    """Union of places by links given as arrays; links within a set are dropped in bulk."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # halve paths until flat
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask of shared bits, their values) of index nodes, leaves of ``FAN`` sorted codes first."""
    out = []
    ones, zeros = codes, ~codes
    while True:
        cut = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
        out.append((ones | zeros, ones))
        if len(ones) == 1:
            return out


def _children(a: np.ndarray, b: np.ndarray, na: int, nb: int, same: bool, *along: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs of children of the pairs (a, b); for one tree joined with itself each pair once."""
    step = np.arange(FAN)
    ca = np.repeat(a[:, None] * FAN + step, FAN, axis=1).ravel()
    cb = np.tile(b[:, None] * FAN + step, (1, FAN)).ravel()
    ok = (ca < na) & (cb < nb)
    if same:
        ok &= ca <= cb
    return (ca[ok], cb[ok], *(np.repeat(x, FAN * FAN)[ok] for x in along))


def _leaves(codes: np.ndarray) -> np.ndarray:
    """Codes in rows of ``FAN``; the last row is filled up with its last code."""
    return np.concatenate([codes, np.full(-len(codes) % FAN, codes[-1])]).reshape(-1, FAN)


def link_codes(x: np.ndarray, y: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of ``x`` with itself, or between ``x`` and ``y``; codes are uint64 in Gray order."""
    same = y is None
    other = x if same else y
    if not len(x) or not len(other):
        return x[:0], x[:0]
    everything = x if same else np.concatenate([x, y])
    forest, shift = _Forest(len(everything)), 0 if same else len(x)
    tx = _levels(x)
    ty = tx if same else _levels(other)
    lx, ly = _leaves(x), _leaves(other)
    deep = max(len(tx), len(ty))
    for t in (tx, ty):
        while len(t) < deep:
            t.append(t[-1])
    # a shorter tree keeps its one root on upper levels, so child numbers stay in step
    todo = [(deep - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
    while todo:
        level, a, b, common, far = todo.pop()
        (ma, va), (mb, vb) = tx[level], ty[level]
        both = ma[a] & mb[b]
        far = far + np.bitwise_count((va[a] ^ vb[b]) & both & ~common)
        near = far <= max_bits
        a, b, common, far = a[near], b[near], both[near], far[near]
        for at in range(0, len(a), 4096):
            part = slice(at, at + 4096)
            if level:
                ca, cb, cc, cf = _children(a[part], b[part], len(tx[level - 1][0]), len(ty[level - 1][0]), same, common[part], far[part])
                todo.append((level - 1, ca, cb, cc, cf))
            else:
                pair, i, j = np.nonzero(np.bitwise_count(lx[a[part]][:, :, None] ^ ly[b[part]][:, None, :]) <= max_bits)
                ca, cb = a[part][pair] * FAN + i, b[part][pair] * FAN + j
                hit = (ca < len(x)) & (cb < len(other))
                forest.join(ca[hit], cb[hit] + shift)
    moved = np.flatnonzero(forest.root != np.arange(len(everything)))
    return everything[moved], everything[forest.root[moved]]


def _class_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each class; rows (part, key, i, j, t, fp) come sorted by class and Gray rank."""
    names = ["part", "key", "i", "j"]
    held: list[np.ndarray] = []
    held_key: tuple | None = None
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        rows = np.concatenate(held, axis=1)
        codes, tile = rows[1].view(np.uint64), rows[0]
        i, j = held_key[2], held_key[3]
        made = link_codes(codes, None, max_bits) if i == j else link_codes(codes[tile == i], codes[tile == j], max_bits)
        if len(made[0]):
            out.append(made)

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
        keys = np.stack(columns[:4])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        values = np.stack(columns[4:])
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, s].tolist())
            if key != held_key:
                if sum(h.shape[1] for h in held) > 1:
                    close()
                held, held_key = [], key
            held.append(values[:, s:e])
        if sum(len(o[0]) for o in out) > 50_000:
            yield flush()
    if sum(h.shape[1] for h in held) > 1:
        close()
    if out:
        yield flush()


def hamming_links(nodes: DataFrame, max_bits: int = 4, tile: int = 4096) -> DataFrame:
    """``a, b``: links between distinct codes (``fp long``) that keep all codes within ``max_bits`` bits connected."""
    masks = block_masks(nodes.count(), max_bits)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("part", "key"))
    large = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    tiled = keyed.join(large, ["part", "key"], "left").select("part", "key", "fp", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int").alias("g"))
    tiled = tiled.withColumn("t", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("g")).cast("int"))
    tiled = tiled.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = tiled.select("part", "key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "fp")
    dealt = dealt.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", gray_rank(F.col("fp")))
    return dealt.mapInArrow(lambda b: _class_links(b, max_bits), "a long, b long")


def sampled_masks(nodes: int, group: int = 512, recall: float = 0.98, similarity: float = 0.8, seed: int = 19) -> list[list[int]]:
    """Bit samples (a mask for each word) of tables that a pair of the given similarity shares one of, with the given
    chance even if it differs in two deviations more bits than such pairs do; samples are as long as it takes for about
    ``group`` random nodes to share a class, and up to that many nodes are one class."""
    bits = math.ceil(math.log2(max(1, nodes / group)))
    same = (1 - differing_bits(similarity, 2) / (64 * WIDE)) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if bits else 1
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        chosen = draw.choice(64 * WIDE, bits, replace=False).tolist()
        out.append([sum(1 << (c % 64) for c in chosen if c // 64 == k) for k in range(WIDE)])
    return out


WORDS = [f"w{k}" for k in range(WIDE)]


def _near_in_tables(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links (names of both, the smaller one as ``b``) between rows (key, name, words...) of one key, which come together."""
    held: np.ndarray | None = None

    def links(rows: np.ndarray) -> pa.RecordBatch | None:
        key, codes = rows[0], rows[2:].view(np.uint64)
        names, place = np.unique(rows[1], return_inverse=True)
        forest = _Forest(len(names))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            step = max(1, (1 << 18) // (z - a))
            for at in range(a, z - 1, step):
                to = min(z, at + step)
                far = sum(np.bitwise_count(w[at:to, None] ^ w[None, at:z]).astype(np.int16) for w in codes)
                i, j = np.nonzero(far <= max_bits)
                up = i < j
                forest.join(place[at + i[up]], place[at + j[up]])
        moved = np.flatnonzero(forest.root != np.arange(len(names)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[forest.root[moved]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        before = np.flatnonzero(rows[0] != rows[0, -1])
        cut = int(before[-1]) + 1 if len(before) else 0
        held = rows[:, cut:]
        if cut and (made := links(rows[:, :cut])) is not None:
            yield made
    if held is not None and held.shape[1] and (made := links(held)) is not None:
        yield made


def similar_links(nodes: DataFrame, similarity: float = 0.8, tile: int = 4096, most_known: int = 10_000) -> DataFrame:
    """``a, b``: links that keep all wide fingerprints (``w0 .. w3 long``, all different; named by their hash) connected
    that meet in tables of sampled bits and differ in no more bits than sets of this similarity do. They only propose
    pairs: ``verified_links`` decides.

    The rows of all tables are shuffled once. Classes beyond ``tile`` rows are found by a count of keys alone and cut
    into tiles that meet in pairs; their keys are broadcast if there are at most ``most_known``, else joined by merging.
    """
    tables = sampled_masks(nodes.count(), similarity=similarity)
    keys = [F.xxhash64(F.lit(n), *[F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(WORDS, t, strict=True)]) for n, t in enumerate(tables)]
    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), F.xxhash64(*WORDS).alias("name"), *WORDS)
    large = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile))
    known = large.count()
    if known:
        tiled = keyed.join(F.broadcast(large) if known <= most_known else large.hint("merge"), "key", "left").withColumn("g", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
        tiled = tiled.withColumn("t", F.pmod(F.xxhash64(*WORDS), F.col("g")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        keyed = tiled.select(F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u"))).alias("key"), "name", *WORDS)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _near_in_tables(b, differing_bits(similarity)), "a long, b long")


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of texts whose sets are similar, each to the smallest node that it is tied to in its tiles; rows (root, i, j,
    t, node, words..., set) come sorted by root, i and j."""
    most, held, held_key = differing_bits(similarity), [], None

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.take(pa.array(np.argsort(rows.column(4).to_numpy(), kind="stable")))  # so a least place is a least node
        columns = [rows.column(k).to_numpy().astype(np.int64) for k in range(WIDE + 5)]
        i, j, t, node = columns[1][0], columns[2][0], columns[3], columns[4]
        codes = np.stack(columns[5:]).view(np.uint64)
        sets = [np.frombuffer(b, np.uint64) for b in rows.column(WIDE + 5).to_pylist()]
        sizes = np.array([len(x) for x in sets])
        kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        mine, forest = np.zeros(len(kinds), bool), _Forest(len(node))
        for x in np.flatnonzero(t == i):
            y = np.arange(x + 1, len(node)) if i == j else np.flatnonzero(t == j)
            y = y[(forest.root[y] != forest.root[x]) & (np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]) - 1e-6)]
            y = y[np.bitwise_count(codes[:, y] ^ codes[:, [x]]).sum(0, dtype=np.int64) <= most]
            y = y[sizes[y] > 0]
            if not len(y):
                continue
            mine[own[x]] = True
            both = np.array([np.count_nonzero(mine[own[k]]) for k in y])
            mine[own[x]] = False
            hit = y[both / (sizes[x] + sizes[y] - both) >= similarity]
            forest.join(np.full(len(hit), x), hit)
        moved = np.flatnonzero(forest.root != np.arange(len(node)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[forest.root[moved]])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, s].tolist())
            if key != held_key:
                if held and (made := links(pa.Table.from_batches(held))) is not None:
                    yield made
                held, held_key = [], key
            held.append(batch.slice(s, e - s))
    if held and (made := links(pa.Table.from_batches(held))) is not None:
        yield made


def verified_links(docs: DataFrame, same: DataFrame, near: DataFrame, similarity: float, tile: int = 2048, tile_bytes: int = 32 << 20) -> DataFrame:
    """``a, b``: links between nodes of ``same`` (``node, h, w0 .. w3``; ``h`` is the hash of one text of each) whose sets
    of different five-word shingles have at least this Jaccard similarity.

    The proposed links ``near`` deal the nodes into groups, and the pairs within a group that differ in few enough bits
    are compared by their sets, unless links found before connect them. A group beyond ``tile`` nodes or ``tile_bytes``
    of sets is cut into tiles that meet in pairs, one task each.
    """
    groups = connected_components(contracted(near)).withColumnRenamed("node", "id")
    members = materialize(same.withColumn("id", F.xxhash64(*WORDS)).join(groups, "id"))
    asked = materialize(members.select("h").distinct())
    texts = docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), "text").join(asked, "h")
    sets = map_text(texts, lambda t: {"set": [shingle_set(x).tobytes() for x in t]}, [T.StructField("set", T.BinaryType())], keep=["h"])
    held = materialize(members.join(sets.groupBy("h").agg(F.first("set").alias("set")), "h"))
    cuts = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(F.length("set")) / tile_bytes))
    tiled = held.join(held.groupBy("root").agg(cuts.cast("int").alias("g")), "root").withColumn("t", F.pmod(F.xxhash64("id", F.lit(5)), F.col("g")).cast("int"))
    tiled = tiled.withColumn("u", F.explode(F.sequence(F.lit(0), F.greatest(F.col("g") - 1, F.lit(0)))))
    dealt = tiled.select("root", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "node", *WORDS, "set")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(lambda b: _verified(b, similarity), "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", keep: list[str] | None = None, shingle: int = 4, max_bits: int = 4, similarity: float | None = None) -> DataFrame:
    """``doc_id, *keep, fp, root, component_id``: the smallest id reachable over links of at most ``max_bits`` bits.

    With ``similarity``, texts whose sets of five-word shingles have at least this Jaccard similarity are linked as well.
    Wide fingerprints only propose these pairs (64 bits can't tell them from others), the sets decide.

    ``root`` is the smallest fingerprint of the component, as a signed integer.
    """
    hashed = [] if similarity is None else ["__h"]
    source = docs.withColumns({h: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) for h in hashed}) if hashed else docs
    marked = materialize(with_fingerprints(source, [doc_id, *(keep or []), *hashed], shingle, similarity is not None))
    nodes = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    links = hamming_links(nodes.select("fp"), max_bits)
    if similarity is not None:
        same = materialize(marked.groupBy(*WORDS).agg(F.min("fp").alias("node"), F.min("__h").alias("h")))
        equal = marked.select(F.col("fp").alias("a"), *WORDS).distinct().join(same, WORDS).select("a", F.col("node").alias("b")).where("a <> b")
        near = materialize(similar_links(same.select(*WORDS), similarity))
        links = links.union(equal).union(contracted(verified_links(docs, same, near, similarity)))
    found = connected_components(links)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialize(rooted.join(named, "root").select("fp", "root", "component_id"))
    return marked.drop(*hashed).join(member, "fp")


def one_of_each_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one of least id (rows without id last; ties
    by a hash of the text), and one only of repeated rows."""
    tied = docs.withColumn("__tie", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    groups = simhash_groups(tied, keep=["__tie"], shingle=shingle, max_bits=max_bits, similarity=similarity)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__tie")).alias("one"))
    stay = first.select(F.col("one.doc_id").alias("__id"), F.col("one.__tie").alias("__t"), F.col("one.none").alias("__none"))
    rows = tied.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    stay = stay.withColumn("__k", F.coalesce("__id", F.lit(0)))
    joined = rows.join(stay, (rows["__key"] == stay["__k"]) & (rows["__tie"] == stay["__t"]) & (rows["doc_id"].isNull() == stay["__none"]))
    again = F.row_number().over(Window.partitionBy("__key", "__tie", "__none").orderBy(F.lit(0)))
    return joined.withColumn("__again", again).where("__again = 1").select(*[docs[c] for c in docs.columns])


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
