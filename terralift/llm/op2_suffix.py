"""Repeated byte strings by a distributed suffix order.

Equal strings of ``LENGTH`` bytes are brought to one task, then found by suffix order (difference covers,
``suffixes.py``) and comparison of neighbours. To bring them together, each window of ``LENGTH`` bytes has an anchor:
its ``GRAM``-byte piece of least hash, the first such. Equal windows have equal anchors at equal places. Windows that
follow each other mostly share their anchor; such a run is one row with the hashes of the anchor and of all bytes that
its windows cover. Then

1. a run whose anchor occurs nowhere else holds no repeat;
2. a run whose bytes occur twice is repeated all through, and copies of it cost nothing more;
3. of all other runs one of each kind is sent, as bytes, to the task of its anchor, which sorts suffixes.

The runs of an anchor with more than ``SPREAD`` kinds are cut by the place of the anchor and the bytes that neighbouring
windows share, and each class of parts goes to a task of its own; a large group within a task is split the same way. An
anchor with more than ``MOST_RUNS`` different runs isn't gathered: its windows are counted by their own hashes all over
the cluster.

What differs from one sort of all suffixes: difference covers order the suffixes of what step 3 brings to a task. A sort
of all suffixes would move some sixteen bytes for two of three bytes of text in each of its rounds; runs equal by hash
(step 2) and anchors beyond ``MOST_RUNS`` are settled by grouping.
Nothing is sampled or capped, and the rows that move follow the size of the input.

Cases: null counts as empty; texts under ``LENGTH`` bytes lose nothing; repeated rows repeat each other's strings, so
lose all if long enough; rows are told apart by id and text, ids may be null or repeated; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralift.llm.common import materialize, mix64

LENGTH = 400
GRAM = 128
BATCH = 1 << 19
SPREAD = 256
MOST_RUNS = 100_000
SPLITS = (64, 8, 1)
PLACE_BITS = 28
NO_ID = -(1 << 63)
RUN = "d long, k long, p0 int, n int, off int, ah long, ch long"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each place on."""
    v = mix64(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < gram:
        left, right = v[:-step], v[step:]
        v = left * np.uint64(0xD1342543DE82EF95) + right
        v ^= v >> np.uint64(29)
        step *= 2
    return mix64(v)


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor in the first window, hash of the anchor) of each run."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    if n >= 1 << PLACE_BITS:
        raise ValueError("a text is longer than 256 MiB")
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # least of each window: the least of what is behind it in its block and before it in the next
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    anchor = (least & low).astype(np.int64)
    p0 = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    number = np.diff(np.append(p0, windows))
    return p0, number, anchor[p0] - p0, h[anchor[p0]]


def _rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of each text; columns in: d, k, text."""
    names = [c.split()[0] for c in RUN.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    out: list[list[np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for d, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            p0, number, off, ah = runs(np.frombuffer(raw, np.uint8), length)
            if not len(p0):
                continue
            ends = p0 + number - 1 + length
            ch = np.array([digest(raw[a:b], o) for a, b, o in zip(p0.tolist(), ends.tolist(), off.tolist(), strict=True)], np.uint64)
            out.append([np.full(len(p0), d), np.full(len(p0), k), p0, number, off, ah.view(np.int64), ch.view(np.int64)])
            held += len(p0)
            if held >= 100_000:
                held = 0
                yield flush()
    if out:
        yield flush()


def _mark(contexts: list[tuple[int, bytes, int]], length: int) -> list[tuple[int, np.ndarray]]:
    """(number, repeated windows) of runs (number, bytes, windows): one suffix order over all of them."""
    text = np.frombuffer(b"".join(c for _, c, _ in contexts), np.uint8)
    at = np.cumsum([0, *[len(c) for _, c, _ in contexts]])
    # runs may stand end to end: only windows inside their run are looked at
    starts = np.concatenate([np.arange(a, a + n) for a, (_, _, n) in zip(at, contexts, strict=False)])
    found = repeated_in(text, starts, length)
    cuts = np.cumsum([n for _, _, n in contexts])[:-1]
    return [(c[0], np.flatnonzero(f)) for c, f in zip(contexts, np.split(found, cuts), strict=True)]


def repeated_in(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    from terralift.llm.suffixes import repeated_starts

    return repeated_starts(text, starts, length)


def cut_run(data: bytes, n: int, off: int, size: int, length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(class, shared bytes, first window, last window) of the parts of a run whose anchor stands ``off`` bytes into it.

    Windows whose anchor stands in one stretch of ``size`` places share the bytes between the last start and the first
    end, and equal windows have their anchor at one place, so windows of different classes or shared bytes differ.
    """
    for b in range((off - n + 1) // size, off // size + 1):
        a, z = max(0, off - size * b - size + 1), min(n - 1, off - size * b)
        yield b, data[off - size * b : off - size * b - size + 1 + length], a, z


def compare(group: list[tuple[bytes, int, int]], length: int, splits: tuple[int, ...] = SPLITS, most: int = BATCH) -> list[np.ndarray]:
    """Repeated windows of each of the runs (bytes, windows, place of the anchor) of one anchor."""
    found: list[list[np.ndarray]] = [[] for _ in group]
    todo = [([(i, c, n, o, 0) for i, (c, n, o) in enumerate(group)], 0)]
    while todo:
        parts, level = todo.pop()
        if len(parts) < 2:
            continue
        if sum(len(c) for _, c, _, _, _ in parts) <= most:
            for (i, _, _, _, shift), (_, hits) in zip(parts, _mark([(k, c, n) for k, (_, c, n, _, _) in enumerate(parts)], length), strict=True):
                found[i].append(hits + shift)
            continue
        if level == len(splits):  # single windows, all equal
            for i, _, _, _, shift in parts:
                found[i].append(np.array([shift]))
            continue
        classes: dict[tuple[int, bytes], list] = {}
        for i, c, n, o, shift in parts:
            for b, shared, a, z in cut_run(c, n, o, splits[level], length):
                classes.setdefault((b, hashlib.blake2b(shared, digest_size=16).digest()), []).append((i, c[a : z + length], z - a + 1, o - a, shift + a))
        todo.extend((p, level + 1) for p in classes.values())
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def _ranges(hits: np.ndarray) -> list[tuple[int, int]]:
    """Runs of following numbers as (first, end)."""
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) != 1)
    return list(zip(hits[np.concatenate([[0], cut + 1])].tolist(), (hits[np.concatenate([cut, [len(hits) - 1]])] + 1).tolist(), strict=True))


def _compare_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of runs or parts of runs (part, ah, ch, shift, n, off, bytes), which come sorted by the first four."""
    out: list[tuple[int, int, int, int]] = []
    group: dict[tuple[int, int], tuple[bytes, int, int]] = {}
    now: tuple[int, int] | None = None
    # small groups share one suffix order, as windows of different anchors or parts can't be equal
    small: list[tuple[tuple[int, int, int], bytes, int]] = []

    def found(ah: int, ch: int, shift: int, hits: np.ndarray) -> None:
        out.extend((ah, ch, a + shift, b + shift) for a, b in _ranges(hits))

    def sort_small() -> None:
        if small:
            for (name, _, _), (_, hits) in zip(small, _mark([(i, c, n) for i, (_, c, n) in enumerate(small)], length), strict=True):
                found(*name, hits)
            small.clear()

    def close() -> None:
        if len(group) > 1:
            if sum(len(c) for c, _, _ in group.values()) <= BATCH // 2:
                small.extend(((now[1], *name), c, n) for name, (c, n, _) in group.items())
                if sum(len(c) for _, c, _ in small) > BATCH // 2:
                    sort_small()
            else:
                for name, hits in zip(group, compare(list(group.values()), length), strict=True):
                    found(now[1], *name, hits)
        group.clear()

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["ah", "ch", "s", "e"])

    for batch in batches:
        for part, ah, ch, shift, n, off, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (part, ah) != now:
                close()
                now = part, ah
            group[ch, shift] = (data, n, off)
        if len(out) > 50_000:
            yield flush()
    close()
    sort_small()
    if out:
        yield flush()


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs that each text was asked for, in parts if their anchor has over ``spread`` kinds; columns in:
    wanted, text."""
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            for w in wanted:
                data = raw[w["p0"] : w["p0"] + w["n"] - 1 + length]
                if w["kinds"] <= spread:
                    rows.append((0, w["ah"], w["ch"], 0, w["n"], w["off"], data))
                    held += len(data)
                    continue
                for b, shared, first, last in cut_run(data, w["n"], w["off"], SPLITS[0], length):
                    part = xxhash.xxh64_intdigest(shared, b % (1 << 64)) >> 1
                    rows.append((part, w["ah"], w["ch"], first, last - first + 1, w["off"] - first, data[first : last + length]))
                    held += last - first + length
                if held > 8 << 20:
                    yield _contexts(rows)
                    rows, held = [], 0
            if held > 8 << 20:
                yield _contexts(rows)
                rows, held = [], 0
        if rows:
            yield _contexts(rows)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "ah", "ch", "shift", "n", "off", "data"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of whole runs (part, ah, ch, shift, n, off, bytes) with its hash."""
    for batch in batches:
        for ah, ch, n, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 6)), strict=True):
            names = [hashlib.blake2b(data[i : i + length], digest_size=8).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([ah] * n), pa.array([ch] * n), pa.array(range(n), pa.int32()), pa.array(np.frombuffer(b"".join(names), np.int64))], ["ah", "ch", "s", "w"])


def repeated_runs(found: DataFrame, texts: DataFrame, length: int, most_runs: int, spread: int = SPREAD) -> DataFrame:
    """``ah, ch, s, e``: of each kind of run, the windows (first, end) that are repeated somewhere."""
    kinds = found.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("d", "k", "p0", "n", "off")).alias("one"))
    anchors = kinds.groupBy("ah").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    kinds = materialize(kinds.join(anchors.select("ah", "kinds"), "ah").select("ah", "ch", "times", "kinds", "one.*"))
    whole = kinds.where("times > 1").select("ah", "ch", F.lit(0).alias("s"), F.col("n").alias("e"))
    asked = kinds.where("kinds > 1").groupBy("d", "k").agg(F.collect_list(F.struct("ah", "ch", "p0", "n", "off", "kinds")).alias("wanted"))
    sent = texts.join(asked, ["d", "k"])
    shape = "part long, ah long, ch long, shift int, n int, off int, data binary"
    few = sent.select(F.filter("wanted", lambda w: w["kinds"] <= most_runs).alias("wanted"), "text").mapInArrow(lambda b: _cut_out(b, length, spread), shape)
    compared = few.repartition("ah", "part").sortWithinPartitions("part", "ah", "ch", "shift").mapInArrow(lambda b: _compare_groups(b, length), "ah long, ch long, s int, e int")
    parts = [whole, compared]
    if kinds.where(F.col("kinds") > most_runs).limit(1).count():
        many = sent.select(F.filter("wanted", lambda w: w["kinds"] > most_runs).alias("wanted"), "text").mapInArrow(lambda b: _cut_out(b, length, 1 << 62), shape)
        windows = many.dropDuplicates(["ah", "ch"]).mapInArrow(lambda b: _windows(b, length), "ah long, ch long, s int, w long")
        again = windows.groupBy("ah", "w").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        parts.append(windows.join(again, ["ah", "w"]).select("ah", "ch", "s", (F.col("s") + 1).alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what is left of texts; columns in: doc_id, spans, text."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for spans, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer()
            merged = merge_spans([(s["s"], s["e"]) for s in spans or ()])
            digest, at = hashlib.sha256(), 0
            view = memoryview(raw)
            for a, b in merged:
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            rows.append((len(view), sum(b - a for a, b in merged), len(merged), digest.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, end) spans as disjoint spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(raw).alias("k"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), raw.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS, spread: int = SPREAD) -> DataFrame:
    """``d, k, spans``: byte spans of each text (by id and hash) that repeated strings cover; they may overlap."""
    texts = _keyed(docs, doc_id, text).select("d", "k", "text")
    long = texts.where(F.octet_length("text") >= length)
    found = materialize(long.mapInArrow(lambda b: _rows(b, length), RUN))
    again = repeated_runs(found, long, length, most_runs, spread)
    spans = found.join(again, ["ah", "ch"]).select("d", "k", (F.col("p0") + F.col("s")).alias("s"), (F.col("p0") + F.col("e") + (length - 1)).alias("e"))
    return spans.groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS, spread: int = SPREAD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    spans = repeated_spans(docs, doc_id, text, length, most_runs, spread)
    joined = _keyed(docs, doc_id, text).join(spans, ["d", "k"], "left").select("doc_id", "spans", "text")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
