"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists.

Vectors are quantised, ``floor(256 * x)`` by component, and compared by integer inner product. Queries and candidates
are packed where they are read into tiles of bounded size, in the narrowest integers that hold them. A cell is a block
of queries and a group of candidates; its task holds the block and streams the group's tiles past it, so neither side
is broadcast, and a tile is shipped once a block or group, not once for every tile of the other side. Lists of ``k``
are merged in rounds of ``fan_in``.

Cases: null vectors and vectors that hold null, NaN or infinite components take no part, as queries or candidates;
vectors of another length than the query's are no candidates for it; rows that share the query's ``vec_id`` count as
its own row; repeated rows are candidates each; a query with fewer than ``k`` candidates returns all; an empty table
returns no rows. Columns besides the two named are ignored. Quantised components and scores beyond 64 bits stop at the
limits of a long; only the rows that hold such components are multiplied the slow way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = "dim int, n int, ids binary, rows binary"
#: Components of a tile at most, where it has more than one vector.
TILE_COMPONENTS = 1 << 20
#: Groups of candidates: of four tiles at least (else eight groups), 64 if rows suffice, more where a cell would have more
#: products of components than this.
CELL_PRODUCTS = 5e12
#: Below every score: scores stop one short of it.
LEAST = -(2**63)


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``id long, v array<long>``: the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


def _narrow(rows: np.ndarray) -> np.ndarray:
    low, high = rows.min(initial=0), rows.max(initial=0)
    return rows.astype(next(t for t in (np.int16, np.int32, np.int64) if low >= np.iinfo(t).min and high <= np.iinfo(t).max))


def _pack(batches: Iterator[pa.RecordBatch], size: int, scale: int = 256) -> Iterator[pa.RecordBatch]:
    """Tiles of at most ``size`` vectors of one length, ids ascending; doubles are quantised as ``quantised`` does it."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def tile(dim: int) -> pa.RecordBatch:
        nonlocal waiting
        parts = held.pop(dim)
        ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        waiting -= rows.size
        order = np.argsort(ids, kind="stable")
        values = [[dim], [len(ids)], [ids[order].tobytes()], [_narrow(rows[order]).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dim", "n", "ids", "rows"])

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        dims = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        flat, base = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
        part = np.ones(len(ids), bool)
        if flat.dtype != np.int64:
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # nulls come as NaN
            part = bad[base[1:]] == bad[base[:-1]]
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(flat * scale)
                flat = np.where(y >= 2.0**63, 2**63 - 1, np.where(y < -(2.0**63), LEAST, y.astype(np.int64)))
        for dim in np.unique(dims[part]).tolist():
            at = np.flatnonzero(part & (dims == dim))
            most = max(1, min(size, TILE_COMPONENTS // max(1, dim)))
            while len(at):
                now, at = np.split(at, [most - sum(len(p[0]) for p in held.get(dim, []))])
                held.setdefault(dim, []).append((ids[now], flat[base[now][:, None] + np.arange(dim)]))
                waiting += len(now) * dim
                if sum(len(p[0]) for p in held[dim]) >= most:
                    yield tile(dim)
        if waiting > 4 * TILE_COMPONENTS or len(held) > 64:
            for dim in list(held):
                yield tile(dim)
    for dim in list(held):
        yield tile(dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows in 64 bits, exact up to the limits of a long."""
    dim = max(1, a.shape[1])
    a, b = a.astype(np.int64), b.astype(np.int64)
    peaks = [np.abs(x.astype(np.float64)).max(1, initial=0) for x in (a, b)]
    if peaks[0].max() * peaks[1].max() * dim < 2.0**62:
        return a @ b.T
    out = a @ b.T  # wraps where a row is large; those rows are done again
    large = [p >= (2.0**62 / dim) ** 0.5 for p in peaks]
    top = 2**63 - 1
    whole = lambda x, y: np.clip(x.astype(object) @ y.astype(object).T, -top, top).astype(np.int64)
    if large[0].any():
        out[large[0]] = whole(a[large[0]], b)
    if large[1].any():
        out[:, large[1]] = whole(a, b[large[1]])
    return out


class _Lists:
    """The ``k`` best candidates so far of each query of a block."""

    def __init__(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, step: int) -> None:
        self.own, self.rows, self.k, self.step = np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]), k, step
        self.score = np.full((len(self.own), k), LEAST, np.int64)
        self.found = np.full((len(self.own), k), LEAST, np.int64)
        self.peaks = [_peak(self.rows[at : at + step]) for at in range(0, len(self.own), step)]

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare every query with a tile whose ids ascend."""
        peak, turned = _peak(rows), {}
        for n, at in enumerate(range(0, len(self.own), self.step)):
            a, own = self.rows[at : at + self.step], self.own[at : at + self.step]
            bound = self.peaks[n] * peak * max(1, rows.shape[1])
            if bound < 2.0**53:  # no sum on the way is beyond what the type holds exactly
                kind = np.float32 if bound < 2.0**24 else np.float64
                if kind not in turned:
                    turned[kind] = rows.astype(kind).T
                scores, none = a.astype(kind) @ turned[kind], -np.inf
            else:
                scores, none = _product(a, rows), LEAST
            left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            for q in np.flatnonzero(right > left):
                scores[q, left[q] : right[q]] = none
            self._take(at, scores, ids)

    def _take(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put what beats a query's last place, or ties with it by a smaller id, into its list."""
        k, n = self.k, len(ids)
        last, holder = self.score[at : at + len(scores), -1].astype(scores.dtype), self.found[at : at + len(scores), -1]
        best = scores.max(1)
        hit = np.flatnonzero((best > last) | ((best == last) & (ids[0] < holder)))
        if not len(hit):
            return
        rows, floor = scores[hit], last[hit][:, None]
        better = rows > floor
        if (best == last)[hit].any():
            better |= (rows == floor) & (np.arange(n) < np.searchsorted(ids, holder[hit], "left")[:, None])
        if n > k and np.count_nonzero(better) > 32 * len(hit):
            kth = np.partition(rows, n - k, axis=1)[:, n - k][:, None]
            level = rows == kth
            better &= (rows > kth) | (level & (np.cumsum(level, 1, dtype=np.int32) <= k))
        r, c = np.divmod(np.flatnonzero(better.ravel()), n)
        row = np.concatenate([np.repeat(np.arange(len(hit)), k), r])
        score = np.concatenate([self.score[at + hit].ravel(), rows[r, c].astype(np.int64)])
        found = np.concatenate([self.found[at + hit].ravel(), ids[c]])
        order = np.lexsort((found, ~score, row))
        row = row[order]
        kept = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(hit)))[row] < k]
        self.score[at + hit], self.found[at + hit] = score[kept].reshape(-1, k), found[kept].reshape(-1, k)

    def listed(self, tile: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.own), 16384):
            score, found = self.score[at : at + 16384], self.found[at : at + 16384]
            q, place = np.nonzero(score != LEAST)
            if len(q):
                values = [self.own[at : at + 16384][q], found[q, place], score[q, place], np.full(len(q), tile)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["query_id", "vec_id", "score", "tile"])


def _peak(rows: np.ndarray) -> float:
    return max(-float(rows.min(initial=0)), float(rows.max(initial=0)))


def _search(batches: Iterator[pa.RecordBatch], k: int, step: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The lists of each cell; its queries come before its candidates, and lengths one after the other."""
    key, asked, lists = None, [], None
    for batch in batches:
        cells, kinds, dims, sizes = (batch.column(c).to_pylist() for c in ("cell", "candidates", "dim", "n"))
        for i, now in enumerate(zip(cells, dims, strict=True)):
            if now != key:
                if lists:
                    yield from lists.listed(key[0] % groups)
                key, asked, lists = now, [], None
            if kinds[i] and not asked and not lists:
                continue
            ids, data = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64), batch.column("rows")[i].as_buffer()
            kind = {2: np.int16, 4: np.int32, 8: np.int64}[data.size // max(1, sizes[i] * now[1]) or 2]
            rows = np.frombuffer(data, kind).reshape(sizes[i], now[1])
            if not kinds[i]:
                asked.append((ids.copy(), rows.copy()))  # a view would hold its whole batch
                continue
            if not lists:
                lists, asked = _Lists(asked, k, step), []
            lists.see(ids, rows)
    if lists:
        yield from lists.listed(key[0] % groups)


def exact_topk(
    queries: DataFrame, candidates: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    query_tile: int = 512, data_tile: int = 8192, fan_in: int = 16, block_bytes: int = 64 << 20,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query by quantised inner product."""
    q = quantised(queries, vec_id, vector)
    i = F.col(f"`{vec_id}`")
    c = candidates.where(i.isNotNull() & F.col(f"`{vector}`").isNotNull()).select(i.cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    asked = q.agg(F.sum(F.size("v").cast("long")).alias("components"), F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))).alias("peak")).first()
    components, peak = asked["components"] or 0, asked["peak"] or 0
    rows = candidates.count()
    blocks = max(1, -(-components * (2 if peak < 2**15 else 4 if peak < 2**31 else 8) // block_bytes))
    groups = max(1, min(-(-2 * rows // data_tile), max(8, min(64, rows // (4 * data_tile)), int(components * rows / blocks / CELL_PRODUCTS))))
    # repeated query rows ask the same question once
    tq = q.dropDuplicates(["id", "v"]).mapInArrow(lambda b: _pack(b, query_tile), TILE).withColumn("deal", F.xxhash64("dim", "ids"))
    tc = c.mapInArrow(lambda b: _pack(b, data_tile), TILE).withColumn("deal", F.xxhash64("dim", "ids"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tq = tq.select("*", each(groups).alias("group")).select((F.pmod("deal", F.lit(blocks)) * groups + F.col("group")).alias("cell"), F.lit(0).alias("candidates"), "dim", "n", "ids", "rows")
    tc = tc.select("*", each(blocks).alias("block")).select((F.col("block") * groups + F.pmod("deal", F.lit(groups))).alias("cell"), F.lit(1).alias("candidates"), "dim", "n", "ids", "rows")
    cells = tq.unionByName(tc).repartition(4 * blocks * groups, "cell").sortWithinPartitions("cell", "dim", "candidates")
    found = cells.mapInArrow(lambda b: _search(b, k, query_tile, groups), "query_id long, vec_id long, score long, tile long")
    width = groups
    while True:
        width = -(-width // fan_in)
        found = found.withColumn("tile", F.floor(F.col("tile") / fan_in))
        order = Window.partitionBy("query_id", "tile") if width > 1 else Window.partitionBy("query_id")
        found = found.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        if width <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")
