"""Blocks of vectors: how they are packed, which of them meet in a task, distances of two by one matrix product, the nearest of a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.functions.vectors import EPS

BLOCK = 1024
BROADCAST = 16 << 20
#: Rows of a block, tiles along a side, and bytes of a tile's side above which there are more of them.
TILE_BLOCK, SIDE, TILE_BYTES = 2048, 12, 64 << 20
#: Tiles along the left and the right side where each tile sends on some rows of every left one.
SIDES = (24, 4)
#: Relative error of a distance in single precision, many times over.
SINGLE = 1e-5
#: Most that the steps of a row's components come to, in 16 bits; rows of a block from which sums of differences are taken so.
WHOLE, TURNED = 32000, 256


def packed(p: DataFrame, n: int, side: str, labels: bool = False) -> DataFrame:
    """Points (id, v[, label]) in n blocks by a hash of the id."""
    rows = p.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{side}_block"))
    more = [F.collect_list(F.struct("label"))["label"].alias(f"{side}_labels")] if labels else []
    return rows.agg(F.collect_list("id").alias(f"{side}_ids"), F.flatten(F.collect_list("v")).alias(f"{side}_v"), *more)


def tiles(left: DataFrame, right: DataFrame, n_left: int, n_right: int, width: int, sides: tuple[int, int] = (SIDE, SIDE), labels: bool = False, once: bool = False) -> DataFrame:
    """Pairs of blocks of two tables (n_left and n_right rows), all with all, those of a left block one after another. Blocks are dealt over tiles of
    some left and some right blocks, so a row is sent as often as there are tiles along the other side and not to each block by itself: the rows sent
    grow with the tables. once: both are the same table, and each unordered pair of blocks meets once."""
    blocks = [max(1, -(-n // TILE_BLOCK)) for n in (n_left, n_right)]
    g = [min(b, max(s, -(-n * width * 8 // TILE_BYTES))) for b, s, n in zip(blocks, sides, (n_left, n_right), strict=True)]
    a, b = packed(left, blocks[0], "l", labels), packed(right, blocks[1], "r", labels)
    i, j = F.pmod("l_block", F.lit(g[0])).cast("int"), F.pmod("r_block", F.lit(g[1])).cast("int")
    a = a.withColumn("l_tile", i).withColumn("r_tile", F.explode(F.sequence(F.col("l_tile") if once else F.lit(0), F.lit(g[1] - 1))))
    b = b.withColumn("r_tile", j).withColumn("l_tile", F.explode(F.sequence(F.lit(0), F.col("r_tile") if once else F.lit(g[0] - 1))))
    n = max(g[0] * (g[1] + 1) // 2 if once else g[0] * g[1], 1)
    met = a.repartition(n, "l_tile", "r_tile").join(b.repartition(n, "l_tile", "r_tile").hint("merge"), ["l_tile", "r_tile"])
    return met.where("l_tile < r_tile or l_block <= r_block") if once else met


def each_pair(p: DataFrame, labels: bool = False) -> DataFrame:
    """Pairs of blocks of one table, each unordered pair once. Every block meets half of those that follow it around a circle, so tasks
    have equal shares."""
    n_rows, width = p.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n_rows * (width or 1) * 8 > BROADCAST:
        return tiles(p, p, n_rows, n_rows, width, labels=labels, once=True)
    n = max(1, min(max(p.sparkSession.sparkContext.defaultParallelism, -(-n_rows // BLOCK)), max(n_rows, 1)))
    a, b = (packed(p, n, side, labels) for side in "lr")
    ahead = 2 * F.pmod(F.col("r_block") - F.col("l_block"), F.lit(n))
    once = (ahead < n) | ((ahead == n) & (F.col("l_block") < F.col("r_block")))
    return a.join(F.broadcast(b), once)


class Nearest:
    """The k smallest distances of each row of one left block, ties by id, over the right blocks that it meets."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, metric: str) -> None:
        self.ids, self.v, self.k, self.metric = ids, v, k, metric
        if metric == "cosine":
            self.v = _unit(v)
            self.single = self.v.astype(np.float32)
        self.limit = np.full(len(ids), np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.pending = 0

    def add(self, ids: np.ndarray, v: np.ndarray, keep: np.ndarray | None, within: float = np.inf) -> None:
        """Angles are first taken in single precision; what is near enough by that is taken again."""
        if self.metric == "cosine":
            v = _unit(v)
            d, slack = 1.0 - self.single @ v.astype(np.float32).T, max(SINGLE, v.shape[1] * 2e-7)
        else:
            d, slack = matrix(self.v, v, self.metric), 0.0
        if d.shape[1] > self.k and np.isinf(self.limit).any():
            x = np.where(np.isnan(d) if keep is None else ~keep | np.isnan(d), np.inf, d)
            self.limit = np.minimum(self.limit, np.partition(x, self.k - 1, axis=1)[:, self.k - 1] + slack)
        at = np.flatnonzero(d <= (np.minimum(self.limit, within) + slack)[:, None].astype(d.dtype))
        i, j = np.divmod(at, max(d.shape[1], 1))
        if keep is not None:
            i, j = (x[keep[i, j]] for x in (i, j))
        if slack:
            exact = [np.einsum("ij,ij->i", self.v[i[n : n + 8192]], v[j[n : n + 8192]]) for n in range(0, len(i), 8192)]
            d = np.maximum(1.0 - np.concatenate([np.zeros(0), *exact]), 0.0)
            near = d <= np.minimum(self.limit[i], within)
            i, j, d = i[near], j[near], d[near]
        else:
            d = d[i, j]
        self.held.append((i, ids[j], d))
        self.pending += len(i)
        if self.pending > len(self.ids) * self.k:
            self._cut()

    def _cut(self) -> None:
        i, r, d = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((r, d, i))
        i, r, d = i[order], r[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.limit[i[last]] = d[last]
        first = place < self.k
        self.held, self.pending = [(i[first], r[first], d[first])], 0

    def found(self) -> pa.RecordBatch:
        self._cut()
        i, r, d = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(r), pa.array(d)], ["l", "r", "d"])


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def nearest_kernel(k: int, metric: str, other: bool, labels: bool = False, within: float | None = None) -> Kernel:
    """(l, r, d): at most k rows for each row of a left block and run of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                li, lv = unpack(batch, row, "l")
                ri, rv = unpack(batch, row, "r")
                if block != (now := batch.column("l_block")[row].as_py()):
                    if best is not None:
                        yield best.found()
                    block, best = now, Nearest(li, lv, k, metric)
                keep = alike(batch, row) if labels else None
                if other and np.isin(li, ri).any():
                    own = li[:, None] != ri[None, :]
                    keep = own if keep is None else keep & own
                best.add(ri, rv, keep, np.inf if within is None else within)
        if best is not None:
            yield best.found()

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)


def matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of a to each row of b."""
    if metric == "cosine":
        return np.maximum(1.0 - _unit(a) @ _unit(b).T, 0.0)
    if metric == "euclidean":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))
    if metric == "manhattan":
        out = np.empty((len(a), len(b)))
        for i in range(0, len(a), 64):
            out[i : i + 64] = np.abs(a[i : i + 64, None, :] - b[None, :, :]).sum(2)
        return out
    raise ValueError(f"unknown metric {metric!r}")


def unpack(b: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(b.column(f"{side}_ids")[row].values)
    return ids, np.asarray(b.column(f"{side}_v")[row].values).reshape(len(ids), -1)


def alike(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Which pairs have equal labels, or one without."""
    sides = [np.array(batch.column(f"{s}_labels")[row].as_py(), object) for s in "lr"]
    codes = {None: 0}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in sides)
    return (a[:, None] == b[None, :]) | (a == 0)[:, None] | (b == 0)[None, :]


def close(a: np.ndarray, b: np.ndarray, metric: str, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs up to a distance, and their distances. Sums of absolute differences are first taken in whole numbers or in single
    precision, and what is near enough by that is taken again; the others are one matrix product."""
    if metric == "cosine":
        c = _unit(a) @ _unit(b).T
        i, j = np.divmod(np.flatnonzero(c >= 1.0 - within - 1e-12), max(len(b), 1))
        d = np.maximum(1.0 - c[i, j], 0.0)
        keep = d <= within
        return i[keep], j[keep], d[keep]
    if metric != "manhattan":
        d = matrix(a, b, metric)
        i, j = np.divmod(np.flatnonzero(d <= within), max(len(b), 1))
        return i, j, d[i, j]
    size = (np.abs(a).sum(1)[:, None].max(initial=0.0) + np.abs(b).sum(1).max(initial=0.0)) * SINGLE
    if not np.isfinite(size) or size > np.finfo(np.float32).max / 1e6:
        d = matrix(a, b, metric)
        i, j = np.nonzero(d <= within)
        return i, j, d[i, j]
    if min(len(a), len(b)) >= TURNED and a.shape[1] <= WHOLE // 100 and np.isfinite(within):
        if len(a) <= len(b):
            return _close_whole(a, b, within)
        j, i, d = _close_whole(b, a, within)
        return i, j, d
    x, y = a.astype(np.float32), np.ascontiguousarray(b.T, np.float32)
    found = []
    for start in range(0, len(x), 32):
        part = x[start : start + 32]
        total, one = np.zeros((len(part), len(b)), np.float32), np.empty((len(part), len(b)), np.float32)
        for k in range(a.shape[1]):
            np.subtract(part[:, k, None], y[k], out=one)
            np.abs(one, out=one)
            total += one
        i, j = np.nonzero(total <= within + size)
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192] + start, j[at : at + 8192]
            d = np.abs(a[p] - b[q]).sum(1)
            keep = d <= within
            found.append((p[keep], q[keep], d[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _close_whole(a: np.ndarray, b: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``close`` by sums of absolute differences, len(a) <= len(b), all finite. Components become steps of one width, 16 bits each, of which |x - y| is
    x + y - 2 min(x, y); what each row loses by that is known, so no pair is lost. Rows of a meet those of b turned by 0, 1, 2 …: both lie
    in order, and one minimum and one sum settle a turn."""
    low = min(a.min(), b.min())
    step = (max(a.max(), b.max()) - low) / (WHOLE // a.shape[1]) or 1.0
    whole, least = [], []
    for x in (a, b):
        q = np.rint((x - low) / step)
        lost = np.abs(x - low - q * step).sum(1) / step
        whole.append(np.ascontiguousarray(q.T, np.int16))
        least.append((q.sum(1) - lost) / 2.0)
    x, y = whole[0], np.concatenate([whole[1], whole[1][:, : len(a)]], 1)
    # How much the minima must come to at least is a share of either row's.
    need_a = (np.floor(least[0]) - 1).astype(np.int16)
    need_b = np.clip(np.floor(least[1] - within / step / 2.0), -(WHOLE // 2), WHOLE // 2).astype(np.int16)
    need_b = np.concatenate([need_b, need_b[: len(a)]])
    both, total, need = np.empty_like(x), np.empty(len(a), np.int16), np.empty(len(a), np.int16)
    found, held, n = [], [], 0
    for turn in range(len(b)):
        np.minimum(x, y[:, turn : turn + len(a)], out=both)
        np.add.reduce(both, 0, dtype=np.int16, out=total)
        np.add(need_a, need_b[turn : turn + len(a)], out=need)
        i = np.flatnonzero(total >= need)
        held.append((i, i + turn))
        n += len(i)
        if n >= 1024 or turn == len(b) - 1:
            p, q = (np.concatenate(c) for c in zip(*held, strict=True))
            q[q >= len(b)] -= len(b)
            held, n = [], 0
            for at in range(0, len(p), 4096):
                i, j = p[at : at + 4096], q[at : at + 4096]
                d = b.take(j, 0)
                d -= a.take(i, 0)
                d = np.abs(d, out=d).sum(1)
                keep = d <= within
                found.append((i[keep], j[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def close_kernel(metric: str, within: float | None, other: bool, labels: bool) -> Kernel:
    """(l, r, d) up to a distance, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                li, lv = unpack(batch, row, "l")
                ri, rv = unpack(batch, row, "r")
                if within is None:
                    d = matrix(lv, rv, metric)
                    i, j = (x.ravel() for x in np.indices(d.shape))
                    d = d.ravel()
                else:
                    i, j, d = close(lv, rv, metric, within)
                keep = alike(batch, row)[i, j] if labels else np.ones(len(i), bool)
                if other:
                    keep &= li[i] != ri[j]
                yield pa.RecordBatch.from_arrays([pa.array(li[i[keep]]), pa.array(ri[j[keep]]), pa.array(d[keep])], ["l", "r", "d"])

    return run


def pair_distances(batch: pa.RecordBatch, row: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, distances, and which of them count: within a block, those of a smaller id with a larger one."""
    li, lv = unpack(batch, row, "l")
    ri, rv = unpack(batch, row, "r")
    one = batch.column("l_block")[row].as_py() == batch.column("r_block")[row].as_py()
    return li, ri, matrix(lv, rv, metric), (li[:, None] < ri[None, :]) if one else (li[:, None] != ri[None, :])


def pair_band(batch: pa.RecordBatch, row: int, metric: str, low: float, high: float) -> tuple[int, int, np.ndarray]:
    """How many pairs have a distance, how many of those are below low, and the distances from low to high. Pairs count as in ``pair_distances``; blocks
    are parts by id, so an id meets itself in its own block alone. Angles are first taken in single precision, and what may lie
    in the band is taken again, each pair by itself: a distance is the same in every pass."""
    li, a = unpack(batch, row, "l")
    ri, b = unpack(batch, row, "r")
    one = batch.column("l_block")[row].as_py() == batch.column("r_block")[row].as_py()
    n, below, found = 0, 0, [np.zeros(0)]
    if metric == "cosine":
        a, b = _unit(a), _unit(b)
        x, y = a.astype(np.float32), np.ascontiguousarray(b.T, np.float32)
        slack = max(SINGLE, a.shape[1] * 2e-7)
        least, most = np.float32(1.0 - high - slack), np.float32(1.0 - low + slack)
    good = [~np.isnan(v).any(1) for v in (a, b)] if metric == "cosine" else None
    for start in range(0, len(a), TURNED):
        keep = li[start : start + TURNED, None] < ri[None, :] if one else None
        if metric != "cosine":
            d = matrix(a[start : start + TURNED], b, metric)
            d = d[~np.isnan(d) if keep is None else keep & ~np.isnan(d)]
            n, below = n + len(d), below + int(np.count_nonzero(d < low))
            found.append(d[(d >= low) & (d <= high)])
            continue
        c = x[start : start + TURNED] @ y
        rows = good[0][start : start + TURNED]
        if keep is None:
            n += int(rows.sum()) * int(good[1].sum())
        else:
            n += int(np.count_nonzero(keep & rows[:, None] & good[1][None, :]))
            c[~keep] = np.nan
        over = c > most
        if low > 0.0:
            below += int(np.count_nonzero(over))
        at = np.flatnonzero((c >= least) ^ over if low > 0.0 else c >= least)
        i, j = np.divmod(at, max(len(b), 1))
        for k in range(0, len(at), 8192):
            d = np.maximum(1.0 - np.einsum("ij,ij->i", a[i[k : k + 8192] + start], b[j[k : k + 8192]]), 0.0)
            below += int(np.count_nonzero(d < low))
            found.append(d[(d >= low) & (d <= high)])
    return n, below, np.concatenate(found)


def own_kernel(metric: str, within: float | None, labels: bool) -> Kernel:
    """(l, r, d) with l < r, of pairs of blocks of one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if within is None:
                    li, ri, d, keep = pair_distances(batch, row, metric)
                    i, j = np.nonzero(keep & alike(batch, row) if labels else keep)
                    x, y, d = li[i], ri[j], d[i, j]
                else:
                    li, lv = unpack(batch, row, "l")
                    ri, rv = unpack(batch, row, "r")
                    i, j, d = close(lv, rv, metric, within)
                    x, y = li[i], ri[j]
                    keep = x < y if batch.column("l_block")[row].as_py() == batch.column("r_block")[row].as_py() else x != y
                    if labels:
                        keep &= alike(batch, row)[i, j]
                    x, y, d = x[keep], y[keep], d[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d)], ["l", "r", "d"])

    return run
