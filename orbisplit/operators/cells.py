"""Similarity joins and nearest neighbours by cells of a metric space.

Pivots, a sample of the right side, divide the space into cells: a row belongs to its nearest pivot, and a cell knows how many rows it has
and between which distances from its pivot they lie (its ring). A left row visits a cell only if the triangle inequality leaves room for a
row within reach: the ring must be within reach, and the row must not be nearer to another pivot by more than twice the reach. So on
clustered rows most pairs of cells never meet, whatever the number of rows. Where little can be ruled out (by the pivots themselves, whose visits
are counted first), a row would be sent to nearly every cell; then all blocks meet over tiles instead, which sends it a fixed number of times.

Bounds hold for true metrics: cosine distances are turned into angles. Rows that have no angle (shorter than EPS) or no finite distance are in a
cell of their own that everybody visits. Bounds are wider than rounding; distances that are returned are those of the plain join.

Nearest neighbours take two passes. The first visits, for each row, the nearest cells that hold k rows together, and gives an upper bound
of the k-th distance; the second visits what that bound doesn't rule out. At most k rows leave a task for each left row and cell, and in
the second pass none beyond the bound.

Memory: left rows are gathered by cell in a task, HELD of them at most; right cells are cut into blocks of BLOCK rows, so a cell of any size
is spread over tasks. Pivots are at most PIVOT_BYTES; their counts and rings, a row each, are read by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from orbisplit.functions.vectors import EPS
from orbisplit.operators.blocks import BLOCK, BROADCAST, SIDES, alike, close_kernel, each_pair, matrix, nearest_kernel, own_kernel, tiles, unpack
from orbisplit.sources.tables import materialise

#: Rows of a cell on average, and bytes of all pivots.
CELL, PIVOT_BYTES = 512, 32 << 20
#: Left rows that a task holds before it sends them on, and rows whose distances to pivots are taken at once.
HELD, CHUNK = 1 << 16, 256
#: Share of all pairs of rows and cells above which cells don't pay, and pivots that it is counted on.
DENSE, PROBES = 0.25, 256
#: More than rounding, relative to the longest vector.
SLACK = 1e-6


def true_distance(d: np.ndarray, metric: str) -> np.ndarray:
    """A metric that grows with the distance."""
    return np.arccos(np.clip(1.0 - d, -1.0, 1.0)) if metric == "cosine" else d


def longest(reach: float, metric: str) -> float:
    """The true distance of a distance; infinite where it rules nothing out."""
    return float(np.arccos(1.0 - min(max(reach, 0.0), 2.0))) if metric == "cosine" else reach


@dataclass
class Cells:
    """The right side in cells: the last one is of rows without a place."""

    metric: str
    pivots: np.ndarray
    rows: DataFrame
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scale: float


def _to_pivots(v: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """True distances, and which rows have none."""
    with np.errstate(invalid="ignore"):
        d = true_distance(matrix(v, pivots, metric), metric)
    odd = ~np.isfinite(d).all(1)
    if metric == "cosine":
        odd |= ~(np.linalg.norm(v, axis=1) >= EPS)
    return np.where(odd[:, None], 0.0, d), odd


def _slack(v: np.ndarray, metric: str, scale: float) -> np.ndarray:
    """A row's, as a column."""
    return SLACK * (np.ones((len(v), 1)) if metric == "cosine" else 1.0 + scale + np.linalg.norm(v, axis=1, keepdims=True))


def _vectors(c: pa.Array, n: int) -> np.ndarray:
    return np.asarray(c.flatten()).reshape(n, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, CHUNK):
            yield b.slice(start, CHUNK)


def build(right: DataFrame, n: int, metric: str, cell: int = CELL) -> Cells | None:
    """Cells of points (id, v[, label]) of which there are n; none for an empty table."""
    spark = right.sparkSession
    width = right.agg(F.max(F.size("v"))).first()[0]
    if not n or not width:
        return None
    wanted = max(1, min(-(-n // cell), PIVOT_BYTES // (8 * width)))
    sample = right.select("v").orderBy(F.xxhash64("v")).limit(wanted).collect()  # PIVOT_BYTES at most
    pivots = np.unique(np.array([r.v for r in sample], np.float64), axis=0)
    good = np.isfinite(pivots).all(1) & (np.linalg.norm(pivots, axis=1) >= EPS)
    pivots = pivots[good] if good.any() else np.ones((1, width))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            v = _vectors(b.column("v"), b.num_rows)
            d, odd = _to_pivots(v, shared.value, metric)
            at = np.where(odd, len(shared.value), d.argmin(1)).astype(np.int32)
            r = np.where(odd, 0.0, d.min(1))
            size = np.nan_to_num(np.linalg.norm(v, axis=1), nan=0.0, posinf=0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(r), pa.array(size)], [*b.schema.names, "cell", "ring", "size"])

    more = [StructField("cell", IntegerType()), StructField("ring", DoubleType()), StructField("size", DoubleType())]
    rows = materialise(right.mapInArrow(assign, StructType([*right.schema.fields, *more])), "cells")
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("ring").alias("low"), F.max("ring").alias("high"), F.max("size").alias("size")).collect()  # a row a pivot
    count, low, high = np.zeros(len(pivots) + 1, np.int64), np.zeros(len(pivots) + 1), np.full(len(pivots) + 1, -1.0)
    for r in stats:
        count[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return Cells(metric, pivots, rows, count, low, high, max(r.size for r in stats))


def right_blocks(cells: Cells, labels: bool) -> DataFrame:
    """(cell, r_ids, r_v[, r_labels]) of BLOCK rows or fewer, to be broadcast if their counted bytes are within BROADCAST."""
    sizes = [(c, -(-int(n) // BLOCK)) for c, n in enumerate(cells.count) if n]
    table = cells.rows.sparkSession.createDataFrame(sizes, "cell int, blocks int")
    cut = cells.rows.join(F.broadcast(table), "cell")  # a row a pivot
    more = [F.collect_list(F.struct("label"))["label"].alias("r_labels")] if labels else []
    packed = cut.groupBy("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("_block"))
    packed = packed.agg(F.collect_list("id").alias("r_ids"), F.flatten(F.collect_list("v")).alias("r_v"), *more).drop("_block")
    # Where they fit, left rows aren't shuffled to them.
    return F.broadcast(packed) if int(cells.count.sum()) * cells.pivots.shape[1] * 8 <= BROADCAST else packed


#: From distances to pivots, their slack, which rows have no place, and a batch: the cells of pivots that each row visits.
Route = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]


def visits(left: DataFrame, cells: Cells, route: Route, extra: dict[str, str], labels: bool) -> DataFrame:
    """(cell, l_v, l_ids, l_…[, l_labels]): left rows in blocks, for each cell they visit; all visit the cell of rows without a place. extra:
    further columns of left rows (name: type)."""
    spark = left.sparkSession
    shared: Broadcast = spark.sparkContext.broadcast((cells.pivots, cells.count))
    metric, scale = cells.metric, cells.scale
    kind = left.schema["label"].dataType.simpleString() if labels else ""
    names = ["id", *extra, *["label"] * labels]
    schema = "cell int, l_v array<double>, l_ids array<bigint>" + "".join(f", l_{c} array<{t}>" for c, t in extra.items()) + (f", l_labels array<{kind}>" if labels else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, pa.Table]]] = {}
        total = 0

        def send() -> Iterator[pa.RecordBatch]:
            for c, parts in held.items():
                v, t = np.concatenate([p[0] for p in parts]), pa.concat_tables([p[1] for p in parts])
                for start in range(0, len(v), BLOCK):
                    own = t.slice(start, BLOCK)
                    columns = [pa.array([c], pa.int32()), pa.array([v[start : start + BLOCK].ravel()], pa.list_(pa.float64()))]
                    for name in names:
                        column = own.column(name).combine_chunks()
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "l_v", *["l_ids" if n == "id" else "l_labels" if n == "label" else f"l_{n}" for n in names]])

        pivots, count = shared.value
        for b in _chunks(batches):
            v = _vectors(b.column("v"), b.num_rows)
            d, odd = _to_pivots(v, pivots, metric)
            go = np.ones((len(v), len(count)), bool)
            go[:, :-1] = route(d, _slack(v, metric, scale), odd, b)
            go &= count > 0
            table = pa.Table.from_batches([b]).select(names)
            # Rows by how often they are sent: what is held stays near HELD, however many cells there are.
            sent = np.cumsum(go.sum(1)) // HELD
            for step in np.unique(sent):
                at = np.flatnonzero(sent == step)
                i, c = np.nonzero(go[at].T)[::-1]
                i = at[i]
                for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(c)) + 1) if len(i) else []:
                    rows = i[part]
                    held.setdefault(int(c[part[0]]), []).append((v[rows], table.take(pa.array(rows))))
                    total += len(rows)
                if total >= HELD:
                    yield from send()
                    held, total = {}, 0
        yield from send()

    return left.select("id", "v", *[c for c in names if c != "id"]).mapInArrow(run, schema)


def _reached(d: np.ndarray, slack: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float | np.ndarray) -> np.ndarray:
    """Cells that can hold a row within reach: by their ring, and as no row of them is nearer to another pivot."""
    return (d - slack <= high + reach) & (d + slack >= low - reach) & (d - slack <= d.min(1, keepdims=True) + 2 * reach + slack)


def _within(cells: Cells, reach: float) -> Route:
    low, high = cells.low[:-1], cells.high[:-1]

    def route(d: np.ndarray, slack: np.ndarray, odd: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return _reached(d, slack, low, high, reach) | odd[:, None]

    return route


def dense(cells: Cells, reach: float) -> bool:
    """Whether the pivots, taken as rows, visit more than DENSE of the cells' rows."""
    probes = cells.pivots[:: max(1, len(cells.pivots) // PROBES)]
    d, odd = _to_pivots(probes, cells.pivots, cells.metric)
    go = _within(cells, reach)(d, _slack(probes, cells.metric, cells.scale), odd, None)
    return bool((go * cells.count[:-1]).sum() > DENSE * len(probes) * cells.count.sum())


def _all(left: DataFrame, cells: Cells, sides: tuple[int, int] | None = None, labels: bool = False) -> DataFrame:
    """All blocks of left rows with all of the cells' rows."""
    columns = ["id", "v", *["label"] * labels]
    left, n = left.select(*columns), left.count()
    return tiles(left, cells.rows.select(*columns), n, int(cells.count.sum()), cells.pivots.shape[1], *[sides] * bool(sides), labels=labels)


def _columns(labels: bool) -> list[str]:
    return ["l_block", "l_ids", "l_v", "r_block", "r_ids", "r_v", *["l_labels", "r_labels"] * labels]


def pairs_of_blocks(left: DataFrame, cells: Cells, within: float, labels: bool = False, one_way: bool = False) -> DataFrame:
    """Blocks that meet. one_way: left rows are those of the cells, and visit their own and those after it."""
    reach = longest(within, cells.metric)
    bound = _within(cells, reach)

    def ahead(d: np.ndarray, slack: np.ndarray, odd: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        """Rows without a place are in the last cell, which all others visit."""
        return bound(d, slack, odd, b) & (np.arange(d.shape[1]) >= np.asarray(b.column("cell"))[:, None])

    lefts = visits(left, cells, ahead if one_way else bound, {"cell": "int"} if one_way else {}, labels)
    return lefts.join(right_blocks(cells, labels), "cell")


def close_pairs(left: DataFrame, cells: Cells, within: float, other: bool = False, labels: bool = False) -> DataFrame:
    """(l, r, d) up to the distance."""
    metric = cells.metric
    if dense(cells, longest(within, metric)):
        return _all(left, cells, labels=labels).select(*_columns(labels)).mapInArrow(close_kernel(metric, within, other, labels), "l long, r long, d double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                li, lv = unpack(batch, row, "l")
                ri, rv = unpack(batch, row, "r")
                d = matrix(lv, rv, metric)
                keep = d <= within
                if labels:
                    keep &= alike(batch, row)
                if other:
                    keep &= li[:, None] != ri[None, :]
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(li[i]), pa.array(ri[j]), pa.array(d[i, j])], ["l", "r", "d"])

    met = pairs_of_blocks(left, cells, within, labels)
    return met.select("l_ids", "l_v", "r_ids", "r_v", *["l_labels", "r_labels"] * labels).mapInArrow(run, "l long, r long, d double")


def close_self_pairs(cells: Cells, within: float, labels: bool = False) -> DataFrame:
    """(l, r, d) with l < r up to the distance, of the rows of the cells."""
    metric = cells.metric
    if dense(cells, longest(within, metric)):
        met = each_pair(cells.rows.select("id", "v", *["label"] * labels), labels)
        return met.select(*_columns(labels)).mapInArrow(own_kernel(metric, within, labels), "l long, r long, d double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                li, lv = unpack(batch, row, "l")
                ri, rv = unpack(batch, row, "r")
                own = np.asarray(batch.column("l_cell")[row].values) == batch.column("cell")[row].as_py()
                d = matrix(lv, rv, metric)
                # Rows of the cell itself meet each other from both sides.
                keep = (d <= within) & np.where(own[:, None], li[:, None] < ri[None, :], li[:, None] != ri[None, :])
                if labels:
                    keep &= alike(batch, row)
                i, j = np.nonzero(keep)
                x, y = li[i], ri[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d[i, j])], ["l", "r", "d"])

    met = pairs_of_blocks(cells.rows, cells, within, labels, one_way=True)
    return met.select("cell", "l_cell", "l_ids", "l_v", "r_ids", "r_v", *["l_labels", "r_labels"] * labels).mapInArrow(run, "l long, r long, d double")


def _first(count: np.ndarray, wanted: int, d: np.ndarray) -> np.ndarray:
    """The nearest cells of each row that have so many rows together."""
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(count[order], axis=1) - count[order]
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, before < wanted, 1)
    return out


def nearest_by_cells(left: DataFrame, cells: Cells, k: int, other: bool = False) -> tuple[DataFrame, DataFrame]:
    """(l, r, d) that hold the k nearest of every left row, in two passes; and the blocks that met in the second."""
    metric, count, wanted = cells.metric, cells.count[:-1], k + other
    low, high = cells.low[:-1], cells.high[:-1]

    def run(bounded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    li, lv = unpack(batch, row, "l")
                    ri, rv = unpack(batch, row, "r")
                    d = matrix(lv, rv, metric)
                    keep = ~np.isnan(d)
                    if other:
                        keep &= li[:, None] != ri[None, :]
                    if bounded:
                        bound = np.asarray(batch.column("l_bound")[row].values)[:, None]
                        keep &= d <= bound + 1e-12 * (1.0 + np.abs(bound))
                    if d.shape[1] > k:
                        far = np.where(keep, d, np.inf)
                        keep &= d <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(li[i]), pa.array(ri[j]), pa.array(d[i, j])], ["l", "r", "d"])

        return kernel

    blocks = right_blocks(cells, False)
    start = visits(left, cells, lambda d, slack, odd, b: _first(count, wanted, d) | odd[:, None], {}, False).join(blocks, "cell")
    first = materialise(start.select("l_ids", "l_v", "r_ids", "r_v").mapInArrow(run(False), "l long, r long, d double"), "nearest")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("d", "r"))
    bounds = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("l").alias("id"), F.col("d").alias("bound"))
    usual = bounds.agg(F.percentile_approx("bound", 0.5, 100)).first()[0]
    if usual is not None and dense(cells, longest(usual, metric)):
        met = _all(left, cells, SIDES)
        return met.select(*_columns(False)).mapInArrow(nearest_kernel(k, metric, other), "l long, r long, d double"), met
    rows = left.select("id", "v").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def rest(d: np.ndarray, slack: np.ndarray, odd: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        bound = np.asarray(b.column("bound"))
        reach = np.where(np.isfinite(bound), np.arccos(1.0 - np.clip(bound, 0.0, 2.0)), bound) if metric == "cosine" else bound
        return _reached(d, slack, low, high, reach[:, None]) & ~_first(count, wanted, d) & ~odd[:, None]

    second = visits(rows, cells, rest, {"bound": "double"}, False).where(F.col("cell") < len(cells.count) - 1).join(blocks, "cell")
    more = second.select("l_ids", "l_v", "l_bound", "r_ids", "r_v").mapInArrow(run(True), "l long, r long, d double")
    return first.unionByName(more), second
