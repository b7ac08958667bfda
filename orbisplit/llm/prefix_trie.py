"""Conversation prefix trie: what conversations share from their beginning, and the tokens that saves.

Texts are hashed and measured where they are read; no text is shuffled. A node, the sequence of some first turns, is named by three sums
of hashes of (place, turn) over them, so names come from a running sum along each conversation (a two-level scan: a
conversation of any length is cut over many tasks). Nodes are then groups of names, added up before they are shuffled.

A subtree of at most SHARD turns whose parent has more is a unit. Units are dealt to tasks by their names; a task packs units into a
succinct level-order trie (LOUDS): a bit vector with, for each node in order of levels, a one for each child and a zero, and arrays of the
nodes' labels. Parents are found in the bit vector by rank and select, and sums climb the levels from the last to the first.

The heavy upper levels, nodes with more than SHARD turns below them, are merged separately, each round doubling the number of levels that
sums have climbed: their number is at most turns / SHARD for each level, and no task holds them all.

Members' numbers are joined in order in two levels too: pieces of sorted runs, then the pieces of one node in a stream. A digest over a
node's members is sequential by its definition; what meets in its task are the node's numbers as text, 64 kB a row, never in memory at once.

Defined cases: turns of equal number come in order of role, then of the hash of their text; rows repeated whole are turns each; a row
without a conversation is left out; null role or text is empty; further columns are ignored; of an empty table there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.llm.common import bounded_batches, materialise
from orbisplit.operators.scans import Scan

#: Turns (with repetition) of a subtree that one task builds a trie of.
SHARD = 1 << 16
#: A conversation begins with fewer borrowed turns than this.
BORROWED = 9
#: Characters of a piece of joined numbers.
PIECE = 1 << 16
#: A node's name; and that of its parent.
NAME, PARENT = ["k1", "k2", "k3"], ["p1", "p2", "p3"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, a, b, size): texts as two hashes and their UTF-8 bytes."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    return rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b"), F.octet_length("text").cast("long").alias("size"))


def borrowed(c: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return (F.crc32(c.cast("string").cast("binary")) % BORROWED).cast("long")


def rebuilt(df: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, role, a, b, size) of rebuilt conversations, and the ids (conv_id) of all."""
    placed = materialise(Scan(turns(df), ["conv_id"], ["turn", "role", "a", "b", "size"]).number("place").rows(), "turns")
    ids = placed.where("place = 1").select("conv_id")
    c = F.col("conv_id")
    own = placed.where(F.col("place") > borrowed(c))
    # A conversation lends its first turns, as many as any borrows, to those of its group that exist.
    lent = placed.where((F.pmod(c, F.lit(group)) == 0) & (F.col("place") < BORROWED)).withColumn("conv_id", F.explode(F.sequence(c, c + (group - 1))))
    lent = lent.where(F.col("place") <= borrowed(c)).join(ids, "conv_id", "left_semi")
    return own.unionByName(lent).select("conv_id", "place", "role", "a", "b", "size"), ids


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, length, size, k1.., p1..): each turn with the names of its node and that node's parent."""
    s = Scan(rows, ["conv_id"], ["place"]).number("depth", "length")
    part = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(i), "depth", "role", "a", "b", "size"), 33)  # noqa: E731  31 bits: sums of 2**32 turns fit
    s = s.add({f"x{i}": part(i) for i in (1, 2, 3)}).running({f"k{i}": F.col(f"x{i}") for i in (1, 2, 3)})
    return s.rows().select("conv_id", "depth", "length", "size", *NAME, *[(F.col(f"k{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2, 3)])


def louds(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit vector of nodes in order of levels (0 is the root; siblings together, in order of their parents), and the degrees."""
    degree = np.bincount(parent[1:], minlength=len(parent))
    bits = np.ones(len(parent) * 2 - 1, bool)
    bits[np.cumsum(degree) + np.arange(len(parent))] = False
    return bits, degree


def parents(bits: np.ndarray) -> np.ndarray:
    """Parents of nodes 1.. by the bit vector: the i-th one lies in the run of its parent, whose number is the zeros before."""
    ones = np.flatnonzero(bits)  # select1
    return (np.cumsum(~bits) - ~bits)[ones]  # rank0


def level_order(level: np.ndarray, names: list[bytes], above: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Nodes sorted by level -> the order in which siblings stand together below a common root, the parent's place of each (root: -1), and
    where levels begin."""
    place: dict[bytes, int] = {}
    order, parent, bounds = [], [-1], [0, 1]
    for nodes in np.split(np.arange(len(level)), np.flatnonzero(np.diff(level)) + 1):
        at = np.array([place.get(above[i], 0) for i in nodes], np.int64)
        moved = np.argsort(at, kind="stable")
        place |= {names[nodes[j]]: len(parent) + n for n, j in enumerate(moved)}
        order.append(nodes[moved])
        parent += at[moved].tolist()
        bounds.append(len(parent))
    return np.concatenate(order), np.array(parent), bounds


def rollup(units: list[pa.RecordBatch]) -> pa.Table:
    """Children, leaves and savings of the nodes of some units; their tops hang on a common root."""
    nodes = pa.Table.from_batches(units).sort_by([("level", "ascending"), *[(c, "ascending") for c in NAME]])
    level, size, n = (np.asarray(nodes.column(c)) for c in ("level", "size", "n_convs"))
    key = lambda cols: [row.tobytes() for row in np.stack([np.asarray(nodes.column(c)) for c in cols], 1)]
    order, parent, bounds = level_order(level, key(NAME), key(PARENT))
    bits, degree = louds(parent)
    up = parents(bits)
    leaves, saved = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    leaves[1:] = degree[1:] == 0
    saved[1:] = (n[order] - 1) * size[order]
    for start, end in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):  # the last level first
        np.add.at(leaves, up[start - 1 : end - 1], leaves[start:end])
        np.add.at(saved, up[start - 1 : end - 1], saved[start:end])
    conv = np.asarray(nodes.column("conv_id"))[order]
    over = up > 0
    parent_conv = np.where(over, conv[np.maximum(up - 1, 0)], 0)
    out = nodes.select(["conv_id", "depth", "n_convs", *NAME, *PARENT]).take(pa.array(order))
    for name, column in (
        ("parent_conv_id", pa.array(parent_conv, pa.int64(), mask=~over)), ("n_children", pa.array(degree[1:])), ("n_leaves", pa.array(leaves[1:])), ("saved_tokens", pa.array(saved[1:])),
    ):
        out = out.append_column(name, column)
    return out


TRIE = "conv_id long, depth long, n_convs long, k1 long, k2 long, k3 long, p1 long, p2 long, p3 long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def tries(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of units with what their subtrees come to. Units of a task are taken together up to SHARD nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for b in batches:
            unit = np.asarray(b.column("u1"))
            ends = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), b.num_rows]
            for start, end in zip(ends, ends[1:], strict=False):
                if start == end:
                    continue
                if n >= shard and unit[start] != last:
                    yield from rollup(held).to_batches()
                    held, n = [], 0
                held.append(b.slice(start, end - start))
                n, last = n + end - start, unit[start]
        if held:
            yield from rollup(held).to_batches()

    dealt = nodes.repartition("u1", "u2", "u3").sortWithinPartitions("u1", "u2", "u3")
    return dealt.select("u1", "conv_id", "depth", "level", "size", "n_convs", *NAME, *PARENT).mapInArrow(run, TRIE)


def merge_heavy(heavy: DataFrame) -> DataFrame:
    """heavy (k.., p.., leaves, saved): what lies in each node's whole subtree, from what each has outside of heavy children. Sums climb
    one level, then two, then four."""
    state = heavy.select(*NAME, *[F.col(p).alias(f"up{i}") for i, p in enumerate(PARENT, 1)], "depth", "leaves", "saved")
    state = materialise(state.withColumns({f"up{i}": F.when(F.col("depth") > 0, F.col(f"up{i}")) for i in (1, 2, 3)}), "heavy")
    while not state.where("up1 is not null").isEmpty():
        given = state.where("up1 is not null").groupBy(*[F.col(f"up{i}").alias(f"k{i}") for i in (1, 2, 3)]).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_up = state.select(*[F.col(f"k{i}").alias(f"up{i}") for i in (1, 2, 3)], *[F.col(f"up{i}").alias(f"next{i}") for i in (1, 2, 3)])
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        moved = state.join(given, NAME, "left").join(next_up, ["up1", "up2", "up3"], "left")
        state = materialise(moved.select(*NAME, *[F.col(f"next{i}").alias(f"up{i}") for i in (1, 2, 3)], "depth", plus("leaves", "more_leaves"), plus("saved", "more_saved")), "heavy")
    return state.select(*NAME, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def members(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k.., ends_sha256) of ends (k.., conv_id)."""
    row = "k1 long, k2 long, k3 long, first long, text string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node's numbers as text, cut at PIECE characters."""
        name, numbers, chars = None, [], 0
        done: list[tuple] = []
        for b in batches:
            for *now, c in zip(*(b.column(x).to_pylist() for x in (*NAME, "conv_id")), strict=True):
                if now != name or chars > piece:
                    if numbers:
                        done.append((*name, numbers[0], ",".join(map(str, numbers))))
                    name, numbers, chars = now, [], 0
                numbers.append(c)
                chars += 20
            yield from _rows(done, row)
            done = []
        if numbers:
            yield from _rows([(*name, numbers[0], ",".join(map(str, numbers)))], row)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, hashlib.sha256()
        for b in batches:
            done = []
            for *now, text in zip(*(b.column(x).to_pylist() for x in (*NAME, "text")), strict=True):
                if now == name:
                    h.update(b"," + text.encode())
                    continue
                if name is not None:
                    done.append((*name, h.hexdigest()))
                name, h = now, hashlib.sha256(text.encode())
            yield from _rows(done, "k1 long, k2 long, k3 long, ends_sha256 string")
        if name is not None:
            yield from _rows([(*name, h.hexdigest())], "k1 long, k2 long, k3 long, ends_sha256 string")

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select(*NAME, "conv_id").repartitionByRange(n, *NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").mapInArrow(join, row)
    return pieces.repartition(*NAME).sortWithinPartitions(*NAME, "first").select(*NAME, "text").mapInArrow(digest, "k1 long, k2 long, k3 long, ends_sha256 string")


def _rows(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [f.split(" ") for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def trie(df: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    bounded_batches(df.sparkSession)
    rows, ids = rebuilt(df)
    path = materialise(paths(rows), "paths")
    zero = F.lit(0).cast("long")
    # The root: every conversation, those without turns too.
    everyone = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = everyone.select("conv_id", zero.alias("depth"), "n_convs", zero.alias("size"), *[zero.alias(c) for c in (*NAME, *PARENT)], F.lit((1 << 63) - 1).alias("turns"))
    below = path.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.any_value("size").alias("size"),
        *[F.any_value(p).alias(p) for p in PARENT], F.sum(F.col("length") - F.col("depth") + 1).alias("turns"),
    )
    nodes = materialise(below.unionByName(root), "nodes")
    heavy = materialise(nodes.where(F.col("turns") > shard), "heavy-nodes")
    # Of each conversation, how deep its path is heavy; its unit begins one below.
    deep = path.join(heavy.where("depth > 0").select(*NAME), NAME, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deep"))
    tops = path.join(deep, "conv_id", "left").where(F.col("depth") == F.coalesce("deep", zero) + 1)
    unit = tops.select("conv_id", *[F.col(f"k{i}").alias(f"u{i}") for i in (1, 2, 3)], F.col("depth").alias("top"))
    light = nodes.where(F.col("turns") <= shard).join(unit, "conv_id").withColumn("level", F.col("depth") - F.col("top"))
    built = materialise(tries(light, shard), "tries")
    # What heavy nodes have outside of heavy children: units, and themselves.
    over = built.where("parent_conv_id is null").select(*PARENT, "n_leaves", "saved_tokens")
    kin = over.unionByName(heavy.where("depth > 0").select(*PARENT, zero.alias("n_leaves"), zero.alias("saved_tokens")))
    kin = kin.groupBy(*[F.col(f"p{i}").alias(f"k{i}") for i in (1, 2, 3)]).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper = heavy.join(kin, NAME, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaves": F.coalesce("leaves", zero), "saved": F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("size"),
    })
    upper = materialise(upper.withColumn("leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves"))), "upper")
    merged = upper.select("conv_id", "depth", "n_convs", "n_children", *NAME, *PARENT).join(merge_heavy(upper), NAME)
    parent = heavy.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(f"k{i}").alias(f"p{i}") for i in (1, 2, 3)])
    inner = built.where("parent_conv_id is not null")
    outer = built.where("parent_conv_id is null").drop("parent_conv_id").unionByName(merged)
    # The root's name is its parent's too, and it has none.
    outer = outer.join(parent, PARENT, "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    ends = path.where("depth = length").select(*NAME, "conv_id").unionByName(ids.join(path.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(*[zero.alias(c) for c in NAME], "conv_id"))
    every = inner.unionByName(outer).join(members(ends), NAME, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
