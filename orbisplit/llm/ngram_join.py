"""Jaccard self-join on word n-grams by rare-first prefix filtering, and the components of its links.

1. Equal sets are one class: everything below works on classes, so copies cost nothing.
2. A count-min sketch of fixed size orders all shingles from rare to frequent (ties by hash). Any order is right; this one
   keeps frequent passages out of the prefixes.
3. A class sends the prefix of its ordered set: linked sets share a shingle there. Shingles that one class alone has go.
4. Round one: where classes share one of their FIRST shingles, each meets the NEIGHBOURS classes before it by set size and hash, and keeps
   the NEIGHBOURS of them that it met most often. That is a number of pairs in proportion to the classes, and it makes one
   component of the near copies of a text, however many.
5. Round two joins what is left: pairs that share a prefix shingle but no component yet, under the length, index-prefix and
   positional filters; first the NEIGHBOURS likeliest of each class, then all that are in two components still. Pairs that were
   seen are left out: each is verified once.
Before a pair is verified on the whole texts, the suffix filter bounds its intersection by counts of each set in
SUFFIX fixed parts of the hash space.

A link between two texts of one component need not be looked at, since it changes no component; no other link is lost.

Defined cases: null and blank texts have an empty set, no links, and themselves as component; fewer words than a shingle make
one shingle; a text of any length gives all its shingles, and a task holds those of a few texts; a null doc_id takes part but is never the smallest (a component of nulls alone has a null id); repeated rows
are answered each; an empty table gives an empty one; further columns are ignored. Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbisplit.llm.common import bounded_batches, materialise
from orbisplit.llm.kernels import U, Words, chunks, mix, windows
from orbisplit.llm.sketches import bloom, build, count_min_add, count_min_read, in_bloom, share
from orbisplit.operators.components import components, extended

#: Words of a shingle; least similarity in hundredths.
SIZE, PERCENT = 5, 75
#: Counters of the sketch that orders shingles: 4 MB.
SKETCH = 1 << 20
#: Classes that a class is paired with in round one.
NEIGHBOURS = 16
#: Shingles of a prefix that round one looks at.
FIRST = 64
#: Parts of the hash space in the suffix filter.
SUFFIX = 64


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts)
    h = w.hashes(lower=True)
    runs = windows(h, size)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        n = b - a
        out.append(np.unique(runs[a : b - size + 1]) if n >= size else windows(h[a:b], int(n)) if n else np.zeros(0, U))
    return out


def _class(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _least(n: Column, up: int, down: int) -> Column:
    """Ceiling of n * up / down, for whole numbers."""
    return F.floor((n * up + (down - 1)) / down).cast("long")


def base_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, set, n, parts): the class of each row's set, its size, and its counts for the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b.column(1)):
                sets = _sets(b.column(1).slice(i, j - i), size)
                parts = [np.bincount((s >> U(58)).astype(np.int64), minlength=SUFFIX).astype(np.uint32).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "set", "n", "parts"],
                )

    return docs.mapInArrow(run, "doc_id long, set long, n long, parts binary")


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, set, n, pos): the prefix of each class, rare shingles first. A task sends a class once."""
    spark = docs.sparkSession

    def add(counters: np.ndarray, b: pa.RecordBatch) -> None:
        for i, j in chunks(b.column(1)):
            count_min_add(counters, np.concatenate(_sets(b.column(1).slice(i, j - i), size)))

    counters = share(spark, build(docs, add, SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, j in chunks(b.column(1)):
                token, cls, n, pos = [], [], [], []
                for s in _sets(b.column(1).slice(i, j - i), size):
                    k = _class(s)
                    if k is None or k in seen:
                        continue
                    seen.add(k)
                    prefix = len(s) - (len(s) * percent + 99) // 100 + 1
                    token.append(s[np.lexsort((s, count_min_read(counters.value, s)))[:prefix]])
                    cls.append(np.full(prefix, k, np.int64))
                    n.append(np.full(prefix, len(s), np.int32))
                    pos.append(np.arange(prefix, dtype=np.int32))
                if len(seen) > 500_000:
                    seen.clear()
                if token:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in token], cls, n, pos)], ["token", "set", "n", "pos"]
                    )

    return docs.mapInArrow(run, "token long, set long, n int, pos int")


def _key(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(cls.view(U) + mix(doc.view(U)))


def _keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(np.asarray(b.column(0)), np.asarray(b.column(1).fill_null(0))).view(np.int64))], ["key"])

    return reps.mapInArrow(run, "key long")


def _texts(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(set, text): one document of each class in reps (set, rep), whose texts alone leave their tasks."""
    words = bloom(_keys(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b.column(1)):
                cls = np.array([_class(s) or 0 for s in _sets(b.column(1).slice(i, j - i), size)], np.int64)
                keep = in_bloom(words.value, _key(cls, np.asarray(b.column(0).slice(i, j - i).fill_null(0))))
                found = pa.RecordBatch.from_arrays([pa.array(cls), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)], ["set", "doc_id", "text"])
                yield found.filter(pa.array(keep))

    return docs.mapInArrow(run, "set long, doc_id long, text string")


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, …) that pass the length and suffix filters, with rep_a and rep_b. reps: set, rep, n, parts."""
    names = [c for c in pairs.columns if c not in ("a", "b")]

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, SUFFIX) for c in ("parts_a", "parts_b"))
                n = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
                keep = (100 + percent) * np.minimum(x, y).sum(1, dtype=np.int64) >= percent * n
                yield b.select(["a", "b", "rep_a", "rep_b", *names]).filter(pa.array(keep))

    side = lambda c: reps.select(F.col("set").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("rep", "n", "parts")])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b", *names))
    schema = kinds.replace(", b bigint", ", b bigint, rep_a bigint, rep_b bigint", 1)
    return materialise(near.mapInArrow(overlap, schema), "join-near")


def _near_texts(docs: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """(set, text) of the classes in near pairs."""
    wanted = near.select(F.explode(F.array(*[F.struct(F.col(c).alias("set"), F.col(f"rep_{c}").alias("rep")) for c in "ab"])).alias("w"))
    wanted = materialise(wanted.select("w.set", "w.rep").distinct(), "join-wanted")
    found = _texts(docs, wanted, size).join(wanted, "set").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    return materialise(found.select("set", "text"), "join-texts")


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: their whole texts are compared."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b.column("text_b")):
                part = b.slice(i, j - i)
                links = []
                known: dict[int, np.ndarray] = {}
                for c in "ab":
                    ids = part.column(c).to_pylist()
                    new = {k: at for at, k in enumerate(ids) if k not in known}
                    known |= dict(zip(new, _sets(part.column(f"text_{c}").take(pa.array(list(new.values()), pa.int64())), size), strict=True))
                for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                    if 100 * both >= percent * (len(known[x]) + len(known[y]) - both):
                        links.append((x, y))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    with_a = pairs.select("a", "b").join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    return materialise(with_b.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "join-links")


def _unordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Add (or replace) a and b: the smaller and the larger of two classes."""
    return pairs.withColumns({"a": F.least(x, y), "b": F.greatest(x, y)})


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))


def classes_and_labels(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The base table, and (set, rep, label) of every class."""
    base = materialise(base_table(docs, size), "join-base")
    reps = base.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    reps = materialise(reps, "join-classes")
    at = Window.partitionBy("token")
    posts = (
        prefixes(docs, size, percent)
        .withColumn("low", F.min("set").over(at))
        .withColumn("high", F.max("set").over(at))
        .where("low <> high")
        .select("token", "set", "n", "pos")
        .distinct()
    )
    posts = materialise(posts, "join-postings")
    in_order = at.orderBy("n", "set")
    before = F.array_compact(F.array(*[F.lag(F.struct("set", "n"), k).over(in_order) for k in range(1, NEIGHBOURS + 1)]))
    met = posts.where(F.col("pos") < FIRST).select("set", "n", before.alias("before")).select("set", "n", F.explode("before").alias("o"))
    met = met.where(F.col("o.n") * 100 >= F.col("n") * percent).groupBy("set", F.col("o.set").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy("set").orderBy(F.desc("c"), "a")
    pairs = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= NEIGHBOURS).select("a", F.col("set").alias("b"))
    near = _near(_unordered(pairs.withColumnRenamed("a", "other"), "other", "b").select("a", "b"), reps, percent)
    links = _links(near, _near_texts(docs, near, size), size, percent)
    labels = materialise(components(links), "join-labels")

    open_posts = _labelled(posts, labels)
    per_label = open_posts.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    tokens = per_label.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    open_posts = materialise(open_posts.join(tokens.where("labels > 1").select("token", "main"), "token"), "join-open")
    # A shingle's largest component stands on one side only: what joins is the rest with all.
    x, y = (open_posts.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("set", "n", "pos", "label", "main")]) for s in "xy")
    x_first = F.struct("n_x", "set_x") < F.struct("n_y", "set_y")
    n_small, n_large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    pos_small = F.when(x_first, F.col("pos_x")).otherwise(F.col("pos_y"))
    need = _least(F.col("n_x") + F.col("n_y"), percent, 100 + percent)
    pairs = (
        x.where("label_x <> main_x").join(y, "token")
        .where(F.col("label_x") != F.col("label_y"))
        .where((F.col("label_y") == F.col("main_y")) | x_first)
        .where(n_small * 100 >= n_large * percent)
        .where(pos_small <= n_small - _least(n_small, 2 * percent, 100 + percent))
        .where(F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= need)
        .groupBy("set_x", "set_y").agg(F.count(F.lit(1)).alias("c"))
    )
    pairs = _unordered(pairs, "set_x", "set_y").join(near.select("a", "b"), ["a", "b"], "left_anti")
    near = _near(pairs.select("a", "b", "set_x", "c"), reps, percent)
    if near.isEmpty():
        return base, _labelled(reps.select("set", "rep"), labels)
    texts = _near_texts(docs, near, size)
    # The likeliest partners of each class come first: where one of them is a link, its other pairs fall away.
    best = Window.partitionBy("set_x").orderBy(F.desc("c"), "a", "b")
    ranked = materialise(near.withColumn("r", F.row_number().over(best)).groupBy("a", "b").agg(F.min("r").alias("r")), "join-ranked")
    first = _links(ranked.where(F.col("r") <= NEIGHBOURS), texts, size, percent)
    labels = materialise(extended(labels, first), "join-labels")
    rest = ranked.where(F.col("r") > NEIGHBOURS).select("a", "b")
    for c in "ab":
        rest = rest.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    rest = _links(rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")), texts, size, percent)
    if not rest.isEmpty():
        labels = materialise(extended(labels, rest), "join-labels")
    return base, _labelled(reps.select("set", "rep"), labels)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base, classes = classes_and_labels(docs, size, percent)
    least = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_set = classes.join(least, "label").select("set", "component_id")
    return base.join(by_set, "set", "left").select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest key, and of several texts under it that of the
    smallest class. Rows are judged by key and text, so other texts under a key that goes stay. Of rows alike in key and set
    the first by their columns stays; rows without a key stay."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base, classes = classes_and_labels(narrow, size, percent)
    best = classes.where("rep is not null").groupBy("label").agg(F.min(F.struct("rep", "set")).alias("best"))
    best = classes.join(best, "label").select("set", "best")
    rows = base.where("doc_id is not null").groupBy("doc_id", "set").agg(F.count(F.lit(1)).alias("n")).join(best, "set", "left")
    stays = F.col("set").isNull() | ((F.col("doc_id") == F.col("best.rep")) & (F.col("set") == F.col("best.set")))
    rows = rows.select(F.col("doc_id").alias("_id"), F.coalesce("set", F.lit(0)).alias("_of"), "n", stays.alias("_stays"))
    # Every other row is the only one of its key and set, and stays.
    judged = materialise(rows.where("n > 1 or not _stays").drop("n"), "join-judged")
    words = bloom(judged.select("_id"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    place, body = docs.columns.index(key), docs.columns.index(text)

    def among(wanted: bool) -> DataFrame:
        """Rows whose key may be, or cannot be, a judged one: only the first leave their tasks, with the class of their set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(place).cast(pa.int64())
                may = in_bloom(words.value, np.asarray(ids.fill_null(0)).view(U)) & ~np.asarray(ids.is_null())
                part = b.filter(pa.array(may == wanted))
                if not wanted:
                    yield part
                    continue
                texts = part.column(body).cast(pa.string())
                for i, j in chunks(texts):
                    found = pa.array([_class(s) or 0 for s in _sets(texts.slice(i, j - i), size)], pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.slice(i, j - i).columns, found], [*names, "_set"])

        more = [StructField("_set", LongType())] if wanted else []
        return renamed.mapInArrow(run, StructType([*renamed.schema.fields, *more]))

    met = among(True)
    met = met.join(judged, (F.col(names[place]).cast("long") == F.col("_id")) & (F.col("_set") == F.col("_of")), "left")
    kept = among(False).unionAll(met.where("_id is null").select(*names))
    if not judged.where("_stays").isEmpty():
        whole = F.struct(*names)
        one = met.where("_stays").groupBy("_id", "_of").agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
        kept = kept.unionAll(one.select("_row.*"))
    return kept.toDF(*docs.columns)
