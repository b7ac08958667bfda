"""Exact removal of word windows that start in an earlier document, behind a count-min prefilter.

1. Prefilter. A window of 13 words is counted under its anchor: the smallest hash among its runs of 8 words. Equal windows
   have equal anchors, so the number of texts with an anchor is never below that of any of its windows. A task adds the
   anchors of its texts, each once a text, to its partition sketch: two rows of counters, sent sparse (index, count up to
   two). Sketches are merged by shard, a shard being two rows of at most ``CELLS`` counters whatever the data; there are as many shards as the
   counted windows ask for, since a sketch that fits every task would be full at some size of corpus and let all through. So
   texts ask the shards: the smaller of an anchor's two counters is its estimate, and a text hears of its anchors with an estimate of
   two or more. A shard reads its sketches first, then answers in a stream, and holds its counters alone.
2. Exact pass. Only windows under such an anchor go on, each with the number of its document; the smallest is found per
   96-bit window hash, and later documents learn which of their windows to drop. None that repeats is lost: an
   estimate may be too high, never too low.

Equal texts are one class throughout and take part as their smallest doc_id alone: the others are left out by an exact join behind a
Bloom filter, so that only they are shuffled. Tasks settle what they can see: of an anchor or window that many of a task's texts
hold, one entry is sent. So a passage that a third of all documents share sends as many entries as there are tasks.

Defined cases: a null or blank text has no words (the digest of kept words is that of the empty string); texts below the
window size are kept whole; texts of any length are read whole, a few megabytes or one text at once; a null doc_id is neither earlier nor later than any other; repeated rows of one doc_id keep
their words, as no smaller doc_id has them; an empty table gives an empty one; further columns are ignored. Window hashes
have 96 bits; classes of equal texts have 64, as do the windows of a single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import bounded_batches, materialise
from orbisplit.llm.kernels import U, Words, chunks, mix, windows
from orbisplit.llm.sketches import bloom, in_bloom

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 8
#: Entries that a task gathers before it settles and sends them.
FLUSH = 750_000
#: Counters of a shard in each of the two rows of the sketch at least and at most, and counters for each anchor that is expected.
LEAST_CELLS, CELLS, SPARE = 1 << 16, 1 << 24, 4


def classes(w: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order."""
    return np.array([_fold(hashes[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], U)


def _fold(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def _anchors(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each of n windows, the smallest hash of its runs of ANCHOR words."""
    runs = windows(hashes, ANCHOR)
    out = runs[:n].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(out, runs[j : j + n], out=out)
    return out


class _Text:
    """Windows of one chunk of texts, without those that span two."""

    def __init__(self, texts: pa.Array, second: bool = False) -> None:
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        self.classes = classes(self.words, self.hashes)
        all_windows = windows(self.hashes, WINDOW)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.words.bounds))
        n = len(all_windows)
        self.inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n]) if n else np.zeros(0, np.int64)
        self.owner = owner[self.inside]
        self.window = all_windows[self.inside]
        self.anchor = _anchors(self.hashes, n)[self.inside] if n else np.zeros(0, U)
        # Word hashes of another seed make the further 32 bits of a window's hash.
        self.more = (windows(self.words.hashes(seed=1), WINDOW)[self.inside] >> U(32)).astype(np.uint32) if second and n else None


def _cell(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shard and place in one number: shard << 32 | place."""
    return ((anchor & U(0xFFFFFFFF)) % U(shards)) << U(32) | anchor >> U(32)


def _counters(place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A place's two counters: one in each row, as numbers below 2 * width."""
    place = place.astype(U) & U(0xFFFFFFFF)
    return place & U(width - 1), U(width) + (mix(place) >> U(20) & U(width - 1))


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, true where a group starts."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _shape(n_windows: int, partitions: int) -> tuple[int, int]:
    """Shards, and counters of a row of each: SPARE for each anchor, of which there is about one in three windows. Some shards for
    each partition of the shuffle keep partitions even; a shard's counters stay within CELLS, and shards grow beyond."""
    wanted = n_windows * SPARE // 3
    shards = 8 * partitions
    width = min(max(1 << max(0, wanted // shards).bit_length(), LEAST_CELLS), CELLS)
    return max(shards, -(-wanted // width)), width


def base_table(docs: DataFrame) -> DataFrame:
    """(doc_id, class, n_words, kept_sha256 of the whole text), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b.column(1)):
                w = Words(b.column(1).slice(i, j - i))
                digest = [hashlib.sha256(w.kept(k)).hexdigest() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(classes(w, w.hashes()).view(np.int64)), pa.array(np.diff(w.bounds).astype(np.int64)), pa.array(digest)],
                    ["doc_id", "class", "n_words", "kept_sha256"],
                )

    return docs.mapInArrow(run, "doc_id long, class long, n_words long, kept_sha256 string")


_PAIR = pa.schema([("class", pa.int64()), ("key", pa.int64())])


def _pairs(classes_: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(classes_.view(np.int64)), pa.array(keys.view(np.int64))], schema=_PAIR)


def _flushed(
    batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], settle: Callable[..., Iterator[pa.RecordBatch]], flush: int
) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        for columns in read(b):
            held.append(columns)
            size += len(columns[0])
            if size >= flush:
                yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))


_SENT = "shard int, kind int, a binary, b binary, c binary, d binary"


def _sent(shard: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    four = [*(c.tobytes() for c in columns), *[b""] * (4 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (shard, kind)] + [pa.array([c], pa.binary()) for c in four], ["shard", "kind", *"abcd"])


def partition_sketch(cells: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counters that one text raises, counters that more do) of the cells of some texts, each once a text."""
    at = np.concatenate([cells >> U(32) << U(32) | c for c in _counters(cells, width)])
    at, n = np.unique(at, return_counts=True)
    shard = (at >> U(32)).astype(np.int64)
    at = at.astype(np.uint32)
    starts = np.flatnonzero(_group_starts(shard))
    for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
        yield int(shard[a]), at[a:b][n[a:b] == 1], at[a:b][n[a:b] > 1]


def merge_sketch(counters: np.ndarray, once: np.ndarray, more: np.ndarray) -> None:
    """Add a partition sketch to the counters of its shard; two stands for two or more."""
    counters[once] = np.minimum(counters[once] + 1, 2)
    counters[more] = 2


def estimates(counters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The smaller of two counters: never below the number of texts, up to two."""
    a, b = _counters(places, len(counters) // 2)
    return np.minimum(counters[a], counters[b])


def repeated_cells(texts: DataFrame, shards: int, width: int, flush: int = FLUSH) -> DataFrame:
    """(class, key): cells with an estimate of two texts or more, given to each of their texts. texts: class, doc_id, text."""

    def read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in chunks(b.column(2)):
            t = _Text(b.column(2).slice(i, j - i))
            yield _distinct(_cell(t.anchor, shards), t.classes[t.owner])

    def settle(cell: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, cls = _distinct(cell, cls)
        for shard, once, more in partition_sketch(cell, width):
            yield _sent(shard, 0, once, more)
        group = np.cumsum(_group_starts(cell)) - 1
        many = np.bincount(group)[group] > 1 if len(cell) else np.zeros(0, bool)
        if many.any():  # two texts of this task: no need to ask
            yield from _settled(cls[many], cell[many], shards)
        cell, cls = cell[~many], cls[~many]
        cut = np.searchsorted(cell >> U(32), np.arange(shards + 1).astype(U))
        for s in np.flatnonzero(np.diff(cut)):
            at = slice(cut[s], cut[s + 1])
            yield _sent(int(s), 1, cell[at].astype(np.uint32), cls[at])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, counters = None, np.zeros(2 * width, np.uint8)
        for s, kind, a, b in _rows(batches):
            if s < 0:
                yield _pairs(np.frombuffer(a, U), np.frombuffer(b, U))
                continue
            if s != shard:
                shard = s
                counters[:] = 0
            place = np.frombuffer(a, np.uint32)
            if kind == 0:
                merge_sketch(counters, place, np.frombuffer(b, np.uint32))
            else:
                hot = estimates(counters, place) > 1
                yield _pairs(np.frombuffer(b, U)[hot], place[hot].astype(U) | U(s << 32))

    sent = texts.mapInArrow(lambda it: _flushed(it, read, settle, flush), _SENT).drop("c", "d")
    return sent.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "class long, key long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _settled(cls: np.ndarray, key: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """What a task has settled, in pieces dealt out under negative numbers: it passes through the same shuffle."""
    for i in range(0, len(cls), 50_000):
        yield _sent(-1 - int(mix(cls[i : i + 1] + U(i))[0] % U(shards)), 0, cls[i : i + 50_000], key[i : i + 50_000])


def _merged(sent: DataFrame, merge: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """(class, key): shards merged, settled pieces as they are."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("shard")[0].as_py() >= 0:
            return pa.Table.from_batches([merge(t)])
        cls, key = (np.concatenate([np.frombuffer(x, U) for x in t.column(c).to_pylist()]) for c in "ab")
        return pa.Table.from_batches([_pairs(cls, key)])

    return sent.groupBy("shard").applyInArrow(run, "class long, key long")


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by the first key, then the others, each combination once."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = _group_starts(*keys)
    return tuple(k[first] for k in keys)


def repeated_windows(hot: DataFrame, shards: int, flush: int = FLUSH) -> DataFrame:
    """(class, key): 64-bit hashes of the windows that a smaller doc_id holds too. hot: class, doc_id, text, cells."""

    def read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in chunks(b.column("text")):
            t = _Text(b.column("text").slice(i, j - i), second=True)
            cells = b.column("cells").slice(i, j - i)
            size = np.diff(np.asarray(cells.offsets))
            owner = np.repeat(np.arange(j - i), size)
            # One look-up for the whole chunk: text and cell as one key each.
            mine = mix(_cell(t.anchor, shards) + mix(t.owner))
            keep = np.isin(mine, mix(np.asarray(cells.flatten()).view(U) + mix(owner)))
            if t.more is not None and keep.any():
                own, ids = t.owner[keep], np.asarray(b.column("doc_id").slice(i, j - i))
                yield _distinct(t.window[keep], t.more[keep], ids[own], t.classes[own])

    def later(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of entries sorted by window and document, those with a smaller document."""
        first = _group_starts(w1, w2)
        return doc > doc[first][np.cumsum(first) - 1]

    def settle(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, cls = _distinct(w1, w2, doc, cls)
        drop = later(w1, w2, doc)
        if drop.any():
            yield from _settled(cls[drop], w1[drop], shards)
        w1, w2, doc, cls = (x[~drop] for x in (w1, w2, doc, cls))
        shard = (w1 % U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            at = order[cut[s] : cut[s + 1]]
            yield _sent(int(s), 0, w1[at], w2[at], doc[at], cls[at])

    def merge(t: pa.Table) -> pa.RecordBatch:
        w1, w2, doc, cls = (
            np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in zip("abcd", (U, np.uint32, np.int64, U), strict=True)
        )
        w1, w2, doc, cls = _distinct(w1, w2, doc, cls)
        drop = later(w1, w2, doc)
        return _pairs(cls[drop], w1[drop])

    return _merged(hot.mapInArrow(lambda it: _flushed(it, read, settle, flush), _SENT), merge)


def cut_texts(hot: DataFrame, dropped: DataFrame) -> DataFrame:
    """(class, n_removed, kept_sha256, kept): texts without the words of dropped windows. dropped: class, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b.column("text")):
                t = _Text(b.column("text").slice(i, j - i))
                keys = b.column("keys").slice(i, j - i)
                out = []
                for k in range(j - i):
                    lo, hi = np.searchsorted(t.owner, [k, k + 1])
                    first, last = t.words.bounds[k], t.words.bounds[k + 1]
                    starts = t.inside[lo:hi][np.isin(t.window[lo:hi], np.asarray(keys[k].values).view(U))] - first
                    step = np.zeros(last - first + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + WINDOW, -1)
                    keep = np.cumsum(step)[:-1] == 0
                    kept = t.words.kept(k, keep)
                    out.append((b.column("class")[i + k].as_py(), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["class", "n_removed", "kept_sha256", "kept"])

    grouped = dropped.groupBy("class").agg(F.collect_set("key").alias("keys"))
    return hot.select("class", "text").join(grouped, "class").mapInArrow(run, "class long, n_removed long, kept_sha256 string, kept string")


def _key(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(cls.view(U) + mix(doc.view(U)))


def _copy_keys(copies: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(np.asarray(b.column(0)), np.asarray(b.column(1))).view(np.int64))], ["key"])

    return copies.select("class", "doc_id").mapInArrow(run, "key long")


def one_of_each(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(class, doc_id, text) of documents that are no later copy of a text. copies: class, doc_id of those that are. What a Bloom filter
    of them rules out stays where it is; the others are compared with the copies themselves."""
    words = bloom(_copy_keys(copies))

    def among(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in chunks(b.column(1)):
                    w = Words(b.column(1).slice(i, j - i))
                    cls = classes(w, w.hashes())
                    part = pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), *b.slice(i, j - i).columns], ["class", "doc_id", "text"])
                    may = in_bloom(words.value, _key(cls, np.asarray(part.column(1))))
                    yield part.filter(pa.array((may == wanted) & (np.diff(w.bounds) >= WINDOW)))

        return docs.mapInArrow(run, "class long, doc_id long, text string")

    return among(False).unionAll(among(True).join(copies, ["class", "doc_id"], "left_anti"))


def _of_classes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose class passes a Bloom filter of the wanted classes."""
    words = bloom(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bloom(words.value, np.asarray(b.column(0)).view(U))))

    return texts.mapInArrow(run, texts.schema)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, width: int | None = None, flush: int = FLUSH) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row; with_text adds ``kept``, null where nothing was removed. width: counters of a shard in a row,
    where they are not to follow from the number of windows."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base = materialise(base_table(docs), "dedup-base")
    first = base.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("doc_id").alias("n"))
    n_windows = base.agg(F.sum(F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))).first()[0] or 0
    shards, fitting = _shape(n_windows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = base.join(first.where("n > 1"), "class").where((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW))
    copies = materialise(copies.select("class", "doc_id").distinct(), "dedup-copies")
    texts = one_of_each(docs.where("doc_id is not null"), copies)
    cells = materialise(repeated_cells(texts, shards, width or fitting, flush).groupBy("class").agg(F.collect_set("key").alias("cells")), "dedup-hot")
    hot = materialise(_of_classes(texts, cells.select("class")).join(cells, "class"), "dedup-texts")
    cut = cut_texts(hot, repeated_windows(hot, shards, flush))
    columns = ["n_removed", "kept_sha256"] + ["kept"] * with_text
    cut = cut.groupBy("class").agg(*[F.first(c).alias(f"_{c}") for c in columns])  # repeated rows are alike
    whole = base.join(first.drop("n").join(cut, "class", "left"), "class")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    own = F.col("doc_id").isNotNull()
    out = [
        F.col("doc_id").alias(key),
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("_n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.coalesce("_kept_sha256", "kept_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(copy, F.lit("")).when(own, F.col("_kept")).alias("kept"))
    return whole.select(*out)
