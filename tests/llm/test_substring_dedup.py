import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbisplit.llm import kernels as k
from orbisplit.llm import substring_dedup as d


def split(text):
    return (text or "").encode().split()


def brute(rows):
    """rows: (doc_id, text) -> per row n_words, n_removed, digest of the kept words."""
    low = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - 12) if doc is not None else ():
            x = tuple(w[i : i + 13])
            low[x] = min(low.get(x, doc), doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - 12) if doc is not None else ():
            if low[tuple(w[i : i + 13])] < doc:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string").repartition(3)
    got = [tuple(r) for r in d.dedup(df, **more).collect()]
    assert sorted(got, key=str) == brute(rows)


def fixture(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("the of and to ü ñ x y z".split()) + str(r.randrange(40)) for _ in range(n)) for n in (12, 13, 14, 30, 60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, passages[4]), (None, None), (50, "A " * 12), (51, "A " * 12), (52, "a " * 40), (53, "a " * 14)]
    for i in range(100, 160):
        parts = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(25))) for _ in range(3)]
        parts[1:1] = r.sample(passages, r.randrange(3))
        rows.append((i, r.choice([" ", "\n", "  ", "\x0b"]).join(parts)))
    rows += [(200, rows[12][1]), (90, rows[15][1]), (90, rows[15][1]), (100, rows[20][1]), (300, " ".join(f"q{i % 700}" for i in range(9000)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, fixture(seed))


def test_small_flushes_change_nothing(spark):
    check(spark, fixture(3), flush=50)


def test_tiny_sketch_changes_nothing(spark):
    """With few counters all estimates are too high: more is looked at, the result is the same."""
    check(spark, fixture(4), width=16)


def test_shape_of_the_sketch():
    for n in (0, 10**4, 10**8, 10**10, 10**13):
        for partitions in (4, 211, 10**5):
            shards, width = d._shape(n, partitions)
            assert shards * width * 3 >= n * d.SPARE - 3 and d.LEAST_CELLS <= width <= d.CELLS and width & (width - 1) == 0
            assert shards == 8 * partitions or width == d.CELLS


def test_estimates_are_never_too_low():
    r = np.random.default_rng(6)
    for cells in (64, 1 << 12):
        parts = [np.unique(r.integers(0, 3000, 700).astype(np.uint64)) for _ in range(6)]
        truth = np.bincount(np.concatenate(parts).astype(int), minlength=3000)
        counters = np.zeros(2 * cells, np.uint8)
        for shard, once, more in (x for p in parts for x in d.partition_sketch(p, cells)):
            assert shard == 0
            d.merge_sketch(counters, once, more)
        assert (d.estimates(counters, np.arange(3000).astype(np.uint64)) >= np.minimum(truth, 2)).all()
    high = np.mean(d.estimates(counters, np.arange(3000).astype(np.uint64))[truth < 2] > 1)
    assert high < 0.5


def test_empty_table_and_kept_text(spark):
    rows = [(1, "p " + " ".join(map(str, range(20)))), (2, "own words " + " ".join(map(str, range(20))) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.kept for r in d.dedup(df, with_text=True).orderBy("doc_id").collect()] == [None, "own words end"]
    assert d.dedup(df.where(F.lit(False))).count() == 0


def test_word_kernel_equals_split():
    texts = ["", None, "a", " a b ", "\x85é x y\tz\x0b\x0c\r\n", "end ", " start", "x" * 10]
    w = k.Words(pa.array(["skipped", *texts])[1:])
    found = [[bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert found == [split(t) for t in texts]
    h = w.hashes()
    words = [x for f in found for x in f]
    assert len(set(h.tolist())) == len(set(words)) and len(k.Words(pa.array([], pa.string())).hashes()) == 0
    upper = k.Words(pa.array(["Ab É"])).hashes(lower=True)
    assert (upper == k.Words(pa.array(["aB É"])).hashes(lower=True)).all()
    a = k.windows(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert a[0] == a[3] and len(set(a.tolist())) == 3


def test_chunks_cover_every_text():
    texts = pa.array(["a" * 10] * 7 + [None] + ["b" * 100])
    assert list(k.chunks(texts, 25)) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9)]
    assert list(k.chunks(pa.array([], pa.string()))) == []
