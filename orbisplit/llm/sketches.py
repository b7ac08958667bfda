"""Sketches of fixed size that are filled by partitions, merged by part, and then handed to every task.

A task adds up its own rows and sends only the parts that are not empty; parts are merged where they hash to, in a
stream, so no task holds more than its share of the sketch. The merged sketch has ``size`` counters, a bound that
does not depend on the data: that bound is what makes it fit to be collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from orbisplit.llm.kernels import PART, U, merge_parts, mix, sparse_parts

PARTS = "part int, cells binary, counts binary"
#: 32-bit words of a Bloom filter: 4 MB.
BLOOM_WORDS = 1 << 20
BLOOM_HASHES = 4


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)


def _batch(part: int, cells: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([cells], pa.binary()), pa.array([counts], pa.binary())], ["part", "cells", "counts"]
    )


def build(
    rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int, union: bool = False
) -> np.ndarray:
    """The merged counters. add(counters, batch) adds a batch of rows to the counters of its task."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint32)
        for b in batches:
            add(counters, b)
        for row in sparse_parts(counters):
            yield _batch(*row)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in merge_parts(_rows(batches), union).items():
            full = np.flatnonzero(counts)
            yield _batch(part, full.astype(np.uint16).tobytes(), np.minimum(counts[full], 0xFFFFFFFF).astype(np.uint32).tobytes())

    merged = rows.mapInArrow(fill, PARTS).repartition("part").mapInArrow(merge, PARTS)
    out = np.zeros(size, np.uint32)
    for part, cells, counts in merged.collect():  # the size of the sketch at most
        out[part * PART + np.frombuffer(cells, np.uint16).astype(np.int64)] = np.frombuffer(counts, np.uint32)
    return out


def _bits(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(BLOOM_HASHES):
        at = mix(keys.astype(U) + U(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) & U(BLOOM_WORDS * 32 - 1)
        yield (at >> U(5)).astype(np.int64), np.left_shift(np.uint32(1), (at & U(31)).astype(np.uint32))


def bloom(keys: DataFrame) -> Broadcast:
    """A Bloom filter of a long column, of fixed size: it may let others through, it never loses a key."""

    def add(words: np.ndarray, b: pa.RecordBatch) -> None:
        for at, bit in _bits(np.asarray(b.column(0).drop_null()).view(U)):
            np.bitwise_or.at(words, at, bit)

    return share(keys.sparkSession, build(keys, add, BLOOM_WORDS, union=True))


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at, bit in _bits(keys):
        found &= (words[at] & bit) != 0
    return found


def share(spark: SparkSession, counters: np.ndarray) -> Broadcast:
    return spark.sparkContext.broadcast(counters)


def count_min_add(counters: np.ndarray, keys: np.ndarray) -> None:
    """One more of each key, in both rows of a count-min sketch."""
    half = len(counters) // 2
    for row, at in enumerate(_cells(keys, half)):
        found, n = np.unique(at, return_counts=True)
        counters[row * half + found] += n.astype(np.uint32)


def count_min_read(counters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts that are never too small."""
    half = len(counters) // 2
    a, b = _cells(keys, half)
    return np.minimum(counters[a], counters[half + b])


def _cells(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & U(width - 1)).astype(np.int64), ((keys >> U(32)) & U(width - 1)).astype(np.int64)
