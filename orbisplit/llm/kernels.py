"""Vectorised text kernels over Arrow string arrays: words, rolling hashes of word windows, sketches, Bloom filters.

A chunk of texts is one run of bytes. Word bounds come from a table look-up per byte; hashes of words and of windows of
words are differences of prefix sums of a polynomial modulo 2**64, mixed afterwards, so their cost doesn't depend on the
length of a window. Chunks are cut by bytes: memory is a multiple of the chunk, or of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
U = np.uint64
#: Odd, and 3 modulo 4: two neighbours that change places change the hash.
BASE = 0x9E3779B97F4A7C17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


@cache
def _letters(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=U) + U(1 + 1000 * seed))
    if lower:
        table[65:91] = table[97:123]
    return table


@cache
def _inverse() -> int:
    return pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK + 1)
        known = np.full(size, base, U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 2 * CHUNK:
            _POWERS[base] = known
    return known[:n]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair, the same wherever the range lies."""
    n = len(values)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * _powers(BASE, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_inverse(), n + 1)[starts]


class Words:
    """The words of some texts: byte bounds, the texts' bounds among them, and the bytes."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        first = offsets[0] if len(offsets) else 0
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[first : offsets[-1]] if len(offsets) else whole[:0]
        self.offsets = offsets - first
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        space = _space()[self.data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        #: words[bounds[i]:bounds[i + 1]] are those of text i.
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A to Z count as a to z."""
        if not len(self.starts):
            return np.zeros(0, U)
        return mix(_ranges(_letters(seed, lower)[self.data], self.starts, self.ends) + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))

    def kept(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i, or those at true places of keep, joined by single spaces."""
        a, b = self.bounds[i], self.bounds[i + 1]
        raw = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()
        found = raw.split()
        assert len(found) == b - a
        return b" ".join(found if keep is None else [w for w, k in zip(found, keep, strict=True) if k])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many values; windows across texts are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return mix(_ranges(hashes, at, at + size))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about limit bytes, one text at least."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


# Sketches travel as rows (part, cells, counts): part names a run of PART cells; nothing is sent of empty parts.
PART = 1 << 14


def sparse_parts(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows of what is not zero in a dense array of counters."""
    full = np.flatnonzero(counts)
    cut = np.searchsorted(full, np.arange(0, len(counts) + PART, PART))
    for part in np.flatnonzero(np.diff(cut)):
        at = full[cut[part] : cut[part + 1]]
        yield int(part), (at - part * PART).astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()


def merge_parts(rows: Iterator[tuple[int, bytes, bytes]], union: bool = False) -> dict[int, np.ndarray]:
    """Sum (or the bitwise union) of parts; memory is that of the parts, however many rows come."""
    merged: dict[int, np.ndarray] = {}
    for part, cells, counts in rows:
        into = merged.setdefault(part, np.zeros(PART, np.int64))
        at, new = np.frombuffer(cells, np.uint16), np.frombuffer(counts, np.uint32)
        into[at] = into[at] | new if union else into[at] + new
    return merged
