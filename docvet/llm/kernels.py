"""Vectorised work on the bytes of many texts: words, hashes, hashed shingles. All integers wrap at 64 bits."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; bounds the memory of the vectorised steps.
CHUNK = 1 << 18
#: Rows of a batch that are worked on at once.
BATCH_ROWS = 1000
#: Batches between two calls of trim().
TRIM_BATCHES = 4

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = np.uint64(pow(int(base), done, 1 << 64))
        m = min(done, n - done)
        out[done : done + m] = out[:m] * step
        done += m
    return out


_POW = _powers(_P, CHUNK + 65)
_POW_INV = _powers(_P_INV, CHUNK + 65)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives memory that is free again back to the system: Python workers go on to other tasks, beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run, a function for mapInArrow, with batches of at most BATCH_ROWS rows; trim() now and then and at the end of a task."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), BATCH_ROWS):
                yield batch.slice(i, BATCH_ROWS)
                done += 1
                if done % TRIM_BATCHES == 0:
                    trim()

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            trim()

    return outer


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets at which the texts begin and end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most CHUNK bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Prefix:
    """Hashes of any byte ranges of a buffer of at most CHUNK + 64 bytes, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _POW[: len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """of() for all ranges of n bytes."""
        return mix((self.sums[n:] - self.sums[:-n]) * _POW_INV[: len(self.sums) - n] + np.uint64(n))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _POW_INV[start] + (end - start).astype(np.uint64))


def cut_at_spaces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text of at most CHUNK bytes, cut behind white space; a longer word is passed whole in parts of CHUNK bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            spaces = np.flatnonzero(SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
        yield data[at:end]
        at = end


def words(data: np.ndarray, edges: np.ndarray | None = None, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't apart (ASCII white space); none crosses the edges between texts."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(apart[data], out=inside[1:-1].view(bool))
    steps = np.diff(inside)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if edges is not None and len(edges) and len(start):
        edge = np.unique(edges)
        k = np.searchsorted(start, edge, side="left") - 1
        edge = edge[(k >= 0) & (end[np.maximum(k, 0)] > edge)]
        start, end = np.sort(np.concatenate([start, edge])), np.sort(np.concatenate([end, edge]))
    return start, end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, byte by byte."""
    return _LOWER[data]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of the words of one text of any length; a word over CHUNK bytes is hashed by its parts."""
    if len(data) <= CHUNK:
        start, end = words(data)
        return Prefix(data).of(start, end)
    out: list[np.ndarray] = []
    carry = None  # of a word that goes on in the next part
    for part in cut_at_spaces(data):
        start, end = words(part)
        h = Prefix(part).of(start, end)
        if carry is not None:
            if len(start) and start[0] == 0:
                h[:1] = mix(carry * np.uint64(3) + h[:1])
            else:
                out.append(carry)
        carry = None
        if len(end) and end[-1] == len(part):
            carry, h = h[-1:], h[:-1]
        out.append(h)
    if carry is not None:
        out.append(carry)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_words(column: pa.Array, low: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (i, j, hashes, bounds) for runs of texts: the hashes of the words of text i + k are hashes[bounds[k]:bounds[k + 1]]."""
    data, offsets = texts_of(column)
    for i, j in spans_of(offsets):
        part = data[offsets[i] : offsets[j]]
        part = lower(part) if low else part
        if j - i == 1 and len(part) > CHUNK:
            h = word_hashes(part)
            yield i, j, h, np.array([0, len(h)])
            continue
        edges = (offsets[i + 1 : j] - offsets[i]).astype(np.int64)
        start, end = words(part, edges)
        h = Prefix(part).of(start, end)
        bounds = np.concatenate([[0], np.searchsorted(start, edges, side="left"), [len(start)]])
        yield i, j, h, bounds


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of all runs of n words, sorted; with fewer words, of the whole sequence; of none, none."""
    if not len(h):
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - m + 1 + k])
    return np.unique(out)
