"""Words, word hashes and shingles of whole Arrow text columns, without a Python step per word.

A word is a run of bytes other than space and \\x09-\\x0D.  A word hash is a polynomial over its bytes modulo
2**64, mixed afterwards; it depends on the bytes alone, so every task and run gives the same hash.
Null and empty texts have no words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLAB = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    out = np.full(SLAB + 1, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        _POWERS[base] = _powers(base)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the n + 1 offsets of the texts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    where = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def word_spans(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(where), np.int64)
    solid = ~WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[where] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, where)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=U)
    up, down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
    at = 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(ends, low + SLAB, "right"))
        if to <= at:  # one span longer than a slab
            value, part = 0, data[low : ends[at]]
            for k in range(0, len(part), SLAB):
                piece = part[k : k + SLAB]
                value = (value + int((up[: len(piece)] * (piece.astype(U) + U(1))).sum(dtype=U)) * pow(BASE, k, 1 << 64)) & MASK
            out[at] = value
            at += 1
            continue
        slab = data[low : ends[to - 1]]
        sums = np.zeros(len(slab) + 1, dtype=U)
        np.cumsum((slab.astype(U) + U(1)) * up[: len(slab)], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mix(out)


class Words:
    """The words of a text column: ``hashes``, byte spans and ``offsets`` (words of text i: offsets[i]:offsets[i+1])."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.where = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.starts, self.ends, self.offsets = word_spans(self.data, self.where)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.where) - 1


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=U)
    span = min(size, n)
    total = np.full(n - span + 1, U(span), dtype=U)
    for k in range(span):
        total = total * U(BASE | 1) + hashes[k : n - span + 1 + k]
        total = total ^ (total >> U(29))
    return mix(total)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; after the last one, memory that the task has done with goes back to the machine: workers wait for
    later tasks, which may be of another step, and the JVM beside them needs the room."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slabs(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes of text, or a single longer text."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        _, where = text_bytes(batch.column(place))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(where, where[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
