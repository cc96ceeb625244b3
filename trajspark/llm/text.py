"""Words, lines and hashes of many texts at once, as NumPy arrays over the bytes of an Arrow batch.

A word is a run of bytes other than the six ASCII white space characters. UTF-8 keeps those bytes out of longer
characters, so working on bytes gives the same words as working on characters. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text worked on at a time; a longer text is a chunk of its own


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


mixed = _mixed
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
EXACT = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = EXACT.copy()
LOWER[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0x9E3779B97F4A7C15)
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0 .. n - 1, modulo 2**64; kept in the worker up to the usual chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Gives memory that a finished task no longer uses back to the machine: Spark keeps its Python workers for later tasks.

    Task functions and what they refer to come with each task anew and hold each other, so they are collected here.
    """
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of about ``limit`` bytes of text, so that a task's memory does not follow the batch size."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.cumsum(length) // limit
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield batch.slice(a, b - a)
    finally:
        release()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Texts:
    """The bytes of a column of texts and where each begins."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        raw = column.buffers()
        n = len(column)
        offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if raw[1] and n else np.zeros(n + 1, np.int64)
        self.bytes = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = n

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def first(self) -> np.ndarray:
        """Marks the bytes at which a text begins, and one past the last."""
        mark = np.zeros(len(self.bytes) + 1, bool)
        mark[self.offsets] = True
        return mark

    def prefix(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(table[self.bytes] * powers(BASE, len(self.bytes)), out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal ranges have equal hashes."""
        total = self.prefix(table)
        return _mixed((total[end] - total[start]) * powers(INVERSE, len(self.bytes) + 1)[start] + (end - start).astype(np.uint64))

    def keys(self, start: np.ndarray, end: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
        """64-bit hashes of byte ranges that follow each other without overlap and are not empty.

        Every byte is mixed with its place before the sum, so no pattern of bytes cancels out as in a polynomial modulo 2**64.
        """
        if not len(start):
            return np.zeros(0, np.uint64)
        size = end - start
        begin = np.cumsum(size) - size
        place = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)
        letter = _mixed(table[self.bytes[place + np.repeat(start, size)]] ^ (place.astype(np.uint64) * STEP))
        return _mixed(np.add.reduceat(letter, begin) + size.astype(np.uint64))


class Words(Texts):
    """Where the words are (``start``, ``end``), whose they are (``owner``), and how many each text has (``counts``)."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        first, dark = self.first(), ~WHITE[self.bytes]
        before = np.concatenate(([False], dark[:-1])) if len(dark) else dark
        after = np.concatenate((dark[1:], [False])) if len(dark) else dark
        self.start = np.flatnonzero(dark & (~before | first[:-1]))
        self.end = np.flatnonzero(dark & (~after | first[1:])) + 1
        self.begin = np.searchsorted(self.start, self.offsets)  # first word of each text, and one past the last
        self.counts = np.diff(self.begin)
        self.owner = np.repeat(np.arange(self.n), self.counts)

    def word_hashes(self, table: np.ndarray = EXACT) -> np.ndarray:
        return self.hashes(self.start, self.end, table)

    def word_keys(self, table: np.ndarray = EXACT) -> np.ndarray:
        return self.keys(self.start, self.end, table)

    def windows(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words that stays within one text."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(BASE) + h[k : k + n]
        at = np.flatnonzero(self.owner[:n] == self.owner[size - 1 :])
        return at, _mixed(out[at])
