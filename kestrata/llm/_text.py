"""Vectorised text primitives over Arrow string buffers.

Operators that read every byte of the corpus work on the raw UTF-8 buffer of
an Arrow batch: words, hashes and shingles of a few hundred documents are found
with a handful of numpy passes, and no Python string is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _return_large_arrays() -> None:
    """Have glibc map arrays of 4 MB or more on their own, so that a worker gives their memory back when they go.

    Left alone, it raises that bound to 32 MB after the first one and keeps what is freed in its heap.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_return_large_arrays()


def trim() -> None:
    """Give freed memory back, at the end of a task that held much."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(work: Callable) -> Callable:
    """``work`` on a task's batches; the worker, which waits for further tasks, then gives back what it freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


CHUNK_BYTES = 1 << 18  # of text at once; every byte takes some hundred bytes of arrays meanwhile

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# words of [0-9a-z] and bytes of non-ASCII characters, after lower-casing A-Z
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[48:58] = False
_NOT_ALNUM[97:123] = False
_NOT_ALNUM[128:] = False


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective); wraps silently."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE = fmix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_R = 0xD6E8FEB86659FD93
_R_INV = pow(_R, -1, 1 << 64)
_powers = {_R: np.ones(1, np.uint64), _R_INV: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n mod 2**64, kept per process and doubled on demand."""
    p = _powers[base]
    while len(p) <= n:
        p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
        _powers[base] = p
    return p


@dataclass
class Chunk:
    """Neighbouring documents: ``buf`` their bytes, document d is buf[at[d]:at[d+1]]."""

    first: int
    buf: np.ndarray
    at: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.at) - 1

    def prefix_hash(self, lower: bool) -> np.ndarray:
        h = np.empty(len(self.buf) + 1, np.uint64)
        h[0] = 0
        v = (_BYTE_LOWER if lower else _BYTE)[self.buf]
        v *= powers(_R, len(v))[: len(v)]
        np.cumsum(v, out=h[1:])
        return h


def hash_ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] from a prefix hash; equal bytes give equal hashes."""
    v = h[end] - h[start]
    v *= powers(_R_INV, len(h))[start]
    v += (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15)
    return fmix(v)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into runs of whole documents of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(i, whole[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def spans(c: Chunk, white: np.ndarray = _WHITE, lower_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a chunk, and for each document the index of its first word (docs + 1 entries)."""
    b = c.buf
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(c.docs + 1, np.int64)
    w = white[_LOWER[b]] if lower_first else white[b]
    word = ~w
    s, e = word.copy(), word.copy()
    s[1:] &= w[:-1]
    e[:-1] &= w[1:]
    filled = c.at[:-1] < c.at[1:]
    firsts, lasts = c.at[:-1][filled], c.at[1:][filled] - 1
    s[firsts] = word[firsts]
    e[lasts] = word[lasts]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, c.at)


def words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, A-Z lower-cased, and each document's first word."""
    s, e, first = spans(c)
    return hash_ranges(c.prefix_hash(True), s, e), first


def alnum_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(c, _NOT_ALNUM, True)


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, as one array and the offsets of the documents."""
    return shingles_of(*words(c), k)


def shingles_of(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text h[first[d]:first[d+1]] of word hashes.

    A text of 1 to k-1 words has its whole sequence as only shingle; one without words has none.
    """
    n = np.diff(first)
    if not len(h):
        return h, np.zeros(len(n) + 1, np.int64)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        rolled[: len(h) - j] += h[j:] * U64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
    rolled = fmix(rolled)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(at[-1]) - at[doc] + first[doc]
    v = rolled[pos]
    for d in np.flatnonzero((n > 0) & (n < k)):  # the whole short sequence, marked by its length
        x = sum(int(h[first[d] + j]) * pow(0x9FB21C651E98DF25, j + 1, 1 << 64) for j in range(n[d])) + int(n[d]) * 0x632BE59BD9B4E019
        v[at[d]] = fmix(np.array([x % (1 << 64)], np.uint64))[0]
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v[i:j].sort()
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[at[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return v[new], kept[at]


class Seen:
    """Which 64-bit names a task meets for the first time; forgets all of them beyond ``most``."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.names, self.held = most, np.zeros(0, np.uint64), []

    def first(self, names: np.ndarray) -> np.ndarray:
        """Indexes of the names not seen before, one of each."""
        names, at = np.unique(names, return_index=True)
        new = np.ones(len(names), bool)
        for known in (self.names, *self.held):
            if len(known):
                new &= known[np.minimum(np.searchsorted(known, names), len(known) - 1)] != names
        self.held.append(names[new])
        if len(self.held) == 16:
            self.names, self.held = np.unique(np.concatenate([self.names, *self.held])), []
            if len(self.names) > self.most:
                self.names = self.names[:0]
        return at[new]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return x.view(np.int64)
