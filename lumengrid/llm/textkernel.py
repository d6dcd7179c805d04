"""Vectorised word and n-gram hashing over Arrow string batches.

A batch of documents is one byte buffer with offsets.  Words are maximal runs
of "word bytes"; every class used here is a set of ASCII bytes or all bytes
from 0x80, so splitting bytes is the same as splitting code points.

A word's hash takes its bytes eight at a time through a bijective mixer, so it
is not linear in them and patterns in a text give no collisions; words of up to
eight bytes and one length never collide.  N-gram and sequence hashes mix at
every step too.  Buffers are cut at document borders into slices of about
``SLICE`` bytes, so memory follows the slice (or the longest single document),
never the Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
#: The low bytes of a chunk that belong to a word, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Bytes hashed with array operations; the rest of a longer word goes through BLAKE2.
_CHUNKED = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: 0-9, letters after lower-casing, and every byte of a character beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tidy(task):
    """A task over batches that hands freed memory back when it ends.

    Python workers live on between tasks; what the allocators keep would count
    against the next task's and the JVM's share of the executor.
    """
    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not large and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, large = column.cast(pa.large_string()), True
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``most`` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunk_view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as little-endian numbers; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    size = end - start
    chunks = chunk_view(data)
    with np.errstate(over="ignore"):
        h = mix(size.astype(_U) * _A)
        h = mix(h ^ (chunks[start] & _LOW[np.minimum(size, 8)]))
        some = np.flatnonzero(size > 8)
        for k in range(8, _CHUNKED, 8):
            if not len(some):
                break
            h[some] = mix(h[some] ^ (chunks[start[some] + k] & _LOW[np.minimum(size[some] - k, 8)]))
            some = some[size[some] > k + 8]
    if len(some):
        raw = memoryview(np.ascontiguousarray(data))
        rest = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip((start[some] + _CHUNKED).tolist(), end[some].tolist())]
        h[some] = mix(h[some] ^ np.array(rest, _U))
    return h


@dataclass
class Words:
    """Words of some documents: byte ranges, first word of each document, and hashes when asked for."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word index at which each document begins; one more at the end

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offs: np.ndarray, keep: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = keep[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = inside[edge]
    finish[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


def _then(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of sequences x and y, one after the other."""
    t = x * _A
    t ^= t >> _U(32)
    t += y
    t *= _B
    return t


def ngram_hashes(words: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; 0 where the document has fewer.

    A real hash is never 0.  Hashes of 1, 2, 4, ... words are put together.
    """
    out = np.zeros(len(words.start), _U)
    m = len(words.start) - n + 1
    if m <= 0:
        return out
    with np.errstate(over="ignore"):
        levels, k = [words.hash], 1
        while 2 * k <= n:
            levels.append(_then(levels[-1][:-k], levels[-1][k:]))
            k *= 2
        acc, done = levels[-1][:m], k
        for level in reversed(levels[:-1]):
            k //= 2
            if n & k:
                acc = _then(acc, level[done : done + m])
                done += k
        acc = mix(acc + _U(n))
    acc[acc == 0] = 1
    out[:m] = acc
    for j in range(1, n):  # the last n - 1 words of each document begin no window
        at = words.first[1:] - j
        out[at[at >= words.first[:-1]]] = 0
    return out


def window_checks(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """A second hash of the n words from each of some words on, independent of the first."""
    with np.errstate(over="ignore"):
        acc = np.full(len(at), n, _U)
        for j in range(n):
            acc = (acc ^ (acc >> _U(29))) * _B + words.hash[at + j]
        return mix(acc)


def sequence_hash(words: Words) -> np.ndarray:
    """One hash for the whole word sequence of each document: words mixed with their places, summed."""
    a, b = words.first[:-1], words.first[1:]
    place = np.arange(len(words.start)) - np.repeat(a, b - a)
    with np.errstate(over="ignore"):
        total = np.zeros(len(place) + 1, _U)
        np.cumsum(mix(words.hash ^ (place.astype(_U) * _A)), out=total[1:])
        return mix((total[b] - total[a]) * _A + (b - a).astype(_U))
