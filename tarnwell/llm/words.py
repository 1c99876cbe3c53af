"""Vectorised word streams over Arrow string batches.

A word is a maximal run of letters, marks and digits (Unicode L, M, N), lower-cased one code point at a
time. Words are represented by 64-bit multilinear hashes computed for a whole batch with a handful of NumPy
passes, so no Python object is made per word: each place in a word has a random factor of its own. (With powers of one number
as factors, texts of the Thue-Morse sequence would collide, whatever the number.)
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TOP = 0x20000
SLICE_CHARS = 1 << 18


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(_TOP, dtype=bool)
    low = np.arange(_TOP, dtype=np.uint32)
    for c in range(_TOP):
        s = chr(c)
        if unicodedata.category(s)[0] in "LMN":
            word[c] = True
            t = s.lower()
            if len(t) == 1 and ord(t) < _TOP:
                low[c] = ord(t)
    return word, low


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: it looks after itself
        return None


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches; at its end the worker, which outlives the task, gives the memory back that it has freed."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return inner


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_places = np.zeros(0, dtype=np.uint64)


def places(n: int) -> np.ndarray:
    """A factor for each place from 0 on, n or more of them."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, max(n, SLICE_CHARS + 65536) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _places


def prefix_sums(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of code + 1 times the factor of the place, counted from the last start before; differences within a stretch are hashes of it."""
    n = len(codes)
    begun = np.zeros(n, dtype=np.int64)
    begun[start] = start
    np.maximum.accumulate(begun, out=begun)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * places(n + 1)[np.arange(n) - begun], out=out[1:])
    return out


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one for each word
    start: np.ndarray  # code point at which the word starts, counted over the whole slice
    end: np.ndarray
    first: np.ndarray  # index of each document's first word; one entry more than documents
    text_start: np.ndarray  # code point at which each document starts; one entry more than documents
    prefix: np.ndarray  # prefix sums of the hash, for hashes of words' first letters

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes from a word's start to a place within it."""
        return mix(self.prefix[end] - self.prefix[start])

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(arr: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a string array of about ``chars`` code units (a longer text is a part of its own)."""
    n = len(arr)
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield at, arr.slice(at, to - at)
        at = to


def words(arr: pa.Array) -> Words:
    """Words of every text of a string array; null counts as empty."""
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    text_start = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(pc.utf8_length(arr).to_numpy(zero_copy_only=False), out=text_start[1:])
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    cps = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)
    word, low = _tables()
    total = len(cps)
    if total and int(cps.max()) >= _TOP:
        far = cps >= _TOP
        near = np.where(far, 0, cps)
        is_word, cps = word[near] | far, np.where(far, cps, low[near])
    else:
        is_word, cps = word[cps], low[cps]
    edge = np.zeros(total + 1, dtype=bool)
    edge[text_start] = True
    inside = np.zeros(total + 2, dtype=bool)
    inside[1:-1] = is_word
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])) if total else np.zeros(0, dtype=np.int64)
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 if total else np.zeros(0, dtype=np.int64)
    prefix = prefix_sums(cps, start)
    h = mix(prefix[end] - prefix[start])
    return Words(h, start, end, np.searchsorted(start, text_start), text_start, prefix)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, documents' ends not regarded: len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[j : j + n]
    return mix(g)


def word_hash(w: str) -> int:
    return int(words(pa.array([w])).hash[0])
