"""Whole batches of texts as NumPy arrays of code points, for the legs that look into texts: words, bigrams, trigrams, and word similarity.

Nothing here makes a Python object for a word or a gram. Texts are worked through in slices of a bounded number of characters; a longer text is a slice of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHARS = 1 << 18
_CODE = np.uint64(21)  # bits of a code point


def slices(texts: pa.Array, chars: int = CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, consecutive texts of about so many bytes)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins: one entry more than texts); null counts as empty."""
    texts = [t or "" for t in texts]
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=begin[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), begin


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def words(cps: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every run of letters and digits; runs end where a text does."""
    inside = np.zeros(len(cps) + 2, dtype=bool)
    inside[1:-1] = _in_words()[cps]
    edge = np.zeros(len(cps) + 1, dtype=bool)
    edge[begin] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    return first, np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1


_factors = np.zeros(0, dtype=np.uint64)


def _places(n: int) -> np.ndarray:
    """A random factor for each place in a word."""
    global _factors
    if len(_factors) < n:
        _factors = np.random.default_rng(20).integers(0, 1 << 63, max(n, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _factors


def vocabulary(cps: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(distinct words, the index of each word among them). Words are found by a hash and compared letter by letter."""
    n = end - first
    if not len(n):
        return [], np.zeros(0, dtype=np.int64)
    begun = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(begun, n)
    letters = cps[np.repeat(first, n) + at]
    hashes = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _places(int(n.max()))[at], begun)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = one[which]
    if (n[same] != n).any() or (letters[np.repeat(begun[same], n) + at] != letters).any():  # two words of one hash
        spelt = [letters[b : b + k].tobytes().decode("utf-32-le", "surrogatepass") for b, k in zip(begun.tolist(), n.tolist())]
        known: dict[str, int] = {}
        index = np.array([known.setdefault(w, len(known)) for w in spelt])
        return list(known), index
    return [cps[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(first[one].tolist(), end[one].tolist())], which


def bigram_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every pair of neighbouring characters of texts padded by a blank on both sides, the text of each)."""
    cps, begin = codes([None if t is None else f" {t} " for t in texts])
    pair = (cps[:-1].astype(np.uint64) << _CODE) | cps[1:]
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    inside = text[:-1] == text[1:]
    return pair[inside], text[:-1][inside]


def trigram_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every trigram in order, the text of each): words in lower case, padded by two blanks before and one behind."""
    cps, begin = codes([None if t is None else t.lower() for t in texts])
    first, end = words(cps, begin)
    n = end - first
    to = np.cumsum(n + 3)  # where a word's padded letters end
    padded = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint64)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[np.repeat(to - 1 - n, n) + at] = cps[np.repeat(first, n) + at]
    if not len(padded):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    gram = (padded[:-2] << (_CODE + _CODE)) | (padded[1:-1] << _CODE) | padded[2:]
    own = np.ones(len(gram), dtype=bool)
    for k in (2, 1):  # those that reach into the next word
        own[(to[:-1] - k)] = False
    text = np.searchsorted(begin, first, side="right") - 1
    return gram[own], np.repeat(text, n + 1)


def members(gram: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places at which a gram is one of the sorted known ones, which one)."""
    if not len(known):
        return (np.zeros(0, dtype=np.int64),) * 2
    gate = np.zeros(1 << 16, dtype=bool)
    fold = lambda x: ((x ^ (x >> np.uint64(13)) ^ (x >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.int64)
    gate[fold(known)] = True
    at = np.flatnonzero(gate[fold(gram)])
    k = np.minimum(np.searchsorted(known, gram[at]), len(known) - 1)
    ok = known[k] == gram[at]
    return at[ok], k[ok]


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each dimension, straight from the Arrow buffer; rows that are null or have a null in them are left out."""
    size = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        flat = vectors.take(pa.array(rows)).flatten()
        x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), dim)
        if flat.null_count:
            ok = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), dim).any(axis=1)
            rows, x = rows[ok], x[ok]
        yield rows, x


class Best:
    """The best k of each query by falling score and rising id, out of rows that come in parts; all of them if k is None."""

    def __init__(self, k: int | None) -> None:
        self.k, self.parts, self.held = k, [], 0
        self.floor: dict[int, float] = {}  # the score that a query's next row must reach

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, score))
            self.held += len(query)
            if self.k is not None and self.held > 1 << 16:
                self._prune()

    def _prune(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        keep = rank < self.k
        last = np.flatnonzero(rank == self.k - 1)
        self.floor.update(zip(query[last].tolist(), score[last].tolist()))
        self.parts = [(query[keep], ids[keep], score[keep])]
        self.held = int(keep.sum())

    def least(self, query: int) -> float:
        return self.floor.get(query, -np.inf)

    def refresh(self) -> None:
        if self.k is not None and self.parts:
            self._prune()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        self.refresh()
        return tuple(np.concatenate(x) for x in zip(*self.parts))


def _before(gram: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where each gram stood last before in its text; -1 if it didn't."""
    _, number = np.unique(gram, return_inverse=True)
    key = text * (int(number.max()) + 1) + number
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    out = np.full(len(gram), -1, dtype=np.int64)
    out[order[1:][again]] = order[:-1][again]
    return out


class Grams:
    """The trigrams of a slice of texts, ready to be compared with queries."""

    REACH = 256

    def __init__(self, texts: Sequence[str | None]) -> None:
        self.gram, self.text = trigram_codes(texts)
        self.n, size = len(texts), len(self.gram)
        before = _before(self.gram, self.text) if size else np.zeros(0, dtype=np.int64)
        again = np.flatnonzero(before >= 0)
        # a stretch that goes on to where its first gram stands again is no better than one that begins after it
        self.end = np.searchsorted(self.text, np.arange(self.n), side="right")[self.text] if size else before
        self.end[before[again]] = again
        near = np.zeros(size, dtype=bool)
        near[again] = again - before[again] < self.REACH
        self.repeats = np.append(0, np.cumsum(near)).astype(np.int32)
        self.before = before.astype(np.int32)

    def _windows(self, of: np.ndarray, width: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.append(of, np.zeros(width, dtype=of.dtype)), width)

    def similarity(self, query: int, hits: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, their word similarity): the largest c / (query + stretch - c) of all stretches of a text's trigrams, c of which are the query's, counted without repeats.
        hits: where the query's trigrams stand. Texts below their ``least`` may be left out.

        A first pass bounds what a stretch from each hit can reach, taking hits for distinct and every repeat within reach for one; a second one computes those
        stretches that can still be the best of their text."""
        n, m = query, len(hits)
        text, end = self.text[hits], self.end[hits]
        bound = np.zeros(m, dtype=np.float32)
        # from each hit, no stretch beyond REACH has fewer distinct grams than this
        far = np.minimum(hits + self.REACH, end)
        most = (far - hits).astype(np.int32) - (self.repeats[far] - self.repeats[hits])
        place = hits + 1
        upto, since = (place - self.repeats[place]).astype(np.int32), (hits - self.repeats[hits]).astype(np.int32)
        for r in range(1, min(n, m) + 1):
            k = m - r + 1
            to = place[r - 1 :]
            stretch = np.minimum(upto[r - 1 :] - since[:k], most[:k])
            value = np.float32(r) / np.maximum(n, n + stretch - r).astype(np.float32)
            value[to > end[:k]] = 0
            np.maximum(bound[:k], value, out=bound[:k])
        best = np.maximum(least, 1e-12)
        live = np.flatnonzero(bound >= best[text] - 1e-6)
        live = live[np.argsort(-bound[live], kind="stable")]
        found = np.zeros(self.n)
        is_hit = np.zeros(len(self.gram), dtype=bool)
        is_hit[hits] = True
        step = 64
        while len(live):
            own, live = live[:step], live[step:]
            step = min(2048, step * 2)
            start, width = hits[own], 32
            while len(start):
                left = self.end[start] - start
                new = (self._windows(self.before, width)[start] < start[:, None].astype(np.int32)) & (np.arange(width, dtype=np.int32) < left[:, None])
                seen = new.cumsum(axis=1, dtype=np.int32)
                both = (new & self._windows(is_hit, width)[start]).cumsum(axis=1, dtype=np.int32)
                at = np.divide(both, seen - both + n, dtype=np.float32).argmax(axis=1)[:, None]
                c, e = np.take_along_axis(both, at, 1)[:, 0], np.take_along_axis(seen, at, 1)[:, 0]
                value, t = c / (n + e - c), self.text[start]
                np.maximum.at(found, t, value)
                np.maximum.at(best, t, value)
                # no longer stretch can be better once all of the query in it would not be
                start = start[(width < left) & (seen[:, -1] * best[t] < n)]
                width *= 2
            live = live[bound[live] > best[text[live]] - 1e-6]
        rows = np.flatnonzero(found > 0)
        return rows, found[rows]
