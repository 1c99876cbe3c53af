"""Word similarity of trigrams: how well a query's trigrams match the best stretch of a text's."""

from __future__ import annotations

import numpy as np

from .tsquery import words


def grams(text: str) -> list[str]:
    """Trigrams in order, each word padded by two blanks before and one behind."""
    return [p[i : i + 3] for w in words(text) for p in (f"  {w} ",) for i in range(len(p) - 2)]


def similarity(a: str, b: str) -> float:
    """Shared trigrams among those of either."""
    x, y = set(grams(a)), set(grams(b))
    return len(x & y) / len(x | y) if x or y else 0.0


class Indexed:
    """A text's trigrams as numbers, with the place at which each was last before."""

    def __init__(self, text: list[str]) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.array([self.number.setdefault(g, len(self.number)) for g in text], dtype=np.int32)
        self.before = np.full(len(text), -1, dtype=np.int32)
        order = np.argsort(self.ids, kind="stable")
        again = self.ids[order][1:] == self.ids[order][:-1]
        self.before[order[1:][again]] = order[:-1][again]


def word_similarity(query: set[str], text: list[str] | Indexed, least: float = 0.0) -> float:
    """The largest c / (query + stretch - c) of all continuous stretches of the text's trigrams, c being the trigrams that both have; 0 where it is less than ``least``.

    Stretches are tried from each shared trigram, all of them at once, in windows that double for those starts from which a longer one can still be better."""
    doc = text if isinstance(text, Indexed) else Indexed(text)
    shared = [doc.number[g] for g in query if g in doc.number]
    n, size = len(query), len(doc.ids)
    if not shared or len(shared) < least * n:
        return 0.0
    flag = np.zeros(len(doc.number), dtype=bool)
    flag[shared] = True
    hit = flag[doc.ids]
    starts, best, width = np.flatnonzero(hit).astype(np.int32), max(least, 1e-12), 32
    found = 0.0
    while len(starts):
        later = []
        for k in range(0, len(starts), 512):  # small enough for the cache
            own = starts[k : k + 512, None]
            at = own + np.arange(width, dtype=np.int32)
            inside = at < size
            np.minimum(at, size - 1, out=at)
            new = (doc.before[at] < own) & inside
            seen = new.cumsum(axis=1, dtype=np.int32)
            both = (new & hit[at]).cumsum(axis=1, dtype=np.int32)
            k = int(np.divide(both, seen - both + n, dtype=np.float32).argmax())
            c, e = int(both.flat[k]), int(seen.flat[k])
            found = max(found, c / (n + e - c))
            best = max(best, found)
            # no longer stretch can be better once all of the query in it would not be
            later.append(own[(own[:, 0] + width < size) & (seen[:, -1] * best < n), 0])
        starts, width = np.concatenate(later), width * 2
    return found if found >= least else 0.0
