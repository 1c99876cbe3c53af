"""Benchmark decontamination with suffix arrays over the training text.

Every task sorts the word suffixes of its share of the documents into suffix arrays, searches every suffix of every
benchmark item in them by bisection, and extends each hit to its longest verbatim match (verbatim up to case and
punctuation). Nothing is shuffled but the hits. Suffixes are ordered to the depth that bisection needs: ``min_words``.

Defined results: a null or empty document or item matches nothing; an item of fewer than ``least_item`` words is
too short to prove anything and is ignored; an item of fewer than ``min_words`` words must match whole; among
equally long matches the earliest in the document, then in the item, is given; repeated documents of one doc_id
give one row an item; an empty benchmark leaves all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .spill import cut
from .words import slices, tidied, words

SYMBOL = 21
_MASK = np.uint64((1 << SYMBOL) - 1)
SCHEMA = "doc_id long, item_id long, match_words int, doc_word long, item_word int"


@dataclass(frozen=True)
class Params:
    min_words: int = 13
    least_item: int = 8
    block_words: int = 350_000  # words of one suffix array; a longer document makes a longer one
    broadcast_chars: int = 64_000_000  # benchmark text that goes to executors at once; a larger benchmark takes several passes


def _key(h: np.ndarray) -> np.ndarray:
    """Symbols of three consecutive words in one integer; past the end, and where a document ends, the symbol is 0."""
    s = np.zeros(len(h) + 2, dtype=np.uint64)
    s[: len(h)] = np.where(h == 0, np.uint64(0), ((h >> np.uint64(64 - SYMBOL)) % (_MASK - np.uint64(1))) + np.uint64(1))
    return (s[:-2] << np.uint64(2 * SYMBOL)) | (s[1:-1] << np.uint64(SYMBOL)) | s[2:]


def suffix_array(key: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` words or more, by doubling the groups that are still tied."""
    n = len(key)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = head + 1
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    done = 3
    while done < depth and len(slots):
        at = order[slots]
        k = (rank[at] << 32) | rank[np.minimum(at + done, n)]
        by = np.argsort(k)
        at, k = at[by], k[by]
        order[slots] = at
        new = np.ones(len(slots), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        slots = slots[~(new & np.append(new[1:], True))]
        done *= 2
    return order


@dataclass
class Tests:
    """Suffixes of the benchmark, ready to be searched: hashes of all items with a 1 after each."""

    h: np.ndarray
    key: np.ndarray
    suffix: np.ndarray
    item: np.ndarray
    need: np.ndarray
    item_start: np.ndarray
    ids: list


def make_tests(rows: list[tuple[int, str]], p: Params) -> Tests:
    rows = [(i, t) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")) if t]
    w = words(pa.array([t for _, t in rows], pa.string()))
    lens = np.diff(w.first)
    keep = np.flatnonzero(lens >= p.least_item)
    parts, starts, at = [], [], 0
    for k in keep:
        parts += [np.maximum(w.hash[w.first[k] : w.first[k + 1]], np.uint64(2)), np.ones(1, dtype=np.uint64)]
        starts.append(at)
        at += lens[k] + 1
    h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(keep)), lens[keep] + 1) if len(keep) else np.zeros(0, dtype=np.int64)
    start = np.array(starts, dtype=np.int64)
    need = np.minimum(lens[keep], p.min_words)
    left = start[item] + lens[keep][item] - np.arange(len(h)) if len(h) else np.zeros(0, dtype=np.int64)
    suffix = np.flatnonzero(left >= need[item]) if len(h) else np.zeros(0, dtype=np.int64)
    return Tests(h, np.append(_key(h), np.zeros(max(3, p.min_words), dtype=np.uint64)), suffix, item, need, start, [rows[k][0] for k in keep])


def _bound(key: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: int, target: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = key[np.minimum(order[np.minimum(mid, len(order) - 1)] + off, len(key) - 1)]
        up = open_ & ((v <= target) if right else (v < target))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def search(h: np.ndarray, tests: Tests, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in h, position in tests.h, words) of every left-maximal match of the length needed. h holds 0 after each document."""
    none = (np.zeros(0, dtype=np.int64),) * 3
    if not len(h) or not len(tests.suffix):
        return none
    key = _key(h)
    order = suffix_array(key, depth)
    first = key[order]
    key = np.append(key, np.uint64(0))
    t = tests.suffix
    lo, hi = np.zeros(len(t), dtype=np.int64), np.full(len(t), len(h), dtype=np.int64)
    for off in range(0, depth, 3):
        here = np.clip(tests.need[tests.item[t]] - off, 0, 3)
        if not here.any():
            break
        spare = ((3 - here) * SYMBOL).astype(np.uint64)
        low = (tests.key[t + off] >> spare) << spare
        high = low | ((np.uint64(1) << spare) - np.uint64(1))
        if off == 0:
            lo, hi = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
        else:
            lo, hi = _bound(key, order, lo, hi, off, low, False), _bound(key, order, lo, hi, off, high, True)
        some = hi > lo
        t, lo, hi = t[some], lo[some], hi[some]
        if not len(t):
            return none
    n = hi - lo
    total = int(n.sum())
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    s, t = order[np.repeat(lo, n) + within], np.repeat(t, n)
    inner = (t > tests.item_start[tests.item[t]]) & (s > 0) & (h[np.maximum(s - 1, 0)] == tests.h[np.maximum(t - 1, 0)])
    s, t = s[~inner], t[~inner]
    length = np.zeros(len(s), dtype=np.int64)
    live = np.arange(len(s))
    while len(live):
        a, b = s[live] + length[live], t[live] + length[live]
        live = live[(a < len(h)) & (h[np.minimum(a, len(h) - 1)] == tests.h[np.minimum(b, len(tests.h) - 1)])]
        length[live] += 1
    ok = length >= tests.need[tests.item[t]]
    return s[ok], t[ok], length[ok]


def hits(texts: pa.Array, tests: Tests, p: Params) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item, words, document's word, item's word) of matches, over suffix arrays of about block_words."""
    parts: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0

    def flush() -> tuple[np.ndarray, ...]:
        h, row = np.concatenate(parts), np.concatenate(rows)
        s, t, n = search(h, tests, p.min_words)
        row_start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        item = tests.item[t]
        r = row[s]
        return r, item, n, s - row_start[np.searchsorted(row[row_start], r)], t - tests.item_start[item]

    for at, part in slices(texts):
        w = words(part)
        lens = np.diff(w.first)
        h = np.zeros(len(w.hash) + len(lens), dtype=np.uint64)
        row = np.repeat(np.arange(len(lens)), lens)
        h[np.arange(len(w.hash)) + row] = np.maximum(w.hash, np.uint64(2))
        if held and held + len(h) > p.block_words:
            yield flush()
            parts, rows, held = [], [], 0
        parts.append(h)
        rows.append(np.repeat(np.arange(at, at + len(lens)), lens + 1))
        held += len(h)
    if held:
        yield flush()


def _passes(benchmark: DataFrame, p: Params) -> Iterator[tuple[Broadcast, bool]]:
    """(part of the benchmark as a broadcast of a checked size, whether it is all): one part, or as many as its size asks for. A part is collected when it is asked for
    and given up when the next one is, so the driver never holds more than one; what is made of it must be written before."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-chars // p.broadcast_chars) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        sent = benchmark.sparkSession.sparkContext.broadcast(make_tests([tuple(r) for r in items.where(part == k).collect()], p))
        yield sent, n == 1
        if n > 1:
            sent.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each document and item that share a passage: its longest match and where it lies, in words from 0."""
    out = None
    for tests, all_ in _passes(benchmark, p):

        def find(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            ids = np.array([-1 if i is None else i for i in tests.value.ids], dtype=np.int64)
            null = np.array([i is None for i in tests.value.ids], dtype=bool)
            for b in batches:
                for r, item, n, dw, iw in hits(b.column(1), tests.value, p):
                    if not len(r):
                        continue
                    by = np.lexsort((iw, dw, -n, item, r))
                    r, item, n, dw, iw = (x[by] for x in (r, item, n, dw, iw))
                    top = np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]))
                    r, item, n, dw, iw = (x[top] for x in (r, item, n, dw, iw))
                    item_id = pa.array(ids[item], mask=null[item])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), item_id, pa.array(n.astype(np.int32)), pa.array(dw), pa.array(iw.astype(np.int32))], names=["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(find), SCHEMA)
        found = found if all_ else cut(found)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.match_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents, in all their columns, that share no passage with the benchmark. Decided where the document is read; nothing is shuffled."""
    text_at = docs.columns.index("text")
    for tests, all_ in _passes(benchmark, p):

        def clean(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for r, *_ in hits(b.column(text_at), tests.value, p):
                    keep[r] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(tidied(clean), docs.schema)
        docs = docs if all_ else cut(docs)
    return docs
