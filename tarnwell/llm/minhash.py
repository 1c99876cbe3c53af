"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's signature has one minimum for each of ``coordinates`` hash functions over its word shingles. Documents are posted
under each (coordinate, value); a pair is linked that collides in ``least`` coordinates or more. Three exact rules keep the
posting lists that are merged short:

* documents of equal signatures have the same partners: one posting, of their number, stands for all of them;
* a value that nobody else has can't collide: such postings are skipped, and so are documents left with fewer than ``least``;
* of the m postings left to a document, sorted from the rarest, a partner must share one of the first m - least + 1 (the
  prefix). Only those lists are merged; the long lists behind them are skipped over, by comparing signatures in place.

A pair that meets under several values is counted under the first of its common prefix values only. Lists of any length are
merged in blocks (``pairs.blocked``), so no list is cut short and none has to fit into one task. Pairs are never rows: a task hands on
how many links its documents have and a forest of what is connected. Numbers of postings come from aggregates, which combine
before they shuffle, and go back by ``pairs.by_key``, which splits hot values.

Defined results: documents without words (null, empty) have no signature and no links; a document shorter than a shingle
is one shingle; links are counted between the distinct signatures of distinct ids: rows that share a doc_id are one document, whose number of links
is the sum over its signatures (should two of these collide, each counts the other), and whose class is that of all its texts; rows without doc_id have no
links and are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pairs import BLOCK, HOT, Linked, blocked, by_key, by_part, components, part_pairs
from .spill import Scratch, cut
from .words import grams, mix, slices, tidied, words

PAIRS_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    coordinates: int = 48
    least: int = 26  # collisions that make a pair: a Jaccard similarity of about 0.54
    seed: int = 1
    broadcast_ids: int = 2_000_000
    block: int = BLOCK  # rows of a posting list that are merged at once
    hot: int = HOT  # rows of a value above which it doesn't go into one task


def signatures(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their signatures as 32-bit integers)."""
    factors = mix(np.arange(1, p.coordinates + 1, dtype=np.uint64) * np.uint64(2 * p.seed + 1) << np.uint64(20)) | np.uint64(1)
    rows, sigs = [], []
    for at, part in slices(texts):
        w = words(part)
        lens = np.diff(w.first)
        have = np.flatnonzero(lens)
        if not len(have):
            continue
        g = np.zeros(len(w.hash), dtype=np.uint64)
        full = grams(w.hash, p.shingle)
        g[: len(full)] = full
        n = np.maximum(lens[have] - p.shingle + 1, 1)
        for k in have[lens[have] < p.shingle]:
            g[w.first[k]] = grams(w.hash[w.first[k] : w.first[k + 1]], int(lens[k]))[0]
        starts = np.cumsum(n) - n
        g = g[np.repeat(w.first[have] - starts, n) + np.arange(int(n.sum()))]
        sig = np.empty((len(have), p.coordinates), dtype=np.uint64)
        t = np.empty_like(g)
        for c, f in enumerate(factors):
            np.multiply(g, f, out=t)
            sig[:, c] = np.minimum.reduceat(t, starts)
        rows.append(at + have)
        sigs.append((mix(sig) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, p.coordinates), dtype=np.int32)
    return np.concatenate(rows), np.concatenate(sigs)


def signed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, sig): sig holds the signature's 32-bit integers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sig = signatures(b.column(1), p)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(tidied(run), "doc_id long, sig binary")


def _postings(reps: DataFrame, p: Params) -> DataFrame:
    """(node, feature) for every coordinate of every signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(p.coordinates, dtype=np.int64) << 32
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sig = _matrix(part.column(1), p).view(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), p.coordinates)), pa.array((sig + base).ravel())], names=["node", "feature"])

    return reps.select("node", "sig").mapInArrow(tidied(run), "node long, feature long")


def _matrix(sig: pa.Array, p: Params) -> np.ndarray:
    offsets = np.frombuffer(sig.buffers()[1], dtype=np.int32)[sig.offset :]
    return np.frombuffer(sig.buffers()[2], dtype=np.int32)[offsets[0] // 4 : offsets[0] // 4 + len(sig) * p.coordinates].reshape(len(sig), p.coordinates)


def _merge(p: Params):
    def run(b: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, side, bits, feature, copies, node = (b.column(k).to_numpy() for k in ("doc_id", "side", "prefix", "feature", "size", "node"))
        at = (feature >> 32).astype(np.uint64)
        sig = _matrix(b.column("sig"), p)
        across = b.column("across").to_numpy(zero_copy_only=False)
        one = np.uint64(1)
        weights = one << np.arange(p.coordinates, dtype=np.uint64)
        linked = Linked(doc, copies)
        for i, j in part_pairs(size, PAIRS_AT_ONCE):
            ok = (side[i] != side[j]) | ~across[i]
            i, j = i[ok], j[ok]
            same = sig[i] == sig[j]
            ok = same.sum(axis=1) >= p.least
            i, j, same = i[ok], j[ok], same[ok]
            if not len(i):
                continue
            common = (same * weights).sum(axis=1, dtype=np.uint64) & bits[i].view(np.uint64) & bits[j].view(np.uint64)
            ok = (common & ((one << at[i]) - one)) == 0
            linked.add(i[ok], j[ok])
        yield linked.rows(node)

    return run


def _links(owner: DataFrame, p: Params, s: Scratch) -> DataFrame:
    """(node, n, exact, u, v) as ``pairs.FOUND``: links of each signature, weighted by the ids that have the other one, and a forest of owners' doc_ids."""
    reps = owner.select("node", "doc_id", "size", "sig")
    posts = _postings(reps, p)
    n = s.cut(posts.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = by_key(posts, n, "feature", hot=p.hot).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "feature"))).alias("f")).where(F.size("f") >= p.least)
    prefix = kept.select("node", F.slice("f.feature", F.lit(1), F.size("f") - (p.least - 1)).alias("f"))
    bits = F.expr("aggregate(f, 0L, (x, v) -> x | shiftleft(1L, cast(shiftright(v, 32) as int)))")
    prefix = s.cut(prefix.select("node", bits.alias("prefix"), F.explode("f").alias("feature")))
    large = s.cut(prefix.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.block))
    return s.cut(by_part(blocked(prefix.join(reps, "node"), "feature", "node", large, p.block), "feature", _merge(p)))


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that is linked with another; class_id is the smallest doc_id that it is connected with, n_links how many
    it is linked with itself. All links are counted, those between copies too, and none is dropped; a document that isn't listed has none and is a class of its own."""
    with Scratch(docs.sparkSession) as s:
        all_ = s.cut(signed(docs, p).withColumn("node", F.xxhash64("sig")))
        owner = s.cut(all_.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("size")).withColumn("node", F.xxhash64("sig")))
        found = _links(owner, p, s)
        links = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n_links"))
        edges = found.where("u is not null").select("u", "v")
        several = s.cut(all_.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id"))
        if not several.isEmpty():  # ids of several signatures connect the classes of these
            own = all_.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), "node").distinct()
            edges = edges.unionByName(by_key(own, owner.select("node", F.col("doc_id").alias("v"), "size"), "node", "size", p.hot).select("u", "v"))
        group = components(edges, "u", "v").withColumnRenamed("id", "doc_id")
        reps = owner.join(links, "node", "left").where("size > 1 or n_links is not null").join(group, "doc_id", "left")
        reps = s.cut(reps.select("node", "doc_id", "size", F.coalesce("group", "doc_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
        copies = by_key(all_.select("node", F.col("doc_id").alias("id")), reps.where("size > 1"), "node", "size", p.hot).where("id <> doc_id").select("node", F.col("id").alias("doc_id"), "class_id", "n_links").distinct()
        rows = reps.select("node", "doc_id", "class_id", "n_links").unionByName(copies)
        return cut(rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("long").alias("n_links")))


def deduplicate(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents, in all their columns, without those of a class but its smallest doc_id. The ids to drop are broadcast if
    there are at most ``broadcast_ids``; beyond that the documents are shuffled."""
    gone = classes(docs, p).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    small = gone.count() <= p.broadcast_ids
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")
