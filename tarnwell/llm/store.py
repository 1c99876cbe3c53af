"""Content-addressed store of token ids.

A document's ids, as little-endian integers of the least width that holds the vocabulary, are cut into chunks where a rolling hash over
the last ``window`` ids has its low bits zero, so that equal passages give equal chunks wherever they stand. A chunk is named by
its digest and stored once; a document is the list of its chunks' digests (its recipe) and a Merkle root over them (its manifest).

Tokenising, cutting and hashing happen where a document is read. The store's folder has two parts: ``recipes``, a row a document, and
``chunks``, a row a digest. They are written in one pass: chunks cross the network once, to their owner by digest, without those that a task has sent before, by an aggregate that
combines before it shuffles. ``verify`` reads both back: every payload must have its digest and size, and every recipe must be whole, refer to stored chunks, and hash to the root
that was computed from the text.

Defined results: a null or empty text is a document of no ids, no chunks, and the root of the empty list; rows are documents of
their own even if they share a doc_id or have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .pairs import by_key
from .spill import cut, new_folder
from .words import mix, slices, tidied

_BINARIES, _INTS = pa.list_(pa.binary()), pa.list_(pa.int32())
_COLUMNS = {"row": pa.string(), "doc_id": pa.int64(), "n_tokens": pa.int32(), "n_chunks": pa.int32(), "root": pa.binary(), "digests": _BINARIES, "sizes": _INTS, "digest": pa.binary(), "n_ids": pa.int32(), "payload": pa.binary()}
SCHEMA = "row string, doc_id long, n_tokens int, n_chunks int, root binary, digests array<binary>, sizes array<int>, digest binary, n_ids int, payload binary"
RECIPE = ["row", "doc_id", "n_tokens", "n_chunks", "root", "digests", "sizes"]
_R = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    tokens: bpe.Params = bpe.Params()
    window: int = 16
    mask_bits: int = 8  # a cut at one place in 256 on average
    least: int = 64  # ids of a chunk that isn't a document's last
    most: int = 1024
    digest_bytes: int = 16
    sent: int = 200_000  # digests that a task remembers to have sent


def cuts(ids: np.ndarray, p: Params) -> list[int]:
    """Ends of the chunks. The rolling hash is a polynomial of the window's ids; all that hangs on it is where to cut."""
    n = len(ids)
    if not n:
        return []
    h = np.zeros(max(0, n + 1 - p.window), dtype=np.uint64)
    for k in range(p.window if len(h) else 0):
        h *= _R
        h += ids[k : k + len(h)].astype(np.uint64)
    marks = np.flatnonzero((mix(h) & np.uint64((1 << p.mask_bits) - 1)) == 0) + p.window
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > p.most:
            at += p.most
            out.append(at)
        if m - at >= p.least or m == n and m > at:
            at = m
            out.append(at)
    return out


def merkle(digests: list[bytes], size: int) -> bytes:
    """Root of the binary tree over the digests; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=size).digest() for d in digests]
    if not level:
        return hashlib.blake2b(b"", digest_size=size).digest()
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=size).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def digest(payload: bytes, p: Params) -> bytes:
    return hashlib.blake2b(payload, digest_size=p.digest_bytes).digest()


def width(p: Params) -> type:
    """Asked on the driver only, which has the vocabulary's file."""
    return np.uint16 if bpe.bpe(p.tokens).vocabulary <= 1 << 16 else np.uint32


def tokenised(texts: pa.Array, p: bpe.Params, file: bytes | None = None) -> Iterator[tuple[int, pa.Array, list[np.ndarray]]]:
    """(first row, slice, its tokens), slice by slice; null counts as empty. A text is encoded in one call. To look its segments up in the encoder's memory takes up to a third
    less if all are there, and three times as long if all are new. Only a text longer than a slice goes up the encoder's tree, as the call makes an object a token."""
    b = bpe.bpe(p, file)
    for at, part in slices(texts, p.slice_chars):
        yield at, part, [np.array(b.enc.encode_ordinary(t), dtype=np.int32) if len(t) <= p.slice_chars else b.encode(t) for t in (t or "" for t in part.to_pylist())]


def chunked(docs: DataFrame, p: Params) -> DataFrame:
    """A row for each document (its recipe), and one for each chunk that the task hasn't sent before (digest, n_ids, payload)."""
    kind, file = width(p), bpe.sent(docs.sparkSession, p.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        task, row = TaskContext.get().partitionId(), 0  # the same if the task is run again
        for b in batches:
            for at, part, tokens in tokenised(b.column(1), p.tokens, file.value):
                digests, sizes, ends_, roots = [], [], [0], []
                new: list[tuple[bytes, int, bytes]] = []
                for t in tokens:
                    raw, start = t.astype(kind), 0
                    for e in cuts(t, p):
                        payload = raw[start:e].tobytes()
                        d = digest(payload, p)
                        digests.append(d)
                        sizes.append(e - start)
                        if d not in sent:
                            sent.add(d)
                            new.append((d, e - start, payload))
                        start = e
                    roots.append(merkle(digests[ends_[-1] :], p.digest_bytes))
                    ends_.append(len(digests))
                if len(sent) > p.sent:
                    sent.clear()
                ends = pa.array(ends_, pa.int32())
                recipe = [pa.array([f"{task}-{row + k}" for k in range(len(tokens))]), b.column(0).slice(at, len(part)), pa.array([len(t) for t in tokens], pa.int32()), pa.array(np.diff(ends_), pa.int32()), pa.array(roots, pa.binary())]
                recipe += [pa.ListArray.from_arrays(ends, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32()))]
                row += len(tokens)
                yield _batch(dict(zip(RECIPE, recipe)), len(tokens))
                if new:
                    yield _batch(dict(zip(("digest", "n_ids", "payload"), (pa.array(c) for c in zip(*new)))), len(new))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), SCHEMA)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))


def write(docs: DataFrame, path: str | None = None, p: Params = Params()) -> str:
    """Writes the store and returns its folder, a new one in the shared folder unless ``path`` names it."""
    path = path or new_folder(docs.sparkSession)
    rows = chunked(docs, p).dropDuplicates(["digest", "row"]).withColumn("part", F.when(F.col("digest").isNull(), "recipes").otherwise("chunks"))
    rows.write.partitionBy("part").parquet(path)
    return path


def recipes(spark, path: str) -> DataFrame:
    """(row, doc_id, n_tokens, n_chunks, root, digests, sizes) of every document."""
    return _part(spark, path, "recipes").select(RECIPE)


def chunks(spark, path: str) -> DataFrame:
    """(digest, n_ids, payload): the unique chunks."""
    return _part(spark, path, "chunks").select("digest", "n_ids", "payload")


def _part(spark, path: str, part: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", part string").parquet(path).where(F.col("part") == part)


def verify(spark, path: str, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, root, verified) of every row that was stored."""
    documents = recipes(spark, path)
    size = np.dtype(width(p)).itemsize

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [x is not None and digest(x, p) == d and len(x) == n * size for d, n, x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["digest", "n_ids"])

    sound = chunks(spark, path).mapInArrow(tidied(good), "digest binary, n_ids int").groupBy("digest", "n_ids").count().where("count = 1")
    uses = documents.select("row", F.explode(F.arrays_zip("digests", "sizes")).alias("u")).select("row", F.col("u.digests").alias("digest"), F.col("u.sizes").alias("n_ids"))
    wrong = cut(uses.select("digest", "n_ids").distinct().join(sound, ["digest", "n_ids"], "left_anti"))
    if wrong.isEmpty():
        documents = documents.withColumn("bad", F.lit(False))
    else:
        bad = uses.join(wrong, ["digest", "n_ids"], "left_semi").select("row").distinct().withColumn("bad", F.lit(True))
        documents = documents.join(bad, "row", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, chunks_, roots, digests, sizes, bads = (c.to_pylist() for c in b.columns[1:])
            ok = [not x and len(d) == n and sum(k) == t and merkle(d, p.digest_bytes) == root for t, n, root, d, k, x in zip(tokens, chunks_, roots, digests, sizes, bads)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.hex() for r in roots], pa.string()), pa.array(ok, pa.bool_())], names=["doc_id", "n_tokens", "n_chunks", "root", "verified"])

    return documents.select("doc_id", "n_tokens", "n_chunks", "root", "digests", "sizes", "bad").mapInArrow(tidied(check), "doc_id long, n_tokens int, n_chunks int, root string, verified boolean")


def reconstruct(spark, path: str, p: Params = Params()) -> DataFrame:
    """(doc_id, tokens) of every row that was stored, from recipes and chunks. Chunks that very many documents use are broadcast to their uses."""
    kind = np.dtype(width(p)).newbyteorder("<")
    uses = recipes(spark, path).select("row", "doc_id", F.posexplode_outer("digests").alias("ordinal", "digest"))
    n = cut(uses.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    held = by_key(uses.where("digest is not null"), chunks(spark, path).select("digest", "payload").join(n, "digest"), "digest", most=100_000).select("row", "doc_id", "ordinal", "payload")
    empty = uses.where("digest is null").select("row", "doc_id", F.lit(0).alias("ordinal"), F.lit(b"").alias("payload"))
    parts = held.unionByName(empty).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(b"".join(u["payload"] or b"" for u in x), dtype=kind).astype(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return parts.select("doc_id", "parts").mapInArrow(tidied(run), "doc_id long, tokens array<int>")
