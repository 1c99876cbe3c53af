"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector of unit length is turned by several random rotations; the signs are its code x', and <x', x> its stored correction factor f.
For another vector y, <x', y> / f is an unbiased estimate of <x, y>, with a standard error of sqrt(1 - <x, y>^2) sqrt(1 - f^2) / f / sqrt(bits). A pair whose
estimate lies above the confidence interval of a pair right at the threshold is linked, one below it is not, and what lies
within is recomputed from the vectors, where the pair is met. Before that, pairs go whose codes differ in more bits than those of the threshold's angle may.

Candidates are pairs that agree in all bits of one of several bands, each of which takes bits of the code at random places. The bits of a band follow the number of
vectors, so that unrelated vectors seldom meet, and the number of bands follows from these and from ``recall``: two vectors of the threshold's angle agree in a
bit with probability 1 - angle / pi. So bands grow with about the power 0.22 of the number of vectors, and recall is the same at every size. A pair that meets in several
bands is looked at in the first. Keys that only one vector has are dropped before codes travel; groups of any size are compared in blocks; equal vectors
are one, with their number. Pairs are never rows: a task hands on how many links its vectors have and a forest of what is connected.

Defined results: null vectors, and those with a null, an infinite or a NaN component or of length 0, have no direction and no links; vectors of
different dimension aren't compared; rows without vec_id are left out; rows of one vec_id are one, whose number of links is the sum over its distinct vectors (should two of
these be linked, each counts the other), and whose class is that of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .pairs import BLOCK, HOT, Linked, blocked, by_key, by_part, components, part_pairs
from .spill import Scratch, cut
from .words import tidied

PAIRS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    code_bits: int = 1024  # at least; a multiple of the dimension
    recall: float = 0.98  # of pairs right at the threshold; that of closer ones is higher
    spare_bits: int = 4  # a band has so many bits more than the number of vectors has
    confidence: float = 5.0  # standard errors
    seed: int = 7
    block: int = BLOCK  # vectors of a group that are compared at once
    hot: int = HOT  # rows of a key above which it doesn't go into one task


def bands(vectors: int, p: Params) -> tuple[int, int]:
    """(bits of a band, bands) for so many vectors."""
    bits = max(8, min(40, math.ceil(math.log2(max(2, vectors))) + p.spare_bits))
    agree = (1 - math.acos(p.threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - p.recall) / math.log1p(-agree) * 1.1)  # bands share bits: a tenth more


@lru_cache(maxsize=8)
def places(size: int, shape: tuple[int, int], p: Params) -> np.ndarray:
    """bands x bits places in a code of that size, different ones within a band."""
    rng = np.random.default_rng([p.seed, size, *shape])
    return np.stack([rng.permutation(size)[: shape[0]] for _ in range(shape[1])])


@lru_cache(maxsize=8)
def frame(dim: int, p: Params) -> np.ndarray:
    """Random rotations below each other, as many as the code's bits need: bits x dim."""
    rng = np.random.default_rng([p.seed, dim])
    turns = []
    for _ in range(-(-p.code_bits // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns).astype(np.float32)


@dataclass
class Codes:
    bits: np.ndarray  # n x bits, of 0 and 1
    factor: np.ndarray  # <x', x>
    error: np.ndarray  # standard error of an estimate


def codes(x: np.ndarray, p: Params) -> Codes:
    """Codes of rows of unit length."""
    turned = x @ frame(x.shape[1], p).T
    n = turned.shape[1]
    # x' has components +-1 / sqrt(n), and x the turned ones / sqrt(turns)
    factor = np.abs(turned).sum(axis=1) / np.sqrt(n * (n / x.shape[1]))
    return Codes((turned > 0).astype(np.uint8), factor, np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(1, n - n // x.shape[1])))


def keys(bits: np.ndarray, shape: tuple[int, int], p: Params) -> np.ndarray:
    """n x bands integers."""
    weights = np.int64(1) << np.arange(shape[0], dtype=np.int64)
    out = np.empty((len(bits), shape[1]), dtype=np.int64)
    for k, at in enumerate(places(bits.shape[1], shape, p)):
        out[:, k] = bits[:, at] @ weights
    return out


def _unit(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors at unit length), for each dimension."""
    size = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        x = np.asarray(flat, dtype=np.float64).reshape(len(rows), dim)
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield rows[ok], x[ok] / norm[ok, None]


def _coded(owner: DataFrame, p: Params) -> DataFrame:
    """(node, vec_id, size, dim, code, factor, vector): the bits of the code as bytes, its correction factor, and the vector at unit length as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                for rows, x in _unit(part.column(3)):
                    code = codes(x.astype(np.float32), p)
                    packed = np.packbits(code.bits, axis=1)
                    own = part.take(pa.array(rows))
                    columns = [own.column(0), own.column(1), own.column(2), pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(code.factor, pa.float32()), pa.array([r.tobytes() for r in x], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "vec_id", "size", "dim", "code", "factor", "vector"])

    return owner.select("node", "vec_id", "size", "embedding").mapInArrow(tidied(run), "node long, vec_id long, size long, dim int, code binary, factor float, vector binary")


def _bits(column: pa.Array, dim: int, p: Params) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, : -(-p.code_bits // dim) * dim]


def _posted(coded: DataFrame, shape: tuple[int, int], p: Params) -> DataFrame:
    """(node, key): a row for each band; the band's number and the dimension are part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    k = keys(_bits(own.column(2), int(dim), p), shape, p) | (np.arange(shape[1], dtype=np.int64) << np.int64(shape[0])) | np.int64(int(dim) << 50)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.column(0).to_numpy(), shape[1])), pa.array(k.ravel())], names=["node", "key"])

    return coded.select("node", "dim", "code").mapInArrow(tidied(run), "node long, key long")


def _compare(shape: tuple[int, int], p: Params):
    def run(b: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        dims = b.column("dim").to_numpy()
        runs = np.cumsum(size) - size
        for dim in map(int, np.unique(dims[runs])):
            part, own = b.take(pa.array(np.flatnonzero(dims == dim))), size[dims[runs] == dim]
            ids, node, copies, side = (part.column(c).to_numpy() for c in ("vec_id", "node", "size", "side"))
            across = part.column("across").to_numpy(zero_copy_only=False)
            packed = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
            n = -(-p.code_bits // dim) * dim
            whole = np.zeros((len(packed), -(-packed.shape[1] // 8)), dtype=np.uint64)
            whole.view(np.uint8)[:, : packed.shape[1]] = packed
            # bits in which codes of the threshold's angle differ, and the confidence interval of that
            apart = math.acos(p.threshold) / math.pi
            most = n * apart + p.confidence * math.sqrt(n * apart * (1 - apart))
            linked = Linked(ids, copies)
            for i, j in part_pairs(own, PAIRS_AT_ONCE):
                ok = (side[i] != side[j]) | ~across[i]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1, dtype=np.int64) <= most
                i, j = i[ok], j[ok]
                if len(i):
                    _judge(part, dim, packed, i, j, linked, shape, p)
            yield linked.rows(node)

    return run


def _judge(part: pa.RecordBatch, dim: int, packed: np.ndarray, i: np.ndarray, j: np.ndarray, linked: Linked, shape: tuple[int, int], p: Params) -> None:
    """Links those of the pairs i, j that meet first in this band and are near: by the estimate where it is sure, by the vectors elsewhere."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    n = -(-p.code_bits // dim) * dim
    bits = np.unpackbits(packed[rows], axis=1)[:, :n]
    own = part.take(pa.array(rows))
    band_keys, band = keys(bits, shape, p), (own.column("key").to_numpy() >> shape[0]) & ((1 << (50 - shape[0])) - 1)
    ok = (band_keys[x] == band_keys[y]).argmax(axis=1) == band[x]
    i, j, x, y = i[ok], j[ok], x[ok], y[ok]
    signs = (bits.astype(np.float32) * 2 - 1) / np.sqrt(np.float32(n))
    v = np.frombuffer(b"".join(own.column("vector").to_pylist()), dtype=np.float64).reshape(-1, dim)
    turned = v.astype(np.float32) @ frame(dim, p).T / np.sqrt(np.float32(n / dim))
    factor = own.column("factor").to_numpy().astype(float)
    # the error lies in y's part across x, which at the threshold is sqrt(1 - t^2) long; the interval is that of a pair right at the threshold
    margin = p.confidence * math.sqrt(max(0.0, 1 - p.threshold**2)) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(1, n - n // dim))
    for k in range(0, len(i), 4096):
        a, b = x[k : k + 4096], y[k : k + 4096]
        estimate = (np.einsum("ij,ij->i", signs[a], turned[b]) / factor[a] + np.einsum("ij,ij->i", signs[b], turned[a]) / factor[b]) / 2
        bound = np.maximum(margin[a], margin[b])
        near = estimate - bound >= p.threshold
        open_ = np.flatnonzero(~near & (estimate + bound >= p.threshold))
        near[open_] = np.einsum("ij,ij->i", v[a[open_]], v[b[open_]]) >= p.threshold
        for c in (i, j):
            linked.exact += np.bincount(c[k : k + 4096][open_], minlength=len(linked.exact))
        linked.add(i[k : k + 4096][near], j[k : k + 4096][near])


def _links(coded: DataFrame, shape: tuple[int, int], p: Params, s: Scratch) -> DataFrame:
    """(node, n, exact, u, v) as ``pairs.FOUND``: links of each vector, weighted by the ids that have the other one, and a forest of owners' vec_ids."""
    posts = _posted(coded, shape, p)
    n = s.cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = by_key(posts, n, "key", hot=p.hot).select("node", "key")
    return s.cut(by_part(blocked(shared.join(coded, "node"), "key", "node", n.where(F.col("n") > p.block), p.block), "key", _compare(shape, p)))


def classes(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, class_id, n_links, n_exact) of every vec_id: the smallest vec_id that it is connected with, how many vectors of other rows have a cosine of ``threshold``
    or more with its own, and for how many the estimate left that open, so that they were recomputed."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where("vec_id is not null")
    element = "double" if dict(embeddings.dtypes)["embedding"] == "array<double>" else "float"
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{element}>")).withColumn("node", F.xxhash64("embedding"))
    valid = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    have = rows.where(valid)
    with Scratch(embeddings.sparkSession) as s:
        owner = have.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.countDistinct("vec_id").alias("size")).withColumn("node", F.xxhash64("embedding"))
        coded = s.cut(_coded(owner, p))
        found = _links(coded, bands(coded.count(), p), p, s)
        links = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n_links"), F.sum("exact").alias("n_exact"))
        edges = found.where("u is not null").select("u", "v")
        several = s.cut(have.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("vec_id"))
        if not several.isEmpty():  # ids of several vectors connect the classes of these
            own = have.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("u"), "node").distinct()
            edges = edges.unionByName(by_key(own, coded.select("node", F.col("vec_id").alias("v"), "size"), "node", "size", p.hot).select("u", "v"))
        group = components(edges, "u", "v").withColumnRenamed("id", "vec_id")
        reps = coded.select("node", "vec_id", "size").join(links, "node", "left").where("size > 1 or n_links > 0 or n_exact > 0").join(group, "vec_id", "left")
        reps = s.cut(reps.select("node", "vec_id", "size", F.coalesce("group", "vec_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("n_exact", F.lit(0)).alias("n_exact")))
        copies = by_key(have.select("node", F.col("vec_id").alias("id")), reps.where("size > 1"), "node", "size", p.hot).where("id <> vec_id").select("node", F.col("id").alias("vec_id"), "class_id", "n_links", "n_exact").distinct()
        rest = rows.select(F.lit(None).cast("long").alias("node"), "vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_exact"))
        all_ = reps.select(rest.columns).unionByName(copies).unionByName(rest)
        return cut(all_.groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("long").alias("n_links"), F.sum("n_exact").cast("long").alias("n_exact")))
