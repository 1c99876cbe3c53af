"""Links within groups of any size, without pairs ever being rows: how many links a row has, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spill import Scratch, cut
from .words import tidied

BLOCK = 1024
HOT = 1_000_000  # rows of a key above which it doesn't go into one task
BROADCAST = 2_000_000  # rows of a table that are broadcast at most
FINISH = 500_000  # edges that one task may finish
FOUND = "node long, n long, exact long, u long, v long"


def by_key(rows: DataFrame, table: DataFrame, key: str, n: str = "n", hot: int = HOT, most: int = BROADCAST) -> DataFrame:
    """Inner join of rows with a table that has one row a key and, as ``n``, how many rows have it. Keys of more than ``hot`` rows are broadcast (there can be
    no more than rows / hot of them, and that they are at most ``most`` is checked), the others are shuffled; so no task gets more than ``hot`` rows of a key."""
    heavy = table.where(F.col(n) > hot)
    many = heavy.limit(most + 1).count()
    if not many or many > most:  # with so many, tasks get several hot keys each, whichever way
        return rows.join(table, key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(n) <= hot), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def blocked(rows: DataFrame, key: str, node: str, large: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``part``, ``side`` and ``across``. large: (key, n) of the keys that more than ``block`` rows have. Their rows are dealt to blocks by a hash, and go to the part of
    each pair of blocks that has their own; so no task holds a large group. A part of two blocks is ``across``: only pairs of different sides count there, so each pair of
    rows meets in exactly one part. No window numbers the rows: blocks are only about equal."""
    some = large.limit(BROADCAST + 1).count()
    if not some:
        return rows.withColumns({"side": F.lit(0), "part": F.lit(0).cast("long"), "across": F.lit(False)})
    rows = rows.join(F.broadcast(large) if some <= BROADCAST else large, key, "left").withColumn("_b", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(node), F.col("_b")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return rows.withColumn("across", F.col("side") != F.col("_o")).withColumn("part", F.least("side", "_o").cast("long") * F.col("_b") + F.greatest("side", "_o")).drop("n", "_b", "_o")


def part_pairs(size: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all pairs of rows of the same run; size: the runs' lengths. About ``at_once`` pairs a time."""
    end = np.repeat(np.cumsum(size), size)
    partners = end - np.arange(len(end)) - 1
    todo = np.cumsum(partners)
    at = 0
    while at < len(end):
        base = todo[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(todo, base + at_once, side="right")))
        n = partners[at:to]
        i = np.repeat(np.arange(at, to), n)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


class Linked:
    """Links among the rows of a batch, gathered without the pairs: for each row the weight of its partners, and a forest that joins what is linked."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray) -> None:
        self.ids, self.at = np.unique(ids, return_inverse=True)
        self.root, self.weight = np.arange(len(self.ids)), weight
        self.n, self.exact = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in ((i, j), (j, i)):
            self.n += np.bincount(a, self.weight[b], minlength=len(self.n)).astype(np.int64)
        join(self.root, self.at[i], self.at[j])

    def rows(self, node: np.ndarray) -> pa.RecordBatch:
        """FOUND: (node, links of it, those computed exactly) and, in other rows, (id, smallest id linked with it)."""
        has = np.flatnonzero((self.n > 0) | (self.exact > 0))
        nodes, which = np.unique(node[has], return_inverse=True)
        n, exact = (np.bincount(which, x[has], minlength=len(nodes)).astype(np.int64) for x in (self.n, self.exact))
        far = np.flatnonzero(self.root != np.arange(len(self.root)))
        a, b = [None] * len(nodes), [None] * len(far)
        columns = [nodes.tolist() + b, n.tolist() + b, exact.tolist() + b, a + self.ids[far].tolist(), a + self.ids[self.root[far]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "exact", "u", "v"])


def join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x and y, pair by pair; roots are the smallest of a tree, and every node points to its root."""
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root[:] = root[root]


def by_part(rows: DataFrame, key: str, fn: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str = FOUND) -> DataFrame:
    """fn(batch, lengths of its runs) over the rows of each (key, part), many parts at a time, none of them split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for last, b in _with_last(batches):
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < 4096 and not last:
                continue
            k, p = (held.column(c).to_numpy() for c in (key, "part"))
            new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
            upto = held.num_rows if last else int(new[-1])
            if upto:
                whole = held.slice(0, upto).combine_chunks().to_batches()[0]
                yield from fn(whole, np.diff(np.append(new[new < upto], upto)))
            held = None if last else held.slice(upto)

    return rows.repartition(key, "part").sortWithinPartitions(key, "part").mapInArrow(tidied(run), schema)


def _with_last(it: Iterator) -> Iterator[tuple[bool, object]]:
    it = (b for b in it if b.num_rows)
    prev = next(it, None)
    if prev is None:
        return
    for x in it:
        yield False, prev
        prev = x
    yield True, prev


def components(pairs: DataFrame, a: str, b: str, finish: int = FINISH, hot: int = HOT) -> DataFrame:
    """(id, group) of every id in the pairs (a, b); group is the smallest id that it is connected with.

    Alternating large-star and small-star steps, in a number of rounds that grows with the logarithm of the longest chain; a node of any degree is
    met by aggregates and ``by_key``, never by a window. Once there are at most ``finish`` edges, one task does the rest. Null ids are left out."""
    schema = "u long, v long"
    found = pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    with Scratch(pairs.sparkSession) as s:
        edges = s.cut(found.mapInArrow(tidied(_forest), schema).distinct())
        while edges.limit(finish + 1).count() > finish:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = s.cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
            down = s.cut(by_key(both.where("v > u"), low, "u", hot=hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            low = s.cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
            up = by_key(down, low, "u", hot=hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            edges = s.cut(up.unionByName(low.select("u", F.col("m").alias("v"))).mapInArrow(tidied(_forest), schema).distinct())
            # stars: nobody has neighbours above it and below it at once, and everybody above has one
            if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
                break
        else:
            edges = edges.coalesce(1).mapInArrow(tidied(lambda batches: _forest(_whole(batches))), schema)
        return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts := list(batches):
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components, at most one for each id of a batch: each id with the smallest of its component in the batch."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = np.arange(len(ids))
        join(root, at[: len(u)], at[len(u) :])
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["u", "v"])
