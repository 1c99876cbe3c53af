"""The search legs. Each takes documents and a frame of queries and gives (query_id, leg, rank, id, score), best first, ties by id.

Queries travel to the documents, a bounded number of them at a time: a batch of more is searched for in several passes, and the driver never holds more than one of
them. A task keeps the best rows of each query over all its documents, and only these are shuffled for the final ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import rotation, stem, stream, text as X, tsquery
from ..functions.languages import CJK_CODES, bm25_group_of
from ..sources.shared import shared_folder

VECTOR, KEYWORD, FTS = 0, 1, 2
BROADCAST_ROWS = 200_000
FEW = 1_000


class LegError(RuntimeError):
    """One or more legs of a search failed; names them all."""


def ranked(scored: DataFrame, leg: int, k: int | None) -> DataFrame:
    """Scores rounded to six digits, the best k of each query."""
    scored = scored.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(order))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("query_id", F.lit(leg).alias("leg"), "rank", "id", "score")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def half_up(score: np.ndarray) -> np.ndarray:
    """Rounded to six digits, as Spark and SQL round."""
    return np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6


Look = Callable[[pa.RecordBatch, np.ndarray, stream.Best], None]


def scanned(docs: DataFrame, columns: list[str], queries: DataFrame, asked: list[str], at_once: int, prepare: Callable[[list[Row]], object], look: Callable[[object], Look], leg: int, k: int | None) -> DataFrame:
    """Ranks what ``look`` finds in batches of (id, columns) for every query. prepare makes of the queries' rows what is broadcast; look(that) gives a function of a batch, its
    ids and the best so far, to which it adds (number of the query among the rows, id, score). ``at_once`` queries go in a pass."""
    kind, key = (dict(f.dtypes)[c] for f, c in ((docs, "id"), (queries, "query_id")))
    arrow, arrow_id = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(docs.schema["id"].dataType)
    spark, parts, held = docs.sparkSession, [], []

    def search(rows: list[Row]) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], prepare(rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, what = sent.value
            best, seek = stream.Best(k), look(what)

            def out() -> Iterator[pa.RecordBatch]:
                if found := best.rows():
                    q, i, x = found
                    yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in q.tolist()], arrow), pa.array(i.tolist(), arrow_id), pa.array(x)], names=["query_id", "id", "score"])

            for b in batches:
                ids = b.column(0)
                seek(b, ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), dtype=object), best)
                if k is None:
                    yield from out()
                    best = stream.Best(None)
            yield from out()

        return docs.select("id", *columns).mapInArrow(run, f"query_id {key}, id {kind}, score double")

    for row in queries.select("query_id", *asked).toLocalIterator():
        held.append(row)
        if len(held) == at_once:
            parts.append(search(held))
            held = []
    if held or not parts:
        parts.append(search(held))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, leg, k)


def in_filters(docs: DataFrame, source_types: list[str] | None = None, source_ids: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Documents whose columns are in the lists; a list that is empty or None filters nothing. Values with a comma are refused."""
    for column, values in (("source_type", source_types), ("source_id", source_ids), ("language", languages)):
        for v in values or []:
            if "," in v:
                raise ValueError(f"{column} can't hold a comma: {v}")
        if values:
            docs = docs.where(F.col(column).cast("string").isin(list(values)))
    return docs


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if either has no direction or the dimensions differ."""
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, x: s + x)
    a, b = _double(a), _double(b)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms)


def vector(docs: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.8) -> DataFrame:
    """Cosine similarity of ``embedding`` to each query's, by the expression; for single queries and small batches. Of more than ``FEW`` queries ``vector_batch`` takes over."""
    if queries.limit(FEW + 1).count() > FEW:
        return vector_batch(docs, queries, k, floor)
    pairs = docs.select("id", "embedding").crossJoin(F.broadcast(queries.select("query_id", F.col("embedding").alias("_q"))))
    return ranked(pairs.select("query_id", "id", cosine(F.col("embedding"), F.col("_q")).alias("score")).where(F.round("score", 6) >= floor), VECTOR, k)


def _by_dimension(rows: list[Row]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers, vectors) of the queries of each dimension; those without a vector, or with a null in it, are left out."""
    dims: dict[int, tuple[list, list]] = {}
    for n, r in enumerate(rows):
        v = r["embedding"]
        if v is not None and len(v) and None not in v:
            numbers, vectors = dims.setdefault(len(v), ([], []))
            numbers.append(n)
            vectors.append(v)
    return [(np.array(numbers), np.array(vectors, dtype=np.float64)) for numbers, vectors in dims.values()]


def _nearest(best: stream.Best, numbers: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int | None, floor: float, block: int) -> None:
    """Adds the best rows of unit vectors x for each of the unit vectors q, by matrix products of ``block`` of both at a time."""
    for at in range(0, len(x), block):
        for first in range(0, len(q), block):
            with np.errstate(all="ignore"):
                s = half_up(q[first : first + block] @ x[at : at + block].T)
            s[~np.isfinite(s)] = -np.inf
            if k is not None and s.shape[1] > k:  # ties at the edge stay in
                edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                s[s < edge[:, None]] = -np.inf
            i, j = np.nonzero(s >= floor)
            best.add(numbers[first + i], ids[at + j], s[i, j])


def vector_batch(docs: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.8, at_once: int = 20_000, block: int = 1024) -> DataFrame:
    """The same for many queries: matrix products of ``block`` queries and documents at a time."""

    def look(asked: list) -> Look:
        with np.errstate(all="ignore"):
            by_dim = {v.shape[1]: (numbers, v / np.linalg.norm(v, axis=1)[:, None]) for numbers, v in asked}

        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            for rows, x in stream.matrices(b.column(1)):
                if x.shape[1] not in by_dim:
                    continue
                numbers, q = by_dim[x.shape[1]]
                with np.errstate(all="ignore"):
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                _nearest(best, numbers, q, ids[rows], x, k, floor, block)

        return seek

    return scanned(docs, ["embedding"], queries, ["embedding"], at_once, _by_dimension, look, VECTOR, k)


def vector_coded(index: DataFrame, docs: DataFrame, queries: DataFrame, k: int, floor: float = 0.8, pool: int = 10, at_once: int = 20_000, block: int = 1024) -> DataFrame:
    """Approximate: ranks by codes (``sources.postings.codes``: id, dim, code, factor), which are a small part of the vectors, and computes the cosine of the best ``pool`` * k
    of each query only. Every row is in the index; how many of the true best come out is a matter of ``pool``."""

    def prepare(rows: list[Row]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out: dict[int, tuple[list, list]] = {}
        for n, r in enumerate(rows):
            v = r["embedding"]
            if v is not None and len(v) and None not in v and (norm := float(np.linalg.norm(v))) > 0 and np.isfinite(norm):
                numbers, vectors = out.setdefault(len(v), ([], []))
                numbers.append(n)
                vectors.append(np.array(v) / norm)
        return {d: (np.array(numbers), np.array(vectors)) for d, (numbers, vectors) in out.items()}

    def look(asked: dict) -> Look:
        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            dims, factor = b.column(1).to_numpy(), b.column(3).to_numpy()
            for dim, (numbers, q) in asked.items():
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), block):
                    own = rows[at : at + block]
                    packed = np.frombuffer(b"".join(b.column(2).take(pa.array(own)).to_pylist()), dtype=np.uint8).reshape(len(own), -1)
                    for first in range(0, len(q), block):
                        s = rotation.estimates(q[first : first + block], packed, factor[own].astype(float))
                        if s.shape[1] > k * pool:
                            s[s < -np.partition(-s, k * pool - 1, axis=1)[:, k * pool - 1, None]] = -np.inf
                        i, j = np.nonzero(np.isfinite(s))
                        best.add(numbers[first + i], ids[own[j]], s[i, j].astype(float))

        return seek

    found = scanned(index, ["dim", "code", "factor"], queries, ["embedding"], at_once, prepare, look, VECTOR, k * pool).select("query_id", "id")
    pairs = found.join(docs.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    return ranked(pairs.select("query_id", "id", cosine(F.col("embedding"), F.col("_q")).alias("score")).where(F.round("score", 6) >= floor), VECTOR, k)


def cells(docs: DataFrame, n: int, seed: int = 1, fit_rows: int = 200_000) -> tuple[DataFrame, list[list[float]]]:
    """(docs with their cell, the cells' centres): k-means over unit vectors, the coarse index of ``vector_probed``. It is fitted on about ``fit_rows`` rows at most, chosen by a
    hash of their ids; every row gets a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = max(1, -(-docs.count() // fit_rows))
    fit_on = docs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    model = KMeans(k=n, seed=seed, distanceMeasure="cosine", featuresCol="_f", predictionCol="cell").fit(fit_on.select(array_to_vector(_double(F.col("embedding"))).alias("_f")))
    return model.transform(docs.withColumn("_f", array_to_vector(_double(F.col("embedding"))))).drop("_f"), [c.tolist() for c in model.clusterCenters()]


def vector_probed(celled: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, floor: float, probes: int, at_once: int = 20_000, block: int = 1024) -> DataFrame:
    """Approximate: only documents in the ``probes`` cells nearest to a query are compared with it, by matrix products cell by cell."""

    def look(asked: list) -> Look:
        middle = np.array(centres, dtype=np.float64)
        by_dim: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        with np.errstate(all="ignore"):
            middle = middle / np.linalg.norm(middle, axis=1)[:, None]
            for numbers, v in asked:
                q = v / np.linalg.norm(v, axis=1)[:, None]
                if q.shape[1] != middle.shape[1]:
                    continue  # no document of another dimension has a cell
                near = np.argsort(-(q @ middle.T), axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(q), len(middle)), dtype=bool)
                np.put_along_axis(probed, near, True, axis=1)
                by_dim[q.shape[1]] = [(numbers[own], q[own]) for own in probed.T]

        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            cell = b.column(2).to_numpy()
            for rows, x in stream.matrices(b.column(1)):
                if x.shape[1] not in by_dim:
                    continue
                with np.errstate(all="ignore"):
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                for c in np.unique(cell[rows]).tolist():
                    own = np.flatnonzero(cell[rows] == c)
                    _nearest(best, *by_dim[x.shape[1]][c], ids[rows[own]], x[own], k, floor, block)

        return seek

    return scanned(celled, ["embedding", "cell"], queries, ["embedding"], at_once, _by_dimension, look, VECTOR, k)


def _grams_of(rows: list[Row], of: Callable[[str], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(all grams of the queries, sorted; for each query the places of its own among them)."""
    each = [np.unique(of(r["text"])) if r["text"] else np.zeros(0, dtype=np.uint64) for r in rows]
    known = np.unique(np.concatenate([*each, np.zeros(0, dtype=np.uint64)]))
    return known, [np.searchsorted(known, g) for g in each]


def _holders(own: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n grams the queries that have it: (where its queries begin, queries)."""
    gram = np.concatenate([*own, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    query = np.repeat(np.arange(len(own)), [len(g) for g in own])
    order = np.argsort(gram, kind="stable")
    return np.searchsorted(gram[order], np.arange(n + 1)), query[order]


def _no_blank(g: np.ndarray) -> np.ndarray:
    return g[((g >> np.uint64(21)) != 32) & ((g & np.uint64((1 << 21) - 1)) != 32)]


def bigram(docs: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.35, at_once: int = 2_000) -> DataFrame:
    """Share of the query's bigrams that ``content`` has, of those without a blank. Documents that share none aren't candidates."""
    def look(what: tuple) -> Look:
        known, own = what
        begin, query = _holders(own, len(known))
        size = np.array([len(g) for g in own])

        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            for first, part in stream.slices(b.column(1)):
                gram, text = stream.bigram_codes(part.to_pylist())
                at, which = stream.members(gram, known)
                has = np.unique(text[at] * len(known) + which) if len(at) else at
                text, which = has // max(1, len(known)), has % max(1, len(known))
                n = begin[which + 1] - begin[which]
                to = query[np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                pair, shared = np.unique(np.repeat(text, n) * len(own) + to, return_counts=True)
                text, to = pair // max(1, len(own)), pair % max(1, len(own))
                score = half_up(shared / size[to])
                ok = score >= floor
                best.add(to[ok], ids[first + text[ok]], score[ok])

        return seek

    return scanned(docs, ["content"], queries, ["text"], at_once, lambda rows: _grams_of(rows, lambda t: _no_blank(stream.bigram_codes([t])[0])), look, KEYWORD, k)


def trigram(docs: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.35, at_once: int = 2_000) -> DataFrame:
    """Word similarity of each query to ``content_normalized``. A text is compared only with queries so many of whose trigrams it has that it can reach the floor, and
    the best of the task so far."""

    def look(what: tuple) -> Look:
        known, own = what
        begin, query = _holders(own, len(known))
        size = np.array([len(g) for g in own])

        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            for first, part in stream.slices(b.column(1)):
                grams = stream.Grams(part.to_pylist())
                at, which = stream.members(grams.gram, known)
                if not len(at):
                    continue
                has = np.unique(grams.text[at] * len(known) + which)
                text, gram = has // len(known), has % len(known)
                n = begin[gram + 1] - begin[gram]
                to = query[np.repeat(begin[gram] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                pair, shared = np.unique(to * grams.n + np.repeat(text, n), return_counts=True)
                for q in np.unique(pair // grams.n).tolist():
                    mine = slice(*np.searchsorted(pair, [q * grams.n, (q + 1) * grams.n]))
                    least = max(floor, best.least(q))
                    able = np.zeros(grams.n, dtype=bool)
                    able[pair[mine][shared[mine] >= (least - 1e-6) * size[q]] % grams.n] = True
                    mark = np.zeros(len(known), dtype=bool)
                    mark[own[q]] = True
                    hits = at[mark[which] & able[grams.text[at]]]
                    if not len(hits):
                        continue
                    rows, score = grams.similarity(int(size[q]), hits, np.full(grams.n, least - 1e-6))
                    score = half_up(score)
                    ok = score >= least
                    best.add(np.full(int(ok.sum()), q), ids[first + rows[ok]], score[ok])
                best.refresh()

        return seek

    return scanned(docs, ["content_normalized"], queries, ["text"], at_once, lambda rows: _grams_of(rows, lambda t: stream.trigram_codes([t])[0]), look, KEYWORD, k)


def _asked_grams(queries: DataFrame, kind: str, at_once: int) -> Iterator[DataFrame]:
    """(query_id, gram, n) of so many queries at a time, to be broadcast: n is how many grams the query has."""
    own = (lambda t: stream.trigram_codes([t])[0]) if kind == "trigram" else (lambda t: _no_blank(stream.bigram_codes([t])[0]))
    key = dict(queries.dtypes)["query_id"]

    def frame(rows: list[Row]) -> DataFrame:
        grams = [(r["query_id"], np.unique(own(r["text"])).astype(np.int64).tolist()) for r in rows if r["text"]]
        return queries.sparkSession.createDataFrame([(q, g, len(gs)) for q, gs in grams for g in gs], f"query_id {key}, gram long, n int")

    held: list[Row] = []
    empty = True
    for row in queries.select("query_id", "text").toLocalIterator():
        held.append(row)
        if len(held) == at_once:
            yield frame(held)
            held, empty = [], False
    if held or empty:
        yield frame(held)


def _shared(postings: DataFrame, queries: DataFrame, kind: str, floor: float, at_once: int) -> DataFrame:
    """(query_id, id, score): the share of the query's grams that a row has, where it reaches the floor. Postings of other grams aren't read."""
    out = None
    for asked in _asked_grams(queries, kind, at_once):
        wanted = sorted(r[0] for r in asked.select("gram").distinct().collect())  # at most at_once queries' grams
        rows = postings.where(F.col("gram").isin(wanted)) if len(wanted) <= 1000 else postings
        hit = rows.select("id", "gram").join(F.broadcast(asked), "gram").groupBy("query_id", "id").agg((F.count(F.lit(1)) / F.first("n")).alias("score")).where(F.round("score", 6) >= floor)
        out = hit if out is None else out.unionByName(hit)
    return out


def bigram_posted(postings: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.35, at_once: int = 2_000) -> DataFrame:
    """``bigram`` from stored postings (id, gram), without the texts."""
    return ranked(_shared(postings, queries, "bigram", floor, at_once), KEYWORD, k)


def trigram_posted(postings: DataFrame, docs: DataFrame, queries: DataFrame, k: int | None, floor: float = 0.35, at_once: int = 2_000) -> DataFrame:
    """``trigram``, of which only those texts are read that share enough trigrams with some query to reach the floor."""
    able = _shared(postings, queries, "trigram", floor - 1e-6, at_once).select("id").distinct()
    return trigram(docs.join(able, "id", "left_semi"), queries, k, floor, at_once)


def keyword(docs: DataFrame, queries: DataFrame, k: int | None, floor: float, cjk: bool = False, segments: Callable[[str], bool] = lambda _: False) -> DataFrame:
    """Bigrams for Chinese, Japanese and Korean queries if ``cjk`` and nothing segments their language; trigrams for the others."""
    by_bigram = [c for c in CJK_CODES if not segments(c)] if cjk else []
    if not by_bigram:
        return trigram(docs, queries, k, floor)
    is_cjk = F.coalesce(F.col("language").isin(by_bigram), F.lit(False))
    return bigram(docs, queries.where(is_cjk), k, floor).unionByName(trigram(docs, queries.where(~is_cjk), k, floor))


def _trees(rows: list[Row]) -> list[tuple[int, tsquery.Node]]:
    trees = ((n, tsquery.query_tree(r["built"] or "", r["text"] or "", r["config"] or "simple")) for n, r in enumerate(rows))
    return [(n, t) for n, t in trees if t is not None]


class _Asked:
    """The lexemes of query trees, and which queries ask for each."""

    def __init__(self, trees: list[tuple[int, tsquery.Node]]) -> None:
        wanted = {n: tsquery.terms(t) for n, t in trees}
        self.lexemes = sorted(set().union(*wanted.values()))
        self.number = {t: i for i, t in enumerate(self.lexemes)}
        self.holders: list[list[tuple[int, tsquery.Node]]] = [[] for _ in self.lexemes]
        for n, t in trees:
            for x in wanted[n]:
                self.holders[self.number[x]].append((n, t))

    def found(self, doc: dict[str, list[int]]) -> Iterator[tuple[int, float]]:
        """(query, rank) of the queries that a document with these lexemes matches."""
        asked: dict[int, tsquery.Node] = {}
        for t in doc:
            asked.update(self.holders[self.number[t]])
        where = {t: set(p) for t, p in doc.items()}
        return ((n, tsquery.rank(tree, doc)) for n, tree in asked.items() if tsquery.matches(tree, where))


def tsvector(docs: DataFrame, queries: DataFrame, k: int | None, at_once: int = 2_000) -> DataFrame:
    """Full text search by a query tree, ranked by cover density. queries: (query_id, text, built, config), built as ``synonyms.fts_query`` has it, or null;
    docs: (id, content_normalized, config). A document is stemmed by its own configuration, a query by its own. Of a slice of documents, each
    distinct word is stemmed once, and only documents with a query's words are looked at one by one."""

    def look(trees: list[tuple[int, tsquery.Node]]) -> Look:
        asked = _Asked(trees)

        def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
            if not asked.lexemes:
                return
            for first, part in stream.slices(b.column(1)):
                cps, begin = stream.codes([None if t is None else t.lower() for t in part.to_pylist()])
                start, end = stream.words(cps, begin)
                vocabulary, which = stream.vocabulary(cps, start, end)
                text = np.searchsorted(begin, start, side="right") - 1
                configs = b.column(2).slice(first, len(part)).fill_null("simple").to_pylist()
                lexeme = np.full(len(start), -1, dtype=np.int64)
                for config in dict.fromkeys(configs):
                    stemmer, stop = stem.of(config)
                    table = np.array([-1 if w in stop else asked.number.get(stemmer(w), -1) for w in vocabulary], dtype=np.int64)
                    own = np.array([c == config for c in configs])[text]
                    lexeme[own] = table[which[own]]
                hit = np.flatnonzero(lexeme >= 0)
                if not len(hit):
                    continue
                place = hit - np.searchsorted(text, text[hit]) + 1
                edges = np.append(np.flatnonzero(np.append(True, text[hit][1:] != text[hit][:-1])), len(hit))
                found: list[tuple[int, int, float]] = []
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    doc: dict[str, list[int]] = {}
                    for term, at in zip(lexeme[hit[x:y]].tolist(), place[x:y].tolist()):
                        doc.setdefault(asked.lexemes[term], []).append(at)
                    found += [(n, int(text[hit[x]]), score) for n, score in asked.found(doc)]
                if found:
                    q, t, s = zip(*found)
                    best.add(np.array(q), ids[first + np.array(t)], half_up(np.array(s)))

        return seek

    return scanned(docs, ["content_normalized", "config"], queries, ["text", "built", "config"], at_once, _trees, look, FTS, k)


def tsvector_posted(postings: DataFrame, queries: DataFrame, k: int | None, at_once: int = 2_000) -> DataFrame:
    """``tsvector`` from stored postings (lexeme, id, positions): only those of the queries' lexemes are read, and gathered by document, whose texts aren't needed."""
    out, held, empty = None, [], True

    def search(rows: list[Row]) -> DataFrame:
        lexemes = sorted(set().union(*(tsquery.terms(t) for _, t in _trees(rows))))
        kept = postings.where(F.col("lexeme").isin(lexemes)) if len(lexemes) <= 1000 else postings.join(F.broadcast(postings.sparkSession.createDataFrame([(t,) for t in lexemes], "lexeme string")), "lexeme", "left_semi")
        docs = kept.groupBy("id").agg(F.collect_list("lexeme").alias("lexemes"), F.collect_list("positions").alias("positions"))

        def look(trees: list[tuple[int, tsquery.Node]]) -> Look:
            asked = _Asked(trees)

            def seek(b: pa.RecordBatch, ids: np.ndarray, best: stream.Best) -> None:
                found = [(n, r, score) for r, (own, at) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) for n, score in asked.found(dict(zip(own, at)))]
                if found:
                    q, r, s = zip(*found)
                    best.add(np.array(q), ids[list(r)], half_up(np.array(s)))

            return seek

        part = queries.sparkSession.createDataFrame(rows, queries.select("query_id", "text", "built", "config").schema)
        return scanned(docs, ["lexemes", "positions"], part, ["text", "built", "config"], at_once, _trees, look, FTS, k)

    for row in queries.select("query_id", "text", "built", "config").toLocalIterator():
        held.append(row)
        if len(held) == at_once:
            out = search(held) if out is None else out.unionByName(search(held))
            held, empty = [], False
    if held or empty:
        out = search(held) if out is None else out.unionByName(search(held))
    return out


def tokenized(docs: DataFrame) -> DataFrame:
    """(grp, id, len, terms) of (id, content_normalized, language): the index group's documents and their words."""
    toks = docs.select("id", bm25_group_of(F.coalesce("language", F.lit(""))).alias("grp"), X.tokens(F.coalesce("content_normalized", F.lit(""))).alias("terms"))
    return toks.withColumn("len", F.size("terms")).where("len > 0")


def _asked_words(docs: DataFrame, words: list[str]) -> DataFrame:
    """(grp, id, len, term, n, total) of documents: for each of the words in a document how often (n) it stands there, and, with null term, for each index group the number of
    documents with words (n) and of these words (total), in parts."""
    kind, arrow_id = dict(docs.dtypes)["id"], to_arrow_type(docs.schema["id"].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        number = {w: n for n, w in enumerate(words)}
        totals: dict[str, list[int]] = {}
        schema = pa.schema([("grp", pa.string()), ("id", arrow_id), ("len", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64())])
        for b in batches:
            for first, part in stream.slices(b.column(1)):
                cps, begin = stream.codes([None if t is None else t.lower() for t in part.to_pylist()])
                start, end = stream.words(cps, begin)
                vocabulary, which = stream.vocabulary(cps, start, end)
                text = np.searchsorted(begin, start, side="right") - 1
                size = np.bincount(text, minlength=len(part))
                groups = b.column(2).slice(first, len(part)).to_pylist()
                for g, n in zip(groups, size.tolist()):
                    if n:
                        t = totals.setdefault(g, [0, 0])
                        t[0], t[1] = t[0] + 1, t[1] + n
                term = np.array([number.get(w, -1) for w in vocabulary], dtype=np.int64)[which] if len(which) else which
                hit = np.flatnonzero(term >= 0)
                if len(hit):
                    pair, tf = np.unique(text[hit] * len(words) + term[hit], return_counts=True)
                    rows, own = pair // len(words), (pair % len(words)).tolist()
                    at = pa.array(first + rows)
                    yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(0).take(at), pa.array(size[rows].astype(np.int32)), pa.array([words[x] for x in own]), pa.array(tf.astype(np.int64)), pa.nulls(len(own), pa.int64())], schema=schema)
        if totals:
            names, counted = list(totals), list(totals.values())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), arrow_id), pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.string()), pa.array([c[0] for c in counted], pa.int64()), pa.array([c[1] for c in counted], pa.int64())], schema=schema)

    return docs.select("id", "content_normalized", bm25_group_of(F.coalesce("language", F.lit("")))).mapInArrow(run, f"grp string, id {kind}, len int, term string, n long, total long")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, k1: float = 1.2, b: float = 0.75, tokens: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 of a flat list of terms over the documents of the query language's index group, with statistics over all of that group.

    docs: (id, content_normalized, language); queries: (query_id, text, language). ``tokens`` takes ``tokenized(docs)`` where it is stored; else the texts are read once, and what
    the queries' words and the statistics come to is written to the shared folder. The words of documents that no query asks for are dropped where they are read."""
    if tokens is None:
        words = queries.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("w")).distinct().limit(BROADCAST_ROWS + 1).collect()
        if len(words) <= BROADCAST_ROWS:
            path, found = shared_folder(docs.sparkSession, "words"), _asked_words(docs, [r["w"] for r in words])
            found.write.parquet(path)
            found = docs.sparkSession.read.schema(found.schema).parquet(path)
            stats = found.where("term is null").groupBy("grp").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avg_len"))
            hits = found.where("term is not null").select("grp", "id", "len", "term", F.col("n").alias("tf"))
            return _bm25(stats, lambda wanted: hits.join(wanted, ["grp", "term"], "left_semi"), queries, k, k1, b)
    toks = tokens if tokens is not None else tokenized(docs)
    return _bm25(toks.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")), lambda wanted: toks.select("grp", "id", "len", F.explode("terms").alias("term")).join(wanted, ["grp", "term"], "left_semi").groupBy("grp", "id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), queries, k, k1, b)


def bm25_posted(postings: DataFrame, rows: DataFrame, queries: DataFrame, k: int | None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``bm25`` from stored postings (grp, term, id, tf, len) and, for the statistics, the store's rows (fts_group, n_terms); no text is read."""
    stats = rows.where("n_terms > 0").groupBy(F.col("fts_group").alias("grp")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_len"))
    words = [r["w"] for r in queries.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("w")).distinct().limit(1001).collect()]
    postings = postings.where(F.col("term").isin(words)) if len(words) <= 1000 else postings  # those of other words aren't read
    return _bm25(stats, lambda wanted: postings.select("grp", "id", "len", "term", "tf").join(wanted, ["grp", "term"], "left_semi"), queries, k, k1, b)


def _bm25(stats: DataFrame, posted_of: Callable[[DataFrame], DataFrame], queries: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    asked = queries.select("query_id", bm25_group_of(F.coalesce("language", F.lit(""))).alias("grp"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    to_all = F.broadcast if few else (lambda df: df)  # what follows has no more rows than asked
    posted = posted_of(to_all(asked.select("grp", "term").distinct()))
    df = posted.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, ["grp", "term"]).join(F.broadcast(stats), "grp").withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hit = posted.join(to_all(weights), ["grp", "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hit.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return ranked(scored.where(F.round("score", 6) > 0), FTS, k)


def search_legs(parts: dict[str, Callable[[], DataFrame]], eager: bool = False) -> DataFrame:
    """All legs in one frame. Legs that can't be built fail the search, with the names and messages of all that failed. With ``eager``, each leg is run as a job of its
    own, all at once, and its few rows are written to the shared folder; so legs that fail while they run are named as well."""
    made, failed = {}, []

    def run(name: str, build: Callable[[], DataFrame]) -> None:
        try:
            leg = build()
            if eager:
                path, kind = shared_folder(leg.sparkSession, "leg"), leg.schema
                leg.write.parquet(path)
                leg = leg.sparkSession.read.schema(kind).parquet(path)
            made[name] = leg
        except Exception as e:  # noqa: BLE001 - every leg is to be reported
            failed.append((name, e))

    if eager:
        with ThreadPoolExecutor(len(parts)) as pool:
            list(pool.map(lambda x: run(*x), parts.items()))
    else:
        for name, build in parts.items():
            run(name, build)
    if failed:
        failed.sort(key=lambda x: list(parts).index(x[0]))
        raise LegError(f"{len(failed)} of {len(parts)} search legs failed ({'; '.join(f'{n}: {e}' for n, e in failed)})") from failed[0][1]
    out, *rest = (made[n] for n in parts)
    for m in rest:
        out = out.unionByName(m)
    return out
