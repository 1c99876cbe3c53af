"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression over sparse text features.

Features of a document are its words and the words' first few letters, as 1 + log(occurrences). One weight a feature is shared
by all thresholds: P(grade >= j) = sigmoid(w.x - theta_j), theta_1 < theta_2 < ..., and the expected severity is the sum of
these over j. Labels above 1 are grades, up to ``grades``. Where labels only say toxic or not, grade 0 is not toxic, and toxic rows are graded 1 to ``grades`` by how many of
their words bear features that screening finds typical of toxic rows (quantiles of that count among the toxic rows).
Screening keeps features that at least ``least_rows`` toxic rows of the sample have, and of these the ``most_features`` with the largest likelihood ratio.

The model is fitted on at most about ``sample_rows`` labelled rows, chosen by a hash of doc_id; scoring covers whole texts
of all rows where they are read, and shuffles nothing.

Defined results: a null or empty text has no features, hence the severity of a text without evidence; without both toxic and
other labelled rows nothing is learnt and every severity is 0; labels that are null or lack a document are left out, and a
document labelled twice has the highest of its labels; negative labels count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import mix_int, slices, tidied, words


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000
    prefixes: tuple[int, ...] = (4, 5, 6)
    least_rows: int = 4  # toxic rows that must have a feature
    most_features: int = 2_000  # the best by likelihood ratio go into the regression
    least_odds: float = 20.0  # of features that grade the toxic rows
    grades: int = 3
    l1: float = 1e-5
    steps: int = 2_500
    reject: float = 0.5  # documents go whose P(grade >= 1) is this or more


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def severity(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each j, as columns."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -60, 60)))


def _features(w, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, features of these words), for whole words and for each length of prefixes."""
    yield np.arange(len(w.hash)), w.hash
    length = w.end - w.start
    for n in p.prefixes:
        at = np.flatnonzero(length > n)
        yield at, w.span_hash(w.start[at], w.start[at] + n) ^ np.uint64(mix_int(n))


def counts(texts: pa.Array, known: np.ndarray, p: Params) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: first row, rows, then row, feature index and occurrences of known features, and row and feature index by word."""
    gate = np.zeros(1 << 16, dtype=bool)
    gate[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    for at, part in slices(texts):
        w = words(part)
        word, feature = [], []
        for i, h in _features(w, p):
            if len(known):
                may = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
                k = np.minimum(np.searchsorted(known, h[may]), len(known) - 1)
                ok = known[k] == h[may]
                word.append(i[may[ok]])
                feature.append(k[ok])
        word_, feature_ = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (word, feature))
        row = np.searchsorted(w.first, word_, side="right") - 1
        both, n = np.unique(row * max(1, len(known)) + feature_, return_counts=True)
        yield at, len(part), both // max(1, len(known)), both % max(1, len(known)), n, word_, feature_


def _labelled(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.greatest(F.lit(0), F.max(F.col("toxic").cast("int"))).alias("_toxic"))
    n = one.count()
    share = min(1.0, p.sample_rows / max(1, n))
    # the rest of a division by a prime is enough of a lottery, and the bound of the sample bounds what is broadcast
    picked = one.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + (share == 1.0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "_toxic")


def _screen(rows: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(features, whether they grade): the features most typical of toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.minimum(b.column(1).to_numpy(), 1)
            for at, part in slices(b.column(0)):
                w = words(part)
                doc = w.doc_of()
                hs, ds = zip(*((h, doc[i]) for i, h in _features(w, p)))
                h, d = np.concatenate(hs), np.concatenate(ds)
                by = np.lexsort((d, h))
                h, d = h[by], d[by]
                new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, dtype=bool)
                h, t = h[new], toxic[at + d[new]]
                if len(h):
                    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    bad = np.add.reduceat(t, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(np.diff(np.append(starts, len(h))) - bad)], names=["f", "bad", "good"])

    total = rows.agg(F.sum(F.least("_toxic", F.lit(1))).alias("bad"), F.count("_toxic").alias("n")).first()
    bad, good = total["bad"] or 0, (total["n"] or 0) - (total["bad"] or 0)
    if not bad or not good:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    f = rows.mapInArrow(tidied(run), "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pb, pg = F.col("bad") / bad, (F.col("good") + 0.5) / (good + 1)
    base = (F.col("bad") + F.col("good")) / (bad + good)
    ratio = F.col("bad") * F.log(pb / base) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / good / base)).otherwise(0.0)
    top = f.where(F.col("bad") >= p.least_rows).withColumn("odds", pb / pg).where("odds > 2").withColumn("g", ratio).orderBy(F.desc("g"), "f").limit(p.most_features).collect()
    features = np.array([r["f"] for r in top], dtype=np.int64).view(np.uint64)
    by = np.argsort(features)
    return features[by], np.array([r["odds"] >= p.least_odds for r in top], dtype=bool)[by]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows = _labelled(docs, labels, p).cache()
    try:
        known, strong = _screen(rows, p)
        if not len(known):
            return Model()
        lookup = rows.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, n, row, f, c, word, wf in counts(b.column(0), lookup.value, p):
                    marked = np.unique(word[strong[wf]])
                    w = np.zeros(n, dtype=np.int32)
                    if len(marked):
                        first = words(b.column(0).slice(at, n)).first
                        w += np.bincount(np.searchsorted(first, marked, side="right") - 1, minlength=n).astype(np.int32)
                    ends = np.searchsorted(row, np.arange(n + 1))
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(at, n).cast(pa.int32()), pa.array(w), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32()))], names=["toxic", "marked", "f", "n"])

        data = rows.mapInArrow(tidied(run), "toxic int, marked int, f array<int>, n array<int>").collect()
    finally:
        rows.unpersist()
    data.sort(key=lambda r: (r["toxic"], r["marked"], r["f"], r["n"]))  # the fit doesn't hang on the order of partitions
    toxic, marked = np.array([r["toxic"] for r in data]), np.array([r["marked"] for r in data])
    bounds = np.quantile(marked[toxic > 0], np.arange(1, p.grades) / p.grades, method="higher")
    grade = np.minimum(toxic, p.grades) if (toxic > 1).any() else np.where(toxic > 0, 1 + (marked[:, None] > bounds[None, :]).sum(axis=1), 0)
    row = np.repeat(np.arange(len(data)), [len(r["f"]) for r in data])
    col = np.array([x for r in data for x in r["f"]], dtype=np.int64)
    val = 1 + np.log(np.array([x for r in data for x in r["n"]], dtype=float))
    w, cuts = ordinal(row, col, val, grade, len(known), p.grades, p.l1, p.steps)
    used = np.flatnonzero(w)
    return Model(known[used], w[used], cuts)


def ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, features: int, grades: int, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a proportional-odds model with an L1 penalty; by Adam with proximal steps over all rows."""
    n = len(grade)
    share = np.array([np.clip((grade >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, grades + 1)])
    cuts = np.maximum.accumulate(np.log((1 - share) / share)) + np.arange(grades) * 1e-3
    w, at = np.zeros(features), np.arange(n)
    m, v = np.zeros(features + grades), np.zeros(features + grades)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], minlength=n)
        s = np.ones((n, grades + 2))
        s[:, -1] = 0
        s[:, 1:-1] = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -60, 60)))
        a, b = s[at, grade], s[at, grade + 1]
        prob = np.maximum(a - b, 1e-12)
        up = 1 - a - b
        g = np.empty(features + grades)
        g[:features] = -np.bincount(col, val * up[row], minlength=features) / n
        down = np.bincount(grade, a * (1 - a) / prob, minlength=grades + 1)[1:]
        rise = np.bincount(grade, b * (1 - b) / prob, minlength=grades + 1)[:-1]
        g[features:] = (down - rise) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - t / (steps + 1)))
        move = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = move * m / (1 - 0.9**t)
        w = w - step[:features]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(move[:features], 50.0) * l1, 0)
        cuts = np.maximum.accumulate(cuts - step[features:] + np.arange(grades) * 1e-6)
    return w, cuts


def _z(texts: pa.Array, model: Model, p: Params) -> np.ndarray:
    z = np.zeros(len(texts))
    for at, n, row, f, c, _, _ in counts(texts, model.features, p):
        z[at : at + n] = np.bincount(row, (1 + np.log(c)) * model.weights[f], minlength=n)
    return z


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, expected_severity, severity, toxic) of every document; severity is the most probable grade."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = known.value.severity(_z(b.column(1), known.value, p))
            edge = np.concatenate([np.ones((len(s), 1)), s, np.zeros((len(s), 1))], axis=1)
            grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
            bad = s[:, 0] >= p.reject if s.shape[1] else np.zeros(len(s), dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(bad)], names=["doc_id", "expected_severity", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, expected_severity double, severity int, toxic boolean")


def reject(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """The documents, in all their columns, that are not toxic."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = known.value.severity(_z(b.column(text_at), known.value, p))
            yield b.filter(pa.array(s[:, 0] < p.reject)) if s.shape[1] else b

    return docs.mapInArrow(tidied(run), docs.schema)
