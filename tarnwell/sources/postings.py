"""Index tables of the chunk store: for each data folder what the legs look up, sorted so that a reader skips what it doesn't ask for.

``trigram`` and ``bigram``: (gram, id), the grams as the numbers of ``functions.stream``; ``term``: (grp, term, id, tf, len) as BM25 needs it; ``lexeme``: (config, lexeme, id,
positions), stems with their places; ``code``: (id, code, factor), vectors as signs of random rotations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import rotation, stem, stream

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _schema(**more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in {"tenant_id": _STRING, "id": _STRING, "_version": _LONG, **more}.items()])


SCHEMAS = {
    "trigram": _schema(gram=_LONG),
    "bigram": _schema(gram=_LONG),
    "term": _schema(grp=_STRING, term=_STRING, tf=_LONG, len=_INT),
    "lexeme": _schema(config=_STRING, lexeme=_STRING, positions=T.ArrayType(_INT)),
    "code": _schema(dim=_INT, code=T.BinaryType(), factor=T.FloatType()),
}


def _names(kind: str) -> list[str]:
    return SCHEMAS[kind].names


def _grams(rows: DataFrame, kind: str) -> DataFrame:
    """Distinct grams of each row."""
    of = stream.trigram_codes if kind == "trigram" else stream.bigram_codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in stream.slices(b.column(3)):
                gram, text = of(part.to_pylist())
                if kind == "bigram" and len(part) < 1 << 21:  # both fit in one number, which sorts faster
                    key = np.unique(text.astype(np.uint64) << np.uint64(42) | gram)
                    gram, text = key & np.uint64((1 << 42) - 1), (key >> np.uint64(42)).astype(np.int64)
                else:
                    order = np.lexsort((gram, text))
                    gram, text = gram[order], text[order]
                    new = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])) if len(gram) else np.zeros(0, dtype=bool)
                    gram, text = gram[new], text[new]
                to = pa.array(at + text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(to), b.column(1).take(to), b.column(2).take(to), pa.array(gram.astype(np.int64))], names=_names(kind))

    text = F.col("content") if kind == "bigram" else F.coalesce("content_normalized", "content")
    return rows.select("tenant_id", "id", "_version", text).mapInArrow(run, SCHEMAS[kind])


def _lexemes(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in stream.slices(b.column(4)):
                cps, begin = stream.codes([None if t is None else t.lower() for t in part.to_pylist()])
                start, end = stream.words(cps, begin)
                vocabulary, which = stream.vocabulary(cps, start, end)
                text = np.searchsorted(begin, start, side="right") - 1
                place = np.arange(len(text)) - np.searchsorted(text, text) + 1
                configs = b.column(3).slice(at, len(part)).fill_null("simple").to_pylist()
                for config in dict.fromkeys(configs):
                    stemmer, stop = stem.of(config)
                    stems: dict[str, int] = {}
                    table = np.array([-1 if w in stop else stems.setdefault(stemmer(w), len(stems)) for w in vocabulary], dtype=np.int64)
                    own = np.flatnonzero(np.array([c == config for c in configs])[text]) if len(text) else text
                    lexeme = table[which[own]] if len(own) else own
                    own, lexeme = own[lexeme >= 0], lexeme[lexeme >= 0]
                    order = np.lexsort((place[own], lexeme, text[own]))
                    own, lexeme = own[order], lexeme[order]
                    if not len(own):
                        continue
                    first = np.flatnonzero(np.append(True, (lexeme[1:] != lexeme[:-1]) | (text[own][1:] != text[own][:-1])))
                    to, names = pa.array(at + text[own][first]), list(stems)
                    ends = pa.array(np.append(first, len(own)).astype(np.int32))
                    columns = [b.column(0).take(to), b.column(1).take(to), b.column(2).take(to), pa.array([config] * len(first)), pa.array([names[k] for k in lexeme[first].tolist()]), pa.ListArray.from_arrays(ends, pa.array(place[own].astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(columns, names=_names("lexeme"))

    return rows.select("tenant_id", "id", "_version", "config", F.coalesce("content_normalized", "content")).mapInArrow(run, SCHEMAS["lexeme"])


def codes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., dim, code, factor) of rows (keep..., embedding); vectors without a direction have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                for own, x in stream.matrices(part.column(len(keep))):
                    norm = np.sqrt((x * x).sum(axis=1))
                    ok = np.isfinite(norm) & (norm > 0)
                    own, x = own[ok], x[ok] / norm[ok, None]
                    if len(own):
                        bits, factor = rotation.code(x)
                        to = pa.array(own)
                        columns = [part.column(k).take(to) for k in range(len(keep))] + [pa.array(np.full(len(own), x.shape[1], dtype=np.int32)), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()), pa.array(factor, pa.float32())]
                        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "dim", "code", "factor"])

    kind = T.StructType([*(rows.schema[c] for c in keep), *SCHEMAS["code"].fields[3:]])
    return rows.select(*keep, "embedding").mapInArrow(run, kind)


def _terms(rows: DataFrame) -> DataFrame:
    """The words of each row with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in stream.slices(b.column(5)):
                cps, begin = stream.codes([None if t is None else t.lower() for t in part.to_pylist()])
                start, end = stream.words(cps, begin)
                vocabulary, which = stream.vocabulary(cps, start, end)
                if not vocabulary:
                    continue
                text = np.searchsorted(begin, start, side="right") - 1
                pair, tf = np.unique(text * len(vocabulary) + which, return_counts=True)
                to = pa.array(at + pair // len(vocabulary))
                term = pa.array(vocabulary).take(pa.array(pair % len(vocabulary)))
                columns = [*(b.column(k).take(to) for k in range(4)), term, pa.array(tf.astype(np.int64)), b.column(4).take(to)]
                yield pa.RecordBatch.from_arrays(columns, names=_names("term"))

    return rows.select("tenant_id", "id", "_version", "fts_group", "n_terms", F.coalesce("content_normalized", "content")).mapInArrow(run, SCHEMAS["term"])


def build(kind: str, rows: DataFrame) -> DataFrame:
    """The index of a data folder's rows, sorted within its files by what is looked up. A file belongs to a part of the rows and holds whatever they have; nothing is shuffled,
    and a reader skips most of each file."""
    if kind in ("trigram", "bigram"):
        return _grams(rows, kind).sortWithinPartitions("gram")
    if kind == "term":
        return _terms(rows).sortWithinPartitions("term")
    if kind == "lexeme":
        return _lexemes(rows).sortWithinPartitions("lexeme")
    return codes(rows, ["tenant_id", "id", "_version"])
