"""The hybrid search: three legs, fused, cut off and, if wanted, reranked; for a frame of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import synonyms as S, text as X
from ..functions.languages import fts_config_of
from ..operators import fusion, legs, rerank as R


class Span(Protocol):
    def set(self, name: str, value: object) -> None: ...


class Tracer(Protocol):
    """Whoever wants to know what a search does: ``span`` is a context that gives a Span."""

    def span(self, name: str): ...


class NoTracer:
    @contextmanager
    def span(self, name: str) -> Iterator[Span]:
        yield self

    def set(self, name: str, value: object) -> None:
        pass


class TextSearch(Protocol):
    """How the text-search leg builds its query and finds rows: queries come with ``query_id``, ``text``, ``built`` and ``language``."""

    def build(self, query: str, lookup: S.Lookup) -> str: ...

    def leg(self, docs: DataFrame, queries: DataFrame, k: int, stemming: bool) -> DataFrame: ...


class TsvectorSearch:
    def build(self, query: str, lookup: S.Lookup) -> str:
        return S.fts_query(query, lookup)

    def leg(self, docs: DataFrame, queries: DataFrame, k: int, stemming: bool) -> DataFrame:
        simple = F.lit("simple")
        docs = docs.withColumn("config", fts_config_of(F.col("language")) if stemming else simple)
        return legs.tsvector(docs, queries.withColumn("config", fts_config_of(F.col("language")) if stemming else simple), k)


class Bm25Search:
    def build(self, query: str, lookup: S.Lookup) -> str:
        return S.bm25_query(query, lookup) if lookup else query

    def leg(self, docs: DataFrame, queries: DataFrame, k: int, stemming: bool) -> DataFrame:
        return legs.bm25(docs, queries.select("query_id", F.col("built").alias("text"), "language"), k)


TEXT_SEARCH: dict[str, TextSearch] = {"tsvector": TsvectorSearch(), "bm25": Bm25Search()}


@dataclass(frozen=True)
class SearchOptions:
    """None stands for the default throughout."""

    top_k: int = 5
    vector_min_score: float = 0.8
    keyword_min_score: float = 0.35
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    fts_weight: float = 1.0
    rrf_k: float = 60
    candidate_multiplier: int = 2
    fusion: str = "rrf"
    normalizer: str = "minmax"
    min_relevance: float | None = None
    rerank: bool = False
    rerank_candidates: int | None = None
    rerank_min_relative: float = 0.01
    rerank_min_score: float = 0.0
    language: str | None = None
    languages: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    text_search: str | TextSearch = "tsvector"  # or "bm25", or a strategy of one's own
    cjk: bool = False
    stemming: bool = True
    eager: bool = False  # run each leg as a job of its own, so that a failure is known by its leg's name

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) is None:
                object.__setattr__(self, f.name, f.default)

    def query_language(self) -> str:
        """The language given, or the only one that is searched; fails before anything is read if there is neither."""
        if self.language:
            return self.language
        if len(self.languages) == 1:
            return self.languages[0]
        raise ValueError("the query's language is needed: set language, or a single one in languages")


def prepare(queries: DataFrame, o: SearchOptions, stop_words: list[str] | None = None, normalizer: Callable[[Column], Column] | None = None, segmenter=None, fold: bool = True) -> DataFrame:
    """Adds ``natural``, for embedding and reranking, and ``lexical``, for the other legs. A step that leaves nothing is undone."""
    language = o.query_language()
    q = queries.withColumn("natural", X.clean_query(F.coalesce("text", F.lit(""))))
    if normalizer is not None:
        q = q.withColumn("natural", X.or_before(normalizer(F.col("natural")), F.col("natural")))
    q = q.withColumn("lexical", F.col("natural"))
    if fold:
        q = q.withColumn("lexical", X.or_before(X.normalize_for(F.col("lexical"), F.lit(language)), F.col("lexical")))
    if segmenter is not None and segmenter.segments_language(language):

        @F.pandas_udf(T.StringType())
        def segment(s: pd.Series) -> pd.Series:
            return s.map(lambda t: segmenter.segment(t, language))

        q = q.withColumn("lexical", X.or_before(segment(F.col("lexical")), F.col("lexical")))
    if stop_words:
        q = q.withColumn("lexical", X.or_before(X.remove_stop_words(F.col("lexical"), F.array(*map(F.lit, stop_words))), F.col("lexical")))
    return q


def _built(lookup: S.Lookup, build: Callable[[str, S.Lookup], str]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: build(t, lookup))

    return run


def search(docs: DataFrame, queries: DataFrame, o: SearchOptions = SearchOptions(), *, lookup: S.Lookup | None = None, stop_words: list[str] | None = None, normalizer=None, segmenter=None, embed: Callable[[DataFrame, str], DataFrame] | None = None, scorer: R.Scorer | None = None, fold: bool = True, tracer: Tracer = NoTracer()) -> DataFrame:
    """(query_id, rank, id, score, content, source_type, source_id, metadata) of queries (query_id, text, embedding), best first.

    docs: (id, content, content_normalized, source_type, source_id, language, metadata, embedding). ``embed`` adds the embedding where
    queries don't bring it. Texts and metadata are joined to the results only."""
    with tracer.span("search") as span:
        language = o.query_language()
        found = legs.in_filters(docs, list(o.source_types), list(o.source_ids), list(o.languages))
        strategy = TEXT_SEARCH[o.text_search] if isinstance(o.text_search, str) else o.text_search
        active = o.rerank and scorer is not None
        for name, value in {"language": language, "top_k": o.top_k, "fusion": o.fusion, "text_search": type(strategy).__name__, "rerank": active, "synonyms": bool(lookup), "stop_words": bool(stop_words), "segmented": segmenter is not None and segmenter.segments_language(language)}.items():
            span.set(name, value)
        with tracer.span("prepare"):
            q = prepare(queries, o, stop_words, normalizer, segmenter, fold)
            if "embedding" not in q.columns:
                if embed is None:
                    raise ValueError("queries have no embedding, and there is nothing that makes it")
                q = embed(q, "natural")
            q = q.withColumn("built", _built(lookup or {}, strategy.build)(F.col("lexical"))).withColumn("language", F.lit(language))
        limit = o.top_k * o.candidate_multiplier
        parts = {
            "vector": lambda: legs.vector_batch(found, q, limit, o.vector_min_score),
            "keyword": lambda: legs.keyword(found, q.select("query_id", F.col("lexical").alias("text"), "language"), limit, o.keyword_min_score, o.cjk, segmenter.segments_language if segmenter else lambda _: False),
            "fts": lambda: strategy.leg(found, q.select("query_id", "text", "built", "language"), limit, o.stemming),
        }
        with tracer.span("legs"):
            all_ = legs.search_legs(parts, o.eager)
        with tracer.span("fuse"):
            fused = fusion.fuse(all_, o.fusion, o.rrf_k, (o.vector_weight, o.keyword_weight, o.fts_weight), o.normalizer, fusion.fused_limit(o.top_k, active, o.rerank_candidates))
            fused = fusion.min_relevance(fused, o.min_relevance)
        payload = docs.select("id", "content", "source_type", "source_id", X.parse_metadata(F.coalesce("metadata", F.lit("{}"))).alias("metadata"))
        if active:
            with tracer.span("rerank"):
                asked = fused.join(payload.select("id", "content"), "id").join(q.select("query_id", F.col("natural").alias("query")), "query_id")
                fused = R.rerank(asked, scorer, o.top_k, o.rerank_min_relative, o.rerank_min_score)
        return fused.join(payload, "id").select("query_id", "rank", "id", "score", "content", "source_type", "source_id", "metadata")
