"""From sources to chunks in the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X
from ..operators.chunker import Chunker, chunk_frame
from ..sources.providers import Embedder, embedded
from ..sources.store import KEY, DocumentStore


def chunks_of(sources: DataFrame, chunker: Chunker, embedder: Embedder | None, fold: bool = True, segmented: bool = False) -> DataFrame:
    """Rows for the store from sources (tenant_id, source_type, source_id, text, language, metadata)."""
    keyed = sources.withColumn("id", F.to_json(F.struct(*KEY)))
    made = chunk_frame(keyed, chunker, segmented).withColumnRenamed("id", "_key")
    rows = made.join(keyed.select(F.col("id").alias("_key"), *KEY, F.coalesce("language", F.lit("en")).alias("language"), "metadata"), "_key").drop("_key")
    rows = rows.withColumn("chunk_index", F.col("chunk_index").cast("string"))
    rows = rows.withColumn("content_normalized", X.normalize_for(F.col("content"), F.col("language")) if fold else F.col("content"))
    return rows if embedder is None else embedded(rows, "content", embedder)


def index_sources(store: DocumentStore, sources: DataFrame, chunker: Chunker, embedder: Embedder | None, **how) -> int:
    """Replaces each source's chunks by those of its text; a source whose text gives none keeps what it has. The version then in force."""
    rows = chunks_of(sources, chunker, embedder, **how).persist()
    try:
        if rows.isEmpty():
            return store.version()
        return store.replace_sources(rows.select(*KEY).distinct(), rows)
    finally:
        rows.unpersist()


def latest(changes: DataFrame, version: str) -> DataFrame:
    """The last change of each source."""
    order = Window.partitionBy(*KEY).orderBy(F.desc(version), "text")
    return changes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def build_corpus(faq: DataFrame, pages: DataFrame, chunker: Chunker, clean: Callable[[DataFrame], DataFrame], with_question: bool = False) -> DataFrame:
    """(chunk_id, doc_id, source, content) of FAQ answers (doc_id, question, answer) and page texts (doc, page, text)."""
    text = F.concat_ws("\n", "question", "answer") if with_question else F.col("answer")
    one = faq.select(F.col("doc_id").alias("id"), text.alias("text"), F.lit("faq").alias("source"))
    two = clean(pages).select(F.col("doc").alias("id"), "text", F.lit("pdf").alias("source"))
    docs = one.unionByName(two).withColumn("language", F.lit(None).cast("string"))
    made = chunk_frame(docs, chunker).join(docs.select("id", "source"), "id")
    return made.select(F.concat_ws("#", "id", F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("id").alias("doc_id"), "source", "content")
