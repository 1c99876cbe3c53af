"""Keeping the store up to date from a stream of changed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunker import Chunker
from ..plans.indexing import chunks_of, latest
from ..sources.providers import Embedder
from ..sources.store import KEY, DocumentStore


def apply_changes(store: DocumentStore, changes: DataFrame, chunker: Chunker, embedder: Embedder | None, version: str = "version") -> None:
    """The last change of each source in a batch takes effect: its chunks are replaced, or removed where its text is null. Doing it twice does no harm."""
    last = latest(changes, version).persist()
    try:
        if not last.isEmpty():
            store.replace_sources(last.select(*KEY), chunks_of(last.where(F.col("text").isNotNull()), chunker, embedder))
    finally:
        last.unpersist()


def run(changes: DataFrame, store: DocumentStore, chunker: Chunker, embedder: Embedder | None, checkpoint: str, version: str = "version", late: tuple[str, str] | None = None, **trigger) -> StreamingQuery:
    """Starts the stream (tenant_id, source_type, source_id, text, language, metadata, version). ``late``: (event time column, delay) of changes
    that come too late to count, as duplicates of a version within the delay do."""
    if late is not None:
        changes = changes.withWatermark(*late).dropDuplicatesWithinWatermark([*KEY, version])
    write = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_changes(store, batch, chunker, embedder, version))
    return (write.trigger(**trigger) if trigger else write).start()
