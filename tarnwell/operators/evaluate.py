"""Retrieval quality with one relevant document a query. Outcomes are (ranked: array of doc ids, target, any attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MEASURES = ("recall_1", "recall_3", "recall_5", "recall_10", "mrr_10", "ndcg_10")


def _position(ranked: Column, target: Column, k: int) -> Column:
    return F.coalesce(F.array_position(F.slice(ranked, 1, k), target), F.lit(0)).cast("int")


def recall_at(ranked: Column, target: Column, k: int) -> Column:
    return (_position(ranked, target, k) > 0).cast("double")


def reciprocal_rank(ranked: Column, target: Column, k: int = 10) -> Column:
    p = _position(ranked, target, k)
    return F.when(p > 0, 1 / p).otherwise(0.0)


def ndcg_at(ranked: Column, target: Column, k: int = 10) -> Column:
    p = _position(ranked, target, k)
    return F.when(p > 0, 1 / F.log2(p + F.lit(1.0))).otherwise(0.0)


def measured(outcomes: DataFrame) -> DataFrame:
    r, t = F.col("ranked"), F.col("target")
    each = {f"recall_{k}": recall_at(r, t, k) for k in (1, 3, 5, 10)} | {"mrr_10": reciprocal_rank(r, t), "ndcg_10": ndcg_at(r, t)}
    return outcomes.withColumns(each)


def _means() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in MEASURES)]


def summarize(outcomes: DataFrame) -> DataFrame:
    """One row: how many outcomes, and the means; zeros if there are none."""
    return measured(outcomes).agg(*_means())


def slices(outcomes: DataFrame, *attributes: str) -> DataFrame:
    """The summary for each value of each attribute, and over all, in one pass: (attribute, value, n, means...)."""
    rows = measured(outcomes)
    pairs = F.array(F.struct(F.lit("all").alias("attribute"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))
    return rows.select(F.explode(pairs).alias("s"), *MEASURES).select("s.*", *MEASURES).groupBy("attribute", "value").agg(*_means())


def outcomes(ranking: DataFrame, chunks: DataFrame, qrels: DataFrame) -> DataFrame:
    """From a ranking (query_id, rank, id), the chunks' documents (id, doc_id) and qrels (query_id, target, ...); queries without results have none ranked."""
    told = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    found = ranking.join(chunks.select("id", "doc_id"), "id").groupBy("query_id").agg(told.alias("ranked"))
    kind = dict(found.dtypes)["ranked"]
    return qrels.join(found, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(kind)))


def resolve(qrels: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries whose target is in the corpus, the others)."""
    known = corpus.select(F.col("doc_id").alias("target")).distinct()
    return qrels.join(known, "target", "left_semi"), qrels.join(known, "target", "left_anti")


def embed_distinct(rows: DataFrame, text: str, embed) -> DataFrame:
    """Adds ``embedding``; ``embed`` (frame with the text column -> the same with embedding) sees each distinct text once."""
    return rows.join(embed(rows.select(text).distinct()), text, "left")
