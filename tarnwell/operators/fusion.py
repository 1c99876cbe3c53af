"""Fusing ranked legs. A leg is (query_id, leg, rank, id, score), rank from 1; legs are numbered in the order in which they are added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LEGS = ("vector", "keyword", "fts")


def _weight(weights: Sequence[float]) -> Column:
    out = F.lit(1.0)
    for k, w in enumerate(weights):
        out = F.when(F.col("leg") == k, float(w)).otherwise(out)
    return out


def _fused(parts: DataFrame, top_k: int | None) -> DataFrame:
    """Sums the parts of each id in the order of legs and ranks; ties go to what was seen first."""
    seen = F.sort_array(F.collect_list(F.struct("leg", "rank", "part")))
    total = F.aggregate("seen", F.lit(0.0), lambda a, x: a + x["part"])
    out = parts.groupBy("query_id", "id").agg(seen.alias("seen")).select("query_id", "id", total.alias("score"), F.col("seen")[0]["leg"].alias("_leg"), F.col("seen")[0]["rank"].alias("_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_leg", "_rank", "id")
    out = out.withColumn("rank", F.row_number().over(order))
    out = out if top_k is None else out.where(F.col("rank") <= top_k)
    return out.select("query_id", "rank", "id", "score")


def rrf(legs: DataFrame, k: float = 60, weights: Sequence[float] = (1.0, 1.0, 1.0), top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: weight / (k + rank), summed. A weight of 0 leaves a leg's ids in, with 0; a leg without weight has 1."""
    return _fused(legs.withColumn("part", _weight(weights) / (F.lit(float(k)) + F.col("rank"))), top_k)


def normalized(legs: DataFrame, normalizer: str = "minmax") -> DataFrame:
    """Adds ``norm``: within each query's leg, the score's place between the least and the largest (1 if they are equal), or its share of the
    leg's Euclidean length (0 if that is 0). A score that is missing, NaN or infinite counts as 0."""
    w = Window.partitionBy("query_id", "leg")
    s = F.col("score").cast("double")
    legs = legs.withColumn("_s", F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(s))
    s = F.col("_s")
    if normalizer == "l2":
        length = F.sqrt(F.sum(s * s).over(w))
        norm = F.when(length == 0, 0.0).otherwise(s / length)
    elif normalizer == "minmax":
        low, high = F.min(s).over(w), F.max(s).over(w)
        norm = F.when(low == high, 1.0).otherwise((s - low) / (high - low))
    else:
        raise ValueError(f"unknown normalizer {normalizer}")
    return legs.withColumn("norm", norm).drop("_s")


def linear(legs: DataFrame, weights: Sequence[float] = (1.0, 1.0, 1.0), normalizer: str = "minmax", top_k: int | None = None) -> DataFrame:
    """Weighted sum of normalised scores."""
    return _fused(normalized(legs, normalizer).withColumn("part", _weight(weights) * F.col("norm")), top_k)


def fused_limit(top_k: int, rerank: bool, candidates: int | None) -> int:
    return max(top_k, top_k if candidates is None else candidates) if rerank else top_k


def fuse(legs: DataFrame, method: str, k: float, weights: Sequence[float], normalizer: str, top_k: int | None) -> DataFrame:
    return linear(legs, weights, normalizer, top_k) if method == "linear" else rrf(legs, k, weights, top_k)


def min_relevance(fused: DataFrame, share: float | None) -> DataFrame:
    """Without what scores less than ``share`` of its query's best; 0 and None keep all."""
    if not share:
        return fused
    best = F.max("score").over(Window.partitionBy("query_id"))
    return fused.withColumn("_best", best).where(F.col("score") >= F.col("_best") * share).drop("_best")


def rerank_floors(scored: DataFrame, relative: float = 0.01, absolute: float = 0.0) -> DataFrame:
    """Without what scores less than ``absolute``, or than ``relative`` of its query's best where that is positive; each floor counts only if positive."""
    out = scored
    if relative > 0:
        best = F.max("score").over(Window.partitionBy("query_id"))
        out = out.withColumn("_best", best).where((F.col("_best") <= 0) | (F.col("score") >= F.col("_best") * relative)).drop("_best")
    return out.where(F.col("score") >= absolute) if absolute > 0 else out
