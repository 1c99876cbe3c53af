"""Reranking a fused list by a scorer of (query, texts)."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens

Scorer = Callable[[str, list[str]], list[float]]
log = logging.getLogger(__name__)


def token_overlap(query: Column, text: Column) -> Column:
    """A scorer that needs no model: the share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def rerank(fused: DataFrame, scorer: Scorer, top_k: int, relative: float = 0.01, absolute: float = 0.0, batch: int = 32) -> DataFrame:
    """(query_id, rank, id, score, reranked) of (query_id, query, rank, id, score, content). The scorer sees ``batch`` texts at a time; scores that it leaves out are 0.
    Where it fails, the query keeps its fused list, uncut, and reranked is false. Floors as in ``fusion.rerank_floors``."""
    kinds = dict(fused.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        out = pdf[["query_id", "rank", "id", "score"]].assign(reranked=False)
        try:
            query, texts, scores = pdf["query"].iloc[0], pdf["content"].tolist(), []
            for at in range(0, len(texts), batch):
                got = list(scorer(query, texts[at : at + batch]))
                n = len(texts[at : at + batch])
                scores += [0.0 if s is None else float(s) for s in got[:n]] + [0.0] * (n - len(got))
        except Exception as e:  # noqa: BLE001 - a failing scorer must not fail the search
            log.warning("reranking failed, the fused order stays: %s", e)
            return out
        out = out.assign(score=scores, reranked=True).sort_values("score", ascending=False, kind="stable").head(top_k)
        best = out["score"].max()
        if relative > 0 and best > 0:
            out = out[out["score"] >= relative * best]
        if absolute > 0:
            out = out[out["score"] >= absolute]
        return out.assign(rank=range(1, len(out) + 1))

    schema = f"query_id {kinds['query_id']}, rank int, id {kinds['id']}, score double, reranked boolean"
    return fused.select("query_id", "query", F.col("rank").cast("int"), "id", "score", "content").groupBy("query_id").applyInPandas(one, schema)
