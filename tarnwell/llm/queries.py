"""The training-data queries, each over its whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import spread
from . import bpe, chat, decontam, embed, html_text, licenses, minhash, pii, store, toxicity

WORD = r"[\p{L}\p{M}\p{N}]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript of every conversation."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH e AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) AS k FROM e)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '<' || chr(8203) || '|im_start|>'), '<|im_end|>', '<' || chr(8203) || '|im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS transcript
FROM m WHERE k = 1 GROUP BY conv_id
"""


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of every document, verified against the store that it was written to."""
    return store.verify(spark, store.write(_table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest verbatim match of each contaminated document with each benchmark item."""
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
bg AS (SELECT item_id, j, array_to_string(w[j + 1:j + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 12)) AS j FROM b WHERE len(w) >= 13)),
hit AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM dg JOIN bg USING (g)),
run AS (SELECT doc_id, item_id, count(*) + 12 AS n, min(i) AS i, min(j) AS j FROM hit GROUP BY doc_id, item_id, i - j, island),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, i, j) AS k FROM run)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS match_words, CAST(i AS BIGINT) AS doc_word, CAST(j AS INTEGER) AS item_word FROM best WHERE k = 1
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data and secrets."""
    docs = _table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.fit(docs))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again to see that they give the text."""
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model fitted on the labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document that has a near-duplicate."""
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in the documents."""
    return licenses.spans(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every embedding."""
    return embed.classes(_table(spark, sf_dir, "embeddings")).drop("n_exact")


OP10_SQL = """
WITH RECURSIVE p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT a AS vec_id, min(b) AS class_id, any_value(coalesce(n, 0)) AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) USING (a) GROUP BY a
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_chat_formatting, op3_token_store, op4_benchmark_decontamination, op5_pii, op6_byte_level_bpe, op7_toxicity, op8_minhash_near_dedup, op9_license_scan, op10_embedding_near_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op4_benchmark_decontamination": OP4_SQL, "op9_license_scan": licenses.oracle_sql(), "op10_embedding_near_dedup": OP10_SQL}
