"""The document pipeline: from raw documents to the token ids of what is worth training on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import bpe, decontam, minhash, pii, toxicity
from tarnwell.llm.spill import remove, shared_dir
from tarnwell.sources.shared import spread


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model finds toxic; it learns from the labelled ones among docs."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kinds."""
    return pii.redact(docs, pii.fit(docs))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids."""
    return bpe.encode(docs).select("doc_id", "tokens", "n_tokens", "round_trip")


STAGES = [("toxicity", _toxicity), ("minhash_near_dedup", _near_dedup), ("benchmark_decontamination", _decontamination), ("pii", _pii), ("byte_level_bpe", _tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread as the next one's input; what only a stage before needed is removed.

    Documents without text, or without words, pass every stage (null tokens for a null text, none for an empty one); rows without doc_id are never taken for copies; rows that
    share a doc_id stay or go together where copies are dropped, and are judged by their own text elsewhere; further columns, whatever their names, are carried along
    until the last stage, and of an empty table nothing comes out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
