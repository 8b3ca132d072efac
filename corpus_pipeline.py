"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to the
folder that all executors share and reads it back as the next stage's documents.  All stages but the
last return the columns of ``documents``, further ones included, whatever their names.

Defined results, for every stage: a null text counts as an empty one; rows with a null ``doc_id`` are kept and never
stand for others; rows repeated with one id get the same decision; very long texts are read whole; an empty table
gives an empty one.  Ties: scores equal to the threshold are kept, and of a group of near-duplicates the smallest id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe_codec, prob_minhash, quality_gam, secrets_dfa, winnowing
from shelfmark.llm.common import read_table, shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the acceptance threshold (``quality_gam.ACCEPT``, inclusive).  Without any
    labels every score is 0.5, so that nothing is accepted; empty texts have a score like others."""
    model = quality_gam.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, model, out_col="__quality_score")
    return scored.where(F.col("__quality_score") >= quality_gam.ACCEPT).drop("__quality_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.  Texts without words are in no
    group and stay."""
    groups = prob_minhash.near_duplicates(docs.select("doc_id", "text")).where("not kept and doc_id != component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; texts without words hold none."""
    return winnowing.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by its kind, and n_chars (if there is such a column) of the
    new text.  Null texts stay null, with the n_chars they had."""
    out = secrets_dfa.redact(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each document; a null or empty text has no tokens."""
    return bpe_codec.round_trip_report(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("tokenize", tokenize),
]

#: A fitted classifier and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
