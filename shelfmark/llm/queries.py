"""The registered queries of this subpackage, ``opN_<name>(spark, sf_dir)``, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe_codec, compact_windows, embedding_dedup, filter_audit, language_gru, ngram_lm, prob_minhash, quality_gam, quote_threads, secrets_dfa, sort_means, winnowing, wrapper_induction
from shelfmark.llm.common import read_table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.language_report(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_dfa.secret_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.round_trip_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.conversations(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnowing.contamination_report(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extraction_report(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clusters(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_quality_gam, op3_language_gru, op4_secret_scan, op5_bpe_codec, op6_prob_minhash, op7_compact_windows, op8_quote_threads, op9_winnowing, op10_wrapper_induction, op11_ngram_trie, op12_filter_audit, op13_sort_means)}

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.ORACLE_SQL, "op8_quote_threads": quote_threads.ORACLE_SQL, "op9_winnowing": winnowing.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_sort_means": sort_means.ORACLE_SQL}
