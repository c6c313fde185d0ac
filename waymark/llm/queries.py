"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, divergence, html_extract, lexical, mixing, ngram_join, private_terms, suffix_dedup, toxicity, vector_graph
from .common import shared_dir, table
from .records import read_records, write_records
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    i, x = chat_format.PROBE_ID, chat_format.PROBE_TEXT
    probe = spark.sql(f"SELECT * FROM VALUES ({i}L, 0L, 'user', '{x}'), ({i}L, 1L, 'assistant', '{x}') AS t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_chats(turns.unionByName(probe)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.similar_vectors(table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(spark, path)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_terms.digests(private_terms.disclosures(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat_format": op2_chat_format,
        "op3_toxicity": op3_toxicity,
        "op4_vector_graph": op4_vector_graph,
        "op5_decontaminate": op5_decontaminate,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_html_extract": op8_html_extract,
        "op9_mixing": op9_mixing,
        "op10_records": op10_records,
        "op11_lexical_search": op11_lexical_search,
        "op12_source_divergence": op12_source_divergence,
        "op13_private_terms": op13_private_terms,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.ORACLE_SQL,
        "op5_decontaminate": decontaminate.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op11_lexical_search": lexical.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
    }
