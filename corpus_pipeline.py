"""A training-data pipeline over the ``documents`` table.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last one returns the records that were written.  Every stage
reads ``doc_id``, ``text`` and ``source`` only and carries any other column
along; an empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, mixing, ngram_join, toxicity
from waymark.llm.common import discard, shared_dir, table
from waymark.llm.records import read_records, write_records

#: The end id of a record.
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score of 0.3 or more).

    Null and empty texts and null ids are scored like others; equal texts stay
    or go together.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8.

    That of the smallest id (null first), then of the smaller text hash; rows
    that repeat an id with another text are documents of their own.  Texts
    without words stay, but for repeats of a whole (id, text).
    """
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which more than half are passages go.

    Null and empty texts stay as they are; repeated rows stay or go together.
    """
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, one row a copy.

    Copies keep their ``doc_id``.  A null source is a source of its own; texts
    without words take nothing from a target and come as often as the order of
    the mix has it.
    """
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as framed records, read back: where each starts, and digests.

    One record a row, in ascending ``doc_id`` order (null first, copies next to
    one another); null and empty texts hold the end id alone.
    """
    path = shared_dir(spark)
    write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_records(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("records", write_tokens),
]

#: SQL expresses neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each writes Parquet that the next one reads.

    What a stage has read is deleted when its own result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
