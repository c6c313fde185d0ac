"""Joins that fail instead of losing rows, and pairings of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _guard(bad: Column, message: str) -> Column:
    """A filter that lets rows through and fails on bad ones."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left`` with its one row of ``right``.

    A key that ``right`` lacks or repeats is an error when the result is read;
    so is a null key.  Rows of ``right`` that nothing asks for are left out.
    """
    others = [c for c in right.columns if c != key]
    single = right.groupBy(key).agg(F.count("*").alias("_matches"), *(F.first(c).alias(c) for c in others))
    joined = left.join(single, key, "left")
    return joined.where(_guard(F.coalesce(F.col("_matches"), F.lit(0)) != 1, f"{key}: no single match")).drop("_matches")


def positional(rows: DataFrame, source: DataFrame, at: str, position: str, row_id: str, source_id: str) -> DataFrame:
    """Rows with the source row at the position they name.

    The position must exist once, and the source row there must be the one
    meant: its id equals the row's; else the read fails.
    """
    joined = must_match(rows.withColumnRenamed(at, position) if at != position else rows, source, position)
    return joined.where(_guard(~F.col(row_id).eqNullSafe(F.col(source_id)), "source row is another one"))


def same_names(rows: DataFrame, names: DataFrame, column: str = "model") -> DataFrame:
    """``rows`` if their names are exactly those of ``names``; else the read fails.

    Both are reduced to their distinct names first.
    """
    mine, theirs = rows.select(column).distinct(), names.select(column).distinct()
    differ = mine.join(theirs.withColumn("_there", F.lit(True)), column, "left_anti").unionAll(theirs.join(mine, column, "left_anti")).agg(F.count("*").alias("_differ"))
    return rows.join(F.broadcast(differ)).where(_guard(F.col("_differ") > 0, f"{column} names differ")).drop("_differ")  # a one-row table


def set_equality(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: whether both have the same distinct values (nulls are one value)."""
    sides = a.select(column, F.lit(1).alias("s")).unionAll(b.select(column, F.lit(2)))
    return sides.groupBy(column).agg(F.count_distinct("s").alias("n")).agg(F.coalesce(F.bool_and(F.col("n") == 2), F.lit(True)).alias("equal"))


def comparisons(outcomes: DataFrame, reference: str = "structured_base") -> DataFrame:
    """Differences of every model from the agent and from the reference model.

    ``comparison, question_id, em, searches``: ``<model>_minus_native``, and
    ``<model>_minus_<reference>`` for the others.  The reference is the first
    name where it is not among the models; one model has no such pairs.
    """
    own = outcomes.select(F.concat("model", F.lit("_minus_native")).alias("comparison"), "question_id", (F.col("em") - F.col("native_em")).alias("em"), (F.col("searches") - F.col("native_searches")).alias("searches"))
    names = outcomes.select("model").distinct().agg(F.coalesce(F.max(F.when(F.col("model") == reference, F.col("model"))), F.min("model")).alias("base"))
    wide = outcomes.join(F.broadcast(names))  # a one-row table
    base = wide.where("model = base").select("question_id", F.col("em").alias("base_em"), F.col("searches").alias("base_searches"))
    pairs = wide.where("model <> base").join(base, "question_id")
    return own.unionAll(pairs.select(F.concat_ws("_minus_", "model", "base"), "question_id", F.col("em") - F.col("base_em"), F.col("searches") - F.col("base_searches")))
