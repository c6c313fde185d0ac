"""Deterministic splits, exclusions and samples."""

from __future__ import annotations

import random
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import hash_rank
from waymark.operators.staging import written_once


def hash_rank_split(rows: DataFrame, seed: str, count: int, keys=("original_id", "normalized_question"), tie: str = "source_index", must_fill: bool = False) -> DataFrame:
    """The ``count`` rows of the smallest seeded hash; ``must_fill``: fewer are an error."""
    chosen = rows.withColumn("rank", hash_rank(seed, *keys)).orderBy("rank", tie).limit(count)
    if must_fill and (found := chosen.count()) < count:
        raise ValueError(f"{found} rows remain, {count} are needed")
    return chosen


def disjoint_splits(rows: DataFrame, specs: list[tuple[str, str, int]], id_col: str = "original_id", text_col: str = "normalized_question") -> DataFrame:
    """Splits ``(name, seed, count)`` in turn; ids and texts of earlier ones are out.

    Within one split a text may occur twice.  Rows and every split are written
    once; a later split reads the earlier ones through their ids and texts.
    """
    rows = written_once(rows)
    chosen: list[DataFrame] = []
    for name, seed, count in specs:
        left = rows
        for done in chosen:
            left = left.join(done.select(id_col), id_col, "left_anti").join(done.select(text_col), text_col, "left_anti")
        chosen.append(written_once(hash_rank_split(left, seed, count, (id_col, text_col)).select(*rows.columns, "rank").withColumn("split", F.lit(name))))
    return reduce(DataFrame.unionByName, chosen)


def exclude(rows: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    """Rows that share none of the keys, one by one, with ``used``."""
    return reduce(lambda left, k: left.join(used.select(k).distinct(), k, "left_anti"), keys, rows)


def core_reserve(rows: DataFrame, seed: str, core: int, id_col: str = "question_id", source_col: str = "data_source") -> DataFrame:
    """``part`` = core for the ``core`` rows of the smallest (hash, id), else reserve.

    Ids must be there and differ; a repeated or null one is an error.
    """
    counts = rows.groupBy(id_col).agg(F.count("*").alias("_n"))
    once = F.when((F.col("_n") == 1) & F.col(id_col).isNotNull(), True).otherwise(F.raise_error(F.lit("ids repeat or are null")).cast("boolean"))
    rows = rows.join(counts.where(once).select(id_col), id_col)
    ranked = rows.withColumn("rank", hash_rank(seed, F.lower(F.btrim(F.col(source_col))), F.col(id_col)))
    first = ranked.orderBy("rank", id_col).limit(core).select(id_col, F.lit("core").alias("part"))
    return ranked.join(first, id_col, "left").withColumn("part", F.coalesce("part", F.lit("reserve")))


def first_unique(rows: DataFrame, id_col: str, order: str, count: int) -> DataFrame:
    """The first occurrence of each id, the ``count`` earliest of them."""
    w = Window.partitionBy(id_col).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").orderBy(order).limit(count)


def ordered_distinct(rows: DataFrame, col: str, order: str) -> DataFrame:
    return rows.groupBy(col).agg(F.min(order).alias("first_position"))


def class_take_k(rows: DataFrame, class_col: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each class."""
    w = Window.partitionBy(class_col).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def oversampled(rows: DataFrame, class_col: str, order: str) -> DataFrame:
    """``copies`` that bring two classes to one size: how often a cycling sampler
    takes each row of the smaller class (the first ones once more)."""
    sizes = rows.groupBy(class_col).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    w = Window.partitionBy(class_col).orderBy(order)
    k = F.row_number().over(w)
    whole = F.floor(F.col("most") / F.col("n"))
    wide = rows.join(F.broadcast(sizes.join(F.broadcast(most))), class_col)
    return wide.withColumn("copies", (whole + (k <= F.col("most") % F.col("n")).cast("long")).cast("long")).drop("n", "most")


def epoch_order(labels: list[bool], seed: int | str, epoch: int) -> list[int]:
    """Positions of a balanced epoch in the exact order of the seeded generator.

    Both classes, the false one first, are drawn from reshuffled cycles until
    they have the size of the larger one; then all is shuffled.  The generator
    is one stream, so this is a list on one machine; ``oversampled`` gives the
    multiplicities of any number of rows.
    """
    rng = random.Random(f"{seed}:epoch:{epoch}")
    classes = [[i for i, y in enumerate(labels) if bool(y) is c] for c in (False, True)]
    if not all(classes):
        raise ValueError("both classes are needed")

    def cycles(members: list[int]):
        while True:
            yield from shuffled(members, rng)

    size = max(map(len, classes))
    return shuffled([i for members in classes for i in islice(cycles(members), size)], rng)


def shuffled(items: list, rng: random.Random) -> list:
    """A shuffled copy."""
    out = items[:]
    rng.shuffle(out)
    return out


def best_epoch(epochs: DataFrame, loss: str = "validation_token_nll") -> DataFrame:
    """The epoch of the least finite loss, the earliest of equal ones."""
    finite = F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    checked = F.when(finite, F.struct(F.col(loss), F.col("epoch"))).otherwise(F.raise_error(F.lit("loss is not finite")))
    return epochs.agg(F.min(checked).alias("best")).select(F.col("best.epoch").alias("epoch"), F.col(f"best.{loss}").alias(loss))


def overlap_matrix(rows: DataFrame, split_col: str, id_col: str) -> DataFrame:
    """Shared ids of each two splits, zeros included (a row a pair of splits)."""
    keys = rows.select(F.col(split_col).alias("split"), F.col(id_col).alias("id")).distinct()
    a, b = keys.toDF("a", "id"), keys.toDF("b", "id")
    shared = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    names = keys.groupBy().agg(F.sort_array(F.collect_set("split")).alias("s"))
    grid = names.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return grid.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("shared"))


def duplicate_count(rows: DataFrame, col: str) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(col).alias("different")).withColumn("duplicates", F.col("rows") - F.col("different"))
