"""Operator 9: mixing sources to target weights, with Spark expressions only.

Capped water-filling: every source gets its weight's share of all words, no
source more than ``max_epochs`` times what it has; the excess goes to the
others by weight until nothing is above its cap.  Sorted by cap over weight,
the capped sources are a prefix, so one pass over the sources finds the level
that repeated redistribution would reach.

A document then gets the whole repetitions of its source, and the fractional
rest of the source is filled with whole documents in the order of a seeded
hash.  The place where that order is cut is found by sums of hash buckets, so
only one bucket of a source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5, 2, 1)
#: Hex digits of the hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` of the sources in ``sizes(source, size)``.

    Sources take the weights in turn, ordered by code point, null last.  Both
    windows see one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * max_epochs})
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.sum("source_size").over(all_rows).alias("total"),
    )
    capped = F.col("cap") * F.col("weight_left") <= (F.col("total") - F.col("caps_before")) * F.col("weight")
    level = (F.col("total") - F.col("caps_before")).cast("double") / F.col("weight_left")
    # the first uncapped source knows the level of all uncapped ones
    levels = filled.withColumns({"capped": capped, "own_level": level})
    water = F.min(F.when(~F.col("capped"), F.struct("caps_before", "k", "own_level"))).over(all_rows)["own_level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(water * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = 3, seed: int = 9, keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``size, source_size, target, taken, copies``.

    ``size`` counts the words of the text (null: 0), ``copies`` is how often
    the mix repeats the document (at most ``max_epochs``), ``taken`` is
    ``copies * size``.  Words taken from a source differ from its target by at
    most half the longest document.  Same input and seed, same mix.  A null
    source is a source of its own; sources without words have target 0;
    repeated rows are taken one by one; ``keep`` names columns to carry along
    (in a struct ``row``); an empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), key.alias("h"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    sized = staged(rows)
    targets = staged(source_targets(sized.select("source", "size"), weights, max_epochs))
    share = targets.select(
        "source", "source_size", "target",
        F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), F.lit(max_epochs)).alias("whole"),
    ).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # where the seeded order is cut: the bucket in which the words reach the rest
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same_source = F.col("b.source").eqNullSafe(F.col("s.source"))
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    marked = placed.alias("b").join(share.alias("s"), same_source).select("b.source", "bucket", "before", "words", "source_size", "target", "whole", "rest")
    joined = sized.withColumn("bucket", bucket).alias("d").join(marked.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    flat = joined.select("d.*", "source_size", "target", "whole", "rest", "before", "words")
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    easy = flat.where(~inside).withColumn("extra", (F.col("before") + F.col("words") <= F.col("rest")).cast("long"))
    order = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # whole documents up to the cut; the one on the cut if that comes nearer
    cut = flat.where(inside).withColumn("extra", (start + F.col("size") / 2 <= F.col("rest")).cast("long"))
    both = easy.unionByName(cut).withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs)).cast("long"))
    return both.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["row"] if keep else []),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('9:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][CAST(k % 3 + 1 AS INTEGER)] AS weight, 3 * source_size AS cap FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, sum(source_size) OVER () AS total
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, cap * weight_left <= (total - caps_before) * weight AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight *
    (SELECT CAST(arg_min(total - caps_before, k + 1000000 * caps_before) AS DOUBLE) / arg_min(weight_left, k + 1000000 * caps_before) FROM g WHERE NOT capped) END AS target FROM g
), r AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3) AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, greatest(r.target - r.whole * r.source_size, 0) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(whole + CASE WHEN before + size / 2 <= rest AND before < rest OR before + size <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken,
  CAST(least(whole + CASE WHEN before + size / 2 <= rest AND before < rest OR before + size <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies
FROM c
"""
