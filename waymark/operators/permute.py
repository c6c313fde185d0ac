"""Keyed permutations of 0 .. n-1, one row at a time, and epochs made with them.

A permutation is a Feistel network over the bits of n - 1, cut into a left and
a right part: in turn each part is changed by a function of the other and of a
key.  Its domain is a power of two below 2 n; places beyond n are sent through
the network again until they fall inside (cycle walking).  So a row knows where
it goes without any other row, and no two rows go to the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ordered import ordinal

#: Pairs of rounds, and times that a place may walk; each walk ends with a chance over one half.
PAIRS, WALKS = 4, 96
#: A prime below 2 ** 31, and a multiplier of it.
PRIME, TIMES = 2147483647, 48271


def round_keys(name: Column) -> Column:
    """Two numbers of 28 bits for each pair of rounds, from a text."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", name, F.lit(str(i))).cast("binary"), 256), 1, 7), 16, 10).cast("long")
    return F.array(*[F.struct(part(2 * i).alias("a"), part(2 * i + 1).alias("b")) for i in range(PAIRS)])


def scrambled(x: Column, key: Column) -> Column:
    """A number below ``PRIME`` that depends on both."""
    t = F.pmod(x + key, F.lit(PRIME))
    return F.pmod(F.pmod(t * t, F.lit(PRIME)) * TIMES + key, F.lit(PRIME))


def permuted(x: str, n: str, keys: str) -> Column:
    """Where place ``x`` of ``n`` goes; columns of longs, and one of ``round_keys``."""
    bits = F.greatest(F.length(F.bin(F.col(n) - 1)), F.lit(2))
    low = F.floor(bits / 2).cast("int")
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    left_mask, right_mask = power(bits - low) - 1, power(low) - 1

    def through(place: Column) -> Column:
        start = F.struct(F.call_function("shiftright", place, low).alias("l"), place.bitwiseAND(right_mask).alias("r"))

        def pair(s: Column, k: Column) -> Column:
            left = s["l"].bitwiseXOR(scrambled(s["r"], k["a"]).bitwiseAND(left_mask))
            return F.struct(left.alias("l"), s["r"].bitwiseXOR(scrambled(left, k["b"]).bitwiseAND(right_mask)).alias("r"))

        return F.aggregate(F.col(keys), start, pair, lambda s: F.call_function("shiftleft", s["l"], low) + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), through(F.col(x)), lambda at, _: F.when(at >= F.col(n), through(at)).otherwise(at))
    return F.when(F.col(n) == 1, F.col(x)).otherwise(F.when(walked < F.col(n), walked).otherwise(F.raise_error(F.lit("a place walked too long")).cast("long")))


def balanced_epoch(rows: DataFrame, class_col: str, id_col: str, seed: int | str, epoch: int) -> DataFrame:
    """``place, id, class, cycle``: one epoch in which every class comes equally often.

    Each class is drawn in cycles, every cycle in an order of its own, until it
    has the size of the largest one; then all places are permuted.  Rows are
    told apart by their order by id, so repeated ids are rows of their own;
    rows without a class are left out; fewer than two classes are an error.
    """
    known = rows.select(F.col(class_col).alias("class"), F.col(id_col).alias("id")).where("class IS NOT NULL")
    sizes = known.groupBy("class").agg(F.count("*").alias("n"))  # a row a class
    if sizes.limit(2).count() < 2:
        raise ValueError("two classes are needed")
    every, before = Window.partitionBy(), Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("class", "n", (F.row_number().over(Window.orderBy("class")) - 1).cast("long").alias("rank"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.max("n").over(every).alias("size"), F.count("*").over(every).alias("classes"))
    members = ordinal(known, "class", "id", name="at").join(placed, "class").withColumn("at", F.col("at") - F.col("start"))
    name = lambda *parts: F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *parts)
    cycles = members.withColumn("cycle", F.explode(F.expr("sequence(0L, (size - 1) div n)"))).withColumn("keys", round_keys(name(F.col("class").cast("string"), F.col("cycle").cast("string"))))
    drawn = cycles.withColumn("in_class", F.col("cycle") * F.col("n") + permuted("at", "n", "keys")).where("in_class < size")
    spread = drawn.withColumns({"total": F.col("size") * F.col("classes"), "own": F.col("rank") * F.col("size") + F.col("in_class")}).withColumn("all_keys", round_keys(name(F.lit("all"))))
    return spread.select(permuted("own", "total", "all_keys").alias("place"), F.col("id"), F.col("class"), F.col("cycle"))


def permuted_sql(table: str, x: str, n: str, name: str, out: str) -> str:
    """CTEs (recursive ones) that add ``out`` to the rows of a CTE, as ``permuted`` does; its result is ``<out>_done``."""
    key = lambda i: f"CAST('0x' || substr(sha256({name} || ':{i}'), 1, 7) AS BIGINT)"
    mixed = lambda v, k: f"((((({v} + {k}) % {PRIME}) * (({v} + {k}) % {PRIME})) % {PRIME} * {TIMES} + {k}) % {PRIME})"
    keys = ", ".join(f"{key(i)} AS k{i}" for i in range(2 * PAIRS))
    inner = "SELECT *, pl >> low AS l0, pl & ((1::BIGINT << low) - 1) AS r0 FROM {source}"
    for i in range(PAIRS):
        inner = f"SELECT *, xor(l{i}, {mixed(f'r{i}', f'k{2 * i}')} & ((1::BIGINT << (bits - low)) - 1)) AS l{i + 1} FROM ({inner})"
        inner = f"SELECT *, xor(r{i}, {mixed(f'l{i + 1}', f'k{2 * i + 1}')} & ((1::BIGINT << low) - 1)) AS r{i + 1} FROM ({inner})"
    step = f"SELECT u, nn, bits, low, {', '.join(f'k{i}' for i in range(2 * PAIRS))}, (l{PAIRS} << low) + r{PAIRS} AS pl, walked + 1 AS walked FROM ({inner})"
    begin = f"SELECT row_number() OVER () AS u, * FROM {table}"
    return f"""{out}_rows AS MATERIALIZED ({begin}), {out}_keyed AS (SELECT *, bits // 2 AS low FROM (SELECT u, {n} AS nn, {x} AS pl, greatest(length(bin(CAST({n} - 1 AS BIGINT))), 2)::BIGINT AS bits, {keys}, 0 AS walked FROM {out}_rows)),
{out}_walk AS (SELECT u, nn, bits, low, {', '.join(f'k{i}' for i in range(2 * PAIRS))}, pl, walked FROM {out}_keyed UNION ALL {step.format(source=f"(SELECT * FROM {out}_walk WHERE (walked = 0 OR pl >= nn) AND nn > 1)")}),
{out}_done AS (SELECT r.* EXCLUDE (u), w.pl AS {out} FROM {out}_rows r JOIN {out}_walk w USING (u) WHERE w.pl < w.nn AND (w.walked > 0 OR w.nn = 1))"""
