"""Keyed permutations and balanced epochs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.operators.permute import balanced_epoch, permuted, round_keys


def places(spark, n, name):
    df = spark.range(n).withColumns({"n": F.lit(n).cast("long"), "keys": round_keys(F.lit(name))})
    return [r.p for r in df.orderBy("id").select(permuted("id", "n", "keys").alias("p")).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 63, 64, 65, 1000, 4097])
def test_permutations_are_bijective_and_seeded(spark, n):
    got = places(spark, n, "a")
    assert sorted(got) == list(range(n)) and got == places(spark, n, "a")
    if n > 60:
        assert got != places(spark, n, "b") and sum(p == i for i, p in enumerate(got)) < 12


def test_places_are_spread_evenly(spark):
    hits = Counter((i, p) for k in range(60) for i, p in enumerate(places(spark, 5, f"key {k}")))
    assert len(hits) == 25 and max(hits.values()) < 30  # 12 are expected


def test_huge_places_stay_inside(spark):
    n = (1 << 52) + 12345
    df = spark.range(500).select((F.lit(n) - 1 - F.col("id") * 7_000_003).alias("x")).withColumns({"n": F.lit(n), "keys": round_keys(F.lit("h"))})
    got = [r.p for r in df.select(permuted("x", "n", "keys").alias("p")).collect()]
    assert len(set(got)) == 500 and all(0 <= p < n for p in got)


def test_epochs_are_balanced(spark):
    rows = [(i, i % 7 == 0, "x") for i in range(100)] + [(3, False, "x"), (500, None, "x"), (None, True, "x")]
    df = spark.createDataFrame(rows, "id long, y boolean, place string").repartition(4)
    got = balanced_epoch(df, "y", "id", 7, 1).collect()
    size = sum(r[1] is False for r in rows)
    assert sorted(r.place for r in got) == list(range(2 * size)) and Counter(r["class"] for r in got) == {False: size, True: size}
    times = Counter(r.id for r in got if r["class"])
    assert set(times.values()) <= {size // 16, size // 16 + 1} and times[None] >= size // 16  # each of the smaller class nearly as often
    assert Counter(r.id for r in got if not r["class"])[3] == 2
    again = {(r.place, r.id) for r in balanced_epoch(df.repartition(2), "y", "id", 7, 1).collect()}
    assert again == {(r.place, r.id) for r in got}
    assert again != {(r.place, r.id) for r in balanced_epoch(df, "y", "id", 7, 2).collect()}
    with pytest.raises(ValueError, match="two classes"):
        balanced_epoch(df.where("y"), "y", "id", 7, 1)
