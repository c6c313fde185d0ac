"""Question-level bootstrap: modes that scale, and an exact mode.

A resample of n questions matters to a mean only through how often each
distinct value is drawn, and these counts are multinomial.  So the mode that
scales reduces questions to their distinct values, deals these into blocks, and
draws for each replicate first how many fall to each block and then, block by
block, the counts inside; whatever n is, a task holds one block.

The curve of scores cannot be reduced so.  There a question's weight in a
replicate is a function of the two (a counter-based generator), so any task can
make the weights it needs; states are cut into slices by score, and sums of
weights are carried from slice to slice, for all replicates at once.

The exact mode replays Python's generator.  The one stream is cut into blocks of
raw numbers, and how many of these make picks is counted first.  Sums add up:
a task works on many blocks side by side and hands on what each holds of each
replicate.  Precision needs whole replicates: a task enters the stream where its
first one begins, and makes several side by side.  Questions are numbered and
packed into blocks in the shared folder, a byte each where they have few distinct
values; a task reads blocks as it needs them, so neither it nor the driver holds
a whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.mersenne import WORDS, Lanes, Picks
from waymark.operators.ordered import ordinal
from waymark.operators.staging import shared_folder, written_once

# Published numbers of resamples and what is added to the seed
# (the k-th model is k after these; comparisons of models count from 1).
REPLICATES, GATE_SEED = 10_000, 20260726
SEED_OFFSETS = {("native", "em"): 200, ("native", "searches"): 300, ("model", "em"): 0, ("model", "searches"): 100, ("model", "average_precision"): 400}
#: Replicates that one batch draws.
DRAWN = 500
#: Distinct values of a block, roughly.
BLOCK_VALUES = 5_000
#: Questions that one raw number of the exact stream can tell apart.
EXACT_QUESTIONS = (1 << 32) - 1
#: Raw numbers between two known places of a stream, at least; such places of a stream, roughly; jobs that enter it, at most.
RAW_BLOCK, PLACES, ENTRIES = 1 << 20, 4096, 512
#: Places of a stream that a task works on side by side.
LANES = 128
#: Picks at work at once; rows of a packed block; bytes of blocks, or of counts, that a task keeps.
PICKED, PACKED, KEPT = 1 << 21, 1_000_000, 1 << 26
#: Replicates of precision that a task weighs side by side; states that it weighs at once; states summed in 16 bits.
ABREAST, STATES, SHORT = 32, 1 << 15, 256
#: States of a slice, and replicates that one pass over a slice weighs.
SLICE_STATES, WEIGHED = 20_000, 250
#: States that are weighed at once; more do not fit the processor's caches.
AT_ONCE = 1024


def seed_schedule(models: list[str], seed: int, reference: str = "structured_base") -> dict[tuple[str, str], int]:
    """Seed of each (comparison, metric); models in their given order."""
    out = {(f"{m}_minus_native", k): seed + SEED_OFFSETS["native", k] + i for i, m in enumerate(models) for k in ("em", "searches")}
    pairs = comparison_pairs(models, reference)
    return out | {(f"{m}_minus_{base}", k): seed + SEED_OFFSETS["model", k] + i for i, (m, base) in enumerate(pairs, 1) for k in ("em", "searches", "average_precision")}


def draws(spark: SparkSession, n: int, replicates: int, seed: int) -> DataFrame:
    """``replicate, slot, pick``: n picks out of 0 .. n-1 for each replicate."""
    slots = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("slot"))
    hashed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "replicate", "slot"), 256), 1, 8), 16, 10).cast("long")
    return slots.withColumn("pick", hashed % n)


def percentile_rows(values: DataFrame, replicates: int, last_exclusive: bool = True, by: tuple = ("metric",)) -> DataFrame:
    """Order statistics ``low, high`` at 2.5 and 97.5 % of sorted replicate values.

    Indices are ``int(q * R)``, or ``int(q * (R - 1))`` if not ``last_exclusive``.
    """
    base = replicates if last_exclusive else replicates - 1
    low, high = int(0.025 * base), min(int(0.975 * base), replicates - 1)
    sorted_values = values.groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("v"))  # one number a replicate
    return sorted_values.select(*by, F.element_at("v", low + 1).alias("low"), F.element_at("v", high + 1).alias("high"))


def resampled_sums(rows: DataFrame, values: list[str], replicates: int, seed: int, *by: str) -> DataFrame:
    """``by, replicate, n`` and the sums of ``values`` over n resampled rows.

    Distinct values of a group are dealt into blocks of about ``BLOCK_VALUES``.
    How many draws of a replicate fall to each block is multinomial over the
    blocks' sizes; given that, the counts inside a block are multinomial over
    its values.  So a task holds one block, or the sizes of one group's blocks.
    Nulls in a value are an error; an empty table gives no rows.
    """
    spark = rows.sparkSession
    filled = [F.when(F.col(v).isNull(), F.raise_error(F.lit("null value"))).otherwise(F.col(v).cast("double")).alias(v) for v in values]
    distinct = written_once(rows.select(*by, *filled).groupBy(*by, *values).agg(F.count("*").alias("n")))
    blocks = max(1, math.ceil(distinct.count() / BLOCK_VALUES))
    name = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in by))
    dealt = distinct.withColumns({"block": F.pmod(F.xxhash64(*values), F.lit(blocks)), "key": F.crc32(F.encode(name, "utf-8"))})
    sizes = dealt.groupBy(*by, "key", "block").agg(F.sum("n").alias("held")).groupBy(*by, "key").agg(F.sort_array(F.collect_list(F.struct("block", "held"))).alias("blocks"))
    jobs = sizes.join(F.broadcast(spark.range(-(-replicates // DRAWN)).withColumnRenamed("id", "part"))).repartition("part", *by)  # a row a batch of replicates
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    groups = [*by, "key", "block"]
    shape = ", ".join([*(f"{k} {kinds[k]}" for k in by), "key long, block long, part long, n long, drawn array<long>"])

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = np.array([x["held"] for x in row["blocks"]])
                rng = np.random.default_rng([row["key"], row["part"]])
                drawn = rng.multinomial(held.sum(), held / held.sum(), size=min(DRAWN, replicates - row["part"] * DRAWN))
                out = [{**{k: row[k] for k in by}, "key": row["key"], "block": x["block"], "part": row["part"], "n": int(held.sum()), "drawn": drawn[:, i].tolist()} for i, x in enumerate(row["blocks"])]
                yield from pa.Table.from_pylist(out, pa.schema([*(batch.schema.field(k) for k in by), *(pa.field(k, pa.int64()) for k in ("key", "block", "part", "n")), pa.field("drawn", pa.list_(pa.int64()))])).to_batches()

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = left.sort_values(values)  # an order that does not depend on how rows arrive
        table, counts = held[values].to_numpy(float), held["n"].to_numpy()
        out = []
        for row in right.to_dict("records"):
            rng = np.random.default_rng([row["key"], row["part"], row["block"] + 1])
            sums = rng.multinomial(np.asarray(row["drawn"]), counts / counts.sum()) @ table
            out.append(pd.DataFrame({**{k: row[k] for k in by}, "replicate": row["part"] * DRAWN + np.arange(len(sums)), "n": row["n"], **{v: sums[:, i] for i, v in enumerate(values)}}))
        return pd.concat(out)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "replicate long", "n long", *(f"{v} double" for v in values)])
    sums = dealt.groupBy(*groups).cogroup(jobs.select(*by, "key", "part", "blocks").mapInArrow(deal, shape).groupBy(*groups)).applyInPandas(draw, schema)
    return sums.groupBy(*by, "replicate", "n").agg(*(F.sum(v).alias(v) for v in values)) if blocks > 1 else sums


def paired_bootstrap(deltas: DataFrame, replicates: int = REPLICATES, seed: int = 0, last_exclusive: bool = True) -> DataFrame:
    """``metric, estimate, low, high`` of means of ``deltas(question_id, metric, delta)``."""
    means = resampled_sums(deltas, ["delta"], replicates, seed, "metric").select("metric", (F.col("delta") / F.col("n")).alias("value"))
    estimate = deltas.groupBy("metric").agg(F.avg("delta").alias("estimate"))
    return estimate.join(percentile_rows(means, replicates, last_exclusive), "metric")


def _three(quality: Column, avoidable: Column, native: Column, n: Column) -> Column:
    """Headroom, avoidable share of searches, mean reduction: one (metric, value) each."""
    share = F.when(native != 0, avoidable / native).otherwise(0.0)
    pairs = (("quality_headroom", quality / n), ("avoidable_search_fraction", share), ("mean_search_reduction", avoidable / n))
    return F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in pairs)))


def three_metric_intervals(questions: DataFrame, replicates: int = REPLICATES, seed: int = GATE_SEED) -> DataFrame:
    """``metric, estimate, low, high`` from one set of resamples for three statistics.

    ``questions(question_id, quality, avoidable, native)``: the oracle's gain,
    avoidable and native searches of a question.
    """
    one = lambda df: df.select(_three(F.col("quality"), F.col("avoidable"), F.col("native"), F.col("n")).alias("m")).select("m.metric", "m.value")
    values = ["quality", "avoidable", "native"]
    whole = one(questions.agg(*(F.sum(F.col(v).cast("double")).alias(v) for v in values), F.count("*").alias("n"))).withColumnRenamed("value", "estimate")
    return whole.join(percentile_rows(one(resampled_sums(questions, values, replicates, seed)), replicates, last_exclusive=False), "metric")


# The distribution of a Poisson number of mean 1, up to what 64 bits tell apart.
_UPTO = np.array([min(2**64, round(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * 2**64)) - 1 for k in range(20)], np.uint64)
_UPTO[-1] = 2**64 - 1
#: How often a number of these leading 16 bits is drawn; 255 where the bits do not decide.
_BY_BITS = np.where(
    np.searchsorted(_UPTO, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48), side="left") == np.searchsorted(_UPTO, (np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)) + np.uint64((1 << 48) - 1), side="left"),
    np.searchsorted(_UPTO, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48), side="left"), 255,
).astype(np.uint8)


def weights(questions: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """How often each question (a 64-bit key) is drawn in replicates ``first ..``; a row a question.

    Independent Poisson numbers of mean 1, made from key, replicate and seed
    alone.  Their sum differs from n by chance, which a ratio such as precision
    does not see.
    """
    low, high = first // 4, -(-(first + count) // 4)  # 64 bits hold the leading 16 of four replicates
    bits = _mixed(questions[:, None], np.arange(low, high)[None, :], 2 * seed).astype("<u8", copy=False).view("<u2")[:, first - 4 * low : first - 4 * low + count]
    out = _BY_BITS.take(bits)
    row, column = np.nonzero(out == 255)
    more = _mixed(questions[row], column + first, 2 * seed + 1) >> np.uint64(16)
    out[row, column] = np.searchsorted(_UPTO, bits[row, column].astype(np.uint64) << np.uint64(48) | more, side="left")
    return out


def _mixed(key: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits for each key and count."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)
    x = x + (count + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _batches(replicates: int) -> list[tuple[int, int]]:
    return [(a, min(WEIGHED, replicates - a)) for a in range(0, replicates, WEIGHED)]


def sliced(states: DataFrame) -> DataFrame:
    """``model, slice, hot, key, score, truth``, written once: slices descend by score.

    A score that more than ``SLICE_STATES`` states share is ``hot``: it has
    slices of its own, cut by question, of which only the sums matter.  A row
    without a key marks its place among the other slices, which it cuts in two.
    """
    rows = states.select("model", F.xxhash64("question_id").alias("key"), F.col("score").cast("double").alias("score"), F.col("truth").cast("long").alias("truth"))
    counts = rows.groupBy("model", "score").agg(F.count("*").alias("c"))
    hot = counts.where(F.col("c") > SLICE_STATES).select(F.col("model").alias("m"), F.col("score").alias("s"), F.ceil(F.col("c") / SLICE_STATES).alias("cuts"))
    marked = rows.join(hot, (F.col("model") == F.col("m")) & (F.col("score") == F.col("s")), "left").withColumn("hot", F.col("cuts").isNotNull()).drop("m", "s")
    n = rows.count()
    places = hot.select(F.col("m").alias("model"), F.lit(None).cast("long").alias("key"), F.col("s").alias("score"), F.lit(0).cast("long").alias("truth"), F.lit(None).cast("long").alias("cuts"), F.lit(False).alias("hot"))
    cold = marked.where(~F.col("hot")).unionByName(places).repartitionByRange(max(1, math.ceil(n / SLICE_STATES)), F.col("model"), F.desc("score")).withColumn("slice", F.spark_partition_id().cast("long"))
    split = marked.where("hot").withColumn("slice", -1 - F.pmod(F.xxhash64("key"), F.col("cuts")))
    return written_once(cold.drop("cuts").unionByName(split.drop("cuts")))


def weighed_precision(states: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``model, replicate, value``: tie-aware average precision with questions resampled.

    ``states(model, question_id, score, truth)``.  First every slice gives its
    sums of weights for all replicates; the sums of the slices before it are
    carried to each slice, which then adds up its own share of the precision.
    """
    cut = sliced(states)

    def segments(part: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
        """States in order, cut where a hot score has its place."""
        ordered = part.sort_values("score", ascending=False, kind="stable")
        mark = ordered["key"].isna()
        states = ordered[~mark].assign(segment=mark.cumsum()[~mark])
        return [(int(k), x.astype({"key": "int64"})) for k, x in states.groupby("segment")]

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for segment, held in segments(part):
            keys, truth = held["key"].to_numpy(), held["truth"].to_numpy()
            for first, count in _batches(replicates):
                w = np.zeros(count, np.int64)
                p = np.zeros(count, np.int64)
                for a in range(0, len(keys), AT_ONCE):
                    each = weights(keys[a : a + AT_ONCE], first, count, seed)
                    w += each.sum(0, dtype=np.uint32)
                    p += each[truth[a : a + AT_ONCE] == 1].sum(0, dtype=np.uint32)
                out.append((held["model"].iloc[0], held["slice"].iloc[0], segment, held["hot"].iloc[0], held["score"].max(), first, w, p))
        return pd.DataFrame(out, columns=["model", "slice", "segment", "hot", "top", "first", "w", "p"])

    exact_key = cut.withColumn("key", F.col("key").cast("decimal(20,0)"))  # a missing key must not make floats of the others
    own = F.when(F.col("hot"), F.col("score"))  # a hot score's slices are its own
    totals = exact_key.withColumn("own", own).groupBy("model", "slice", "own").applyInPandas(sums, "model string, slice long, segment long, hot boolean, top double, first long, w array<long>, p array<long>")
    totals = written_once(totals)

    def carry(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["top", "hot", "slice"], ascending=[False, True, True], kind="stable")
        w, p = np.stack(part["w"].to_list()), np.stack(part["p"].to_list())
        above_w, above_p = np.cumsum(w, 0) - w, np.cumsum(p, 0) - p
        positives = p.sum(0)
        out, at = [], 0
        model, first = part["model"].iloc[0], part["first"].iloc[0]
        slices, segment, hot, top = part["slice"].to_numpy(), part["segment"].to_numpy(), part["hot"].to_numpy(bool), part["top"].to_numpy()
        while at < len(part):
            if not hot[at]:
                out.append((model, slices[at], segment[at], first, above_w[at], above_p[at], positives, None))
                at += 1
                continue
            end = at
            while end < len(part) and hot[end] and top[end] == top[at]:
                end += 1
            stops, tp, own = above_w[at] + w[at:end].sum(0), above_p[at] + p[at:end].sum(0), p[at:end].sum(0)
            out.append((model, None, None, first, None, None, None, _share(own, positives) * _share(tp, stops)))
            at = end
        return pd.DataFrame(out, columns=["model", "slice", "segment", "first", "w", "p", "positives", "value"])

    carried = written_once(totals.groupBy("model", "first").applyInPandas(carry, "model string, slice long, segment long, first long, w array<long>, p array<long>, positives array<long>, value array<double>"))

    def fold(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        for segment, held in segments(part):
            keys, truth, score = held["key"].to_numpy(), held["truth"].to_numpy(), held["score"].to_numpy()
            last = np.append(score[1:] != score[:-1], True)
            for row in above[above["segment"] == segment].to_dict("records"):
                first, stops, tp, positives = int(row["first"]), np.array(row["w"]), np.array(row["p"]), np.array(row["positives"])
                value, own = np.zeros(len(stops)), np.zeros(len(stops), np.int64)  # own: positives of the score so far
                for a in range(0, len(keys), AT_ONCE):
                    each = weights(keys[a : a + AT_ONCE], first, len(stops), seed)
                    hits = each * truth[a : a + AT_ONCE, None].astype(np.uint8)
                    ends = np.flatnonzero(last[a : a + AT_ONCE])
                    done = ends[-1] + 1 if len(ends) else 0
                    if done:  # equal scores are added up before anything is divided
                        starts = np.append(0, ends[:-1] + 1)
                        added, gained = (np.add.reduceat(x[:done], starts, axis=0, dtype=np.int64) for x in (each, hits))
                        all_stops, all_tp = stops + np.cumsum(added, 0), tp + np.cumsum(gained, 0)
                        gained[0] += own
                        value += np.einsum("ij,ij->j", gained, all_tp / np.maximum(all_stops, 1))
                        stops, tp, own = all_stops[-1], all_tp[-1], 0
                    more = hits[done:].sum(0, dtype=np.int64)
                    stops, tp, own = stops + each[done:].sum(0, dtype=np.int64), tp + more, own + more
                value = _share(value, positives)
                out.append((held["model"].iloc[0], first, value))
        return pd.DataFrame(out, columns=["model", "first", "value"])

    cold = exact_key.where(~F.col("hot")).groupBy("model", "slice").cogroup(carried.where("value is null").groupBy("model", "slice")).applyInPandas(fold, "model string, first long, value array<double>")
    parts = cold.unionAll(carried.where("value is not null").select("model", "first", "value"))
    each = parts.select("model", "first", F.posexplode("value").alias("k", "value"))
    return each.groupBy("model", (F.col("first") + F.col("k")).alias("replicate")).agg(F.sum("value").alias("value"))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b``, 0 where there is nothing."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def ap_bootstrap(states: DataFrame, better: str, base: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``metric, low, high`` of the gain in tie-aware average precision, questions resampled.

    Scales with states and replicates: no row for each question and replicate,
    no task that sees all states.  A model without states counts as precision 0.
    """
    ap = weighed_precision(states.where(F.col("model").isin(better, base)), replicates, seed)
    pick = lambda m: F.coalesce(F.max(F.when(F.col("model") == m, F.col("value"))), F.lit(0.0))
    gains = ap.groupBy("replicate").agg((pick(better) - pick(base)).alias("value")).withColumn("metric", F.lit("average_precision"))
    return percentile_rows(gains, replicates)


def grouped_ap_bootstrap(states: DataFrame, better: str, base: str, replicates: int, seed: int) -> DataFrame:
    """Interval of the AP difference (tie-aware) with questions resampled.

    ``states(model, question_id, score, truth)``; a question drawn twice counts twice.
    """
    spark = states.sparkSession
    names = ordinal(states.select("question_id").distinct(), "question_id", name="pick")
    n = names.count()
    times = draws(spark, n, replicates, seed).groupBy("replicate", "pick").agg(F.count("*").alias("times")).join(names, "pick")
    by_score = times.join(states, "question_id").groupBy("replicate", "model", "score").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("truth")).alias("pos"))
    down = Window.partitionBy("replicate", "model").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("replicate", "model")
    steps = by_score.select("replicate", "model", "pos", F.sum("n").over(down).alias("stops"), F.sum("pos").over(down).alias("tp"), F.sum("pos").over(every).alias("positives"))
    ap = steps.groupBy("replicate", "model").agg(F.sum(F.when(F.col("positives") > 0, F.col("pos") / F.col("positives") * F.col("tp") / F.col("stops")).otherwise(0.0)).alias("ap"))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("ap")))
    return percentile_rows(ap.groupBy("replicate").agg((pick(better) - pick(base)).alias("value")).withColumn("metric", F.lit("average_precision")), replicates)


def exact_sums(values: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Sums of the columns over ``replicates`` resamples of the rows, by the generator's own stream."""
    n = len(values)
    picks = Picks(n, seed)
    out = []
    for a in range(0, replicates, step := max(1, 2_000_000 // n)):
        rows = min(step, replicates - a)
        out.append(values[picks.take(rows * n)].reshape(rows, n, -1).sum(1))
    return np.concatenate(out)


def percentiles(values: np.ndarray, last_exclusive: bool = True) -> tuple[float, float]:
    base = len(values) if last_exclusive else len(values) - 1
    ordered = np.sort(values)
    return float(ordered[int(0.025 * base)]), float(ordered[int(0.975 * base)])


def exact_bootstrap(deltas: np.ndarray, replicates: int, seed: int, last_exclusive: bool = True) -> tuple[float, float, float]:
    """(estimate, low, high) of the mean, by the generator's own stream."""
    means = exact_sums(deltas[:, None], replicates, seed)[:, 0] / len(deltas)
    return float(deltas.mean()), *percentiles(means, last_exclusive)


def exact_three(values: np.ndarray, replicates: int, seed: int) -> list[tuple[str, float, float, float]]:
    """As ``three_metric_intervals``; ``values`` has quality, avoidable, native of a question a row."""

    def stats(sums):
        share = np.divide(sums[:, 1], sums[:, 2], out=np.zeros(len(sums)), where=sums[:, 2] != 0)
        return {"quality_headroom": sums[:, 0] / len(values), "avoidable_search_fraction": share, "mean_search_reduction": sums[:, 1] / len(values)}

    whole, drawn = stats(values.sum(0, keepdims=True)), stats(exact_sums(values, replicates, seed))
    return [(k, float(whole[k][0]), *percentiles(v, last_exclusive=False)) for k, v in drawn.items()]


def tied_precision(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """Average precision over distinct scores, of states that count ``weight`` times; 0 without positives."""
    order = np.argsort(-score, kind="stable")
    last = np.append(np.flatnonzero(np.diff(score[order])), len(score) - 1)
    stops, tp = np.cumsum(weight[order])[last], np.cumsum((weight * truth)[order])[last]
    if not len(tp) or not tp[-1]:
        return 0.0
    return float((np.diff(tp, prepend=0) / tp[-1] * np.divide(tp, stops, out=np.zeros(len(tp)), where=stops > 0)).sum())


def gains_of(question: np.ndarray, base: tuple[np.ndarray, np.ndarray], better: tuple[np.ndarray, np.ndarray], times: np.ndarray) -> float:
    return tied_precision(*better, times[question]) - tied_precision(*base, times[question])


def exact_ap_difference(question: np.ndarray, base: tuple[np.ndarray, np.ndarray], better: tuple[np.ndarray, np.ndarray], replicates: int, seed: int) -> tuple[float, float, float]:
    """(estimate, low, high) of the gain in tie-aware average precision, questions resampled.

    ``question`` numbers each state's question 0 .. n-1; ``base`` and ``better``
    are (scores, truths) of the same states.
    """
    n = int(question.max()) + 1
    picks = Picks(n, seed)
    drawn = np.array([gains_of(question, base, better, np.bincount(picks.take(n), minlength=n)) for _ in range(replicates)])
    return gains_of(question, base, better, np.ones(n, int)), *percentiles(drawn)


def folded(x: np.ndarray, most: int) -> np.ndarray:
    """Sums of the columns of numbers up to ``most``; halves are added first, in their own small type."""
    while len(x) % 2 == 0:
        if (most := 2 * most) > np.iinfo(x.dtype).max:
            x = x.astype(np.uint32)
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    return x.sum(0, dtype=np.int64)


def accepted(spark: SparkSession, streams: list[tuple[int, int]], replicates: int) -> list[tuple[int, list[int]]]:
    """Raw numbers of a block, and the picks that each block makes, for all replicates of each of ``streams`` (n, seed).

    Raw numbers that are too large for n are thrown away, so where a replicate
    begins depends on all before it.  Blocks are counted in parallel; the driver
    holds one number a block, of which a stream has a few thousand.
    """
    known: list[list[int]] = [[] for _ in streams]
    raws = [replicates * n * 2 ** n.bit_length() // n for n, _ in streams]
    size = [-(-max(RAW_BLOCK, min(16 * RAW_BLOCK, r // PLACES), r // (4 * PLACES)) // WORDS) * WORDS for r in raws]
    while True:
        missing = []
        for i, (n, seed) in enumerate(streams):
            left = replicates * n - sum(known[i])
            if left > 0:
                more = math.ceil((left * 2 ** n.bit_length() / n) * 1.001 / size[i])
                missing += [(i, len(known[i]) + k, min(LANES, more - k)) for k in range(0, more, LANES)]
        if not missing:
            return list(zip(size, known))

        def count(batches):
            for batch in batches:
                for i, block, lanes in zip(*(c.to_pylist() for c in batch.columns)):
                    n, stream = streams[i][0], Lanes(*streams[i], block * size[i], size[i], lanes)
                    found = sum(folded((stream.next() < n).view(np.uint8), 1) for _ in range(size[i] // WORDS))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * lanes, pa.int64()), pa.array(range(block, block + lanes), pa.int64()), pa.array(found)], ["stream", "block", "accepted"])

        for r in spread(spark, missing, "stream long, block long, lanes long").mapInArrow(count, "stream long, block long, accepted long").orderBy("stream", "block").collect():
            known[r.stream].append(r.accepted)


def places(spark: SparkSession, streams: list[tuple[int, int]], replicates: int) -> list[tuple[int, int, int, int, int]]:
    """Jobs ``(stream, first, count, raw, skip)`` that make all replicates of ``streams`` (n, seed).

    A job enters the stream at a block's first raw number and skips ``skip`` picks.
    """
    out = []
    for i, (size, known) in enumerate(accepted(spark, streams, replicates)):
        n, before, entries = streams[i][0], 0, max(1, min(ENTRIES, replicates // (ABREAST // 2)))
        for a in range(0, len(known), step := -(-len(known) // entries)):
            held = sum(known[a : a + step])
            first, end = math.ceil(before / n), min(replicates, math.ceil((before + held) / n))
            if end > first:
                out.append((i, first, end - first, a * size, first * n - before))
            before += held
    return out


def spread(spark: SparkSession, jobs: list[tuple], schema: str) -> DataFrame:
    """A frame of a few thousand jobs at most, dealt evenly to tasks."""
    return spark.createDataFrame(jobs, schema).repartition(max(1, min(len(jobs), 1000)))


def replayed(spark: SparkSession, streams: list[tuple[int, int]], replicates: int, values, names: list[str]) -> DataFrame:
    """``stream, replicate`` and the columns ``names``, the same as one task would draw.

    ``values(stream, picks, n, count)`` makes batches of rows of numbers, a row
    for each of the next ``count`` replicates of n picks.
    """
    jobs = spread(spark, places(spark, streams, replicates), "stream long, first long, count long, raw long, skip long")

    def run(batches):
        for batch in batches:
            for stream, first, count, raw, skip in zip(*(batch.column(c).to_pylist() for c in range(5))):
                n, seed = streams[stream]
                picks = Picks(n, seed, raw)
                picks.skip(skip)
                for found in values(stream, picks, n, count):
                    found = np.asarray(found, float).reshape(-1, len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), stream)), pa.array(np.arange(first, first + len(found))), *(pa.array(found[:, c]) for c in range(len(names)))], ["stream", "replicate", *names])
                    first += len(found)

    return jobs.mapInArrow(run, ", ".join(["stream long", "replicate long", *(f"{c} double" for c in names)]))


class Blocks:
    """Packed blocks of one table: ``(rows, file)`` each, in order, a file one row of binary columns.

    They are read in runs of about ``KEPT`` bytes; a task keeps them if one run holds all.
    """

    def __init__(self, files: list[tuple[int, str]], types: dict[str, str]):
        self.files, self.types, self.kept = files, types, None
        most = max(1, KEPT // (PACKED * sum(np.dtype(t).itemsize for t in types.values())))
        self.runs = [files[a : a + most] for a in range(0, len(files), most)]

    def __reduce__(self):
        return Blocks, (self.files, self.types)

    def _read(self, run: list[tuple[int, str]]) -> dict[str, np.ndarray]:
        parts = []
        for _, path in run:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                parts.append(pq.read_table(file, columns=list(self.types)))
        return {c: np.concatenate([np.frombuffer(x.column(c)[0].as_py(), t) for x in parts]) for c, t in self.types.items()}

    def __iter__(self):
        """``first row, rows, columns`` of each run."""
        before = 0
        for run in self.runs:
            found = self.kept or self._read(run)
            if len(self.runs) == 1:
                self.kept = found
            rows = sum(n for n, _ in run)
            yield before, rows, found
            before += rows


def packed(rows: DataFrame, by: list[str], order: str, types: dict[str, str]) -> dict[tuple, Blocks]:
    """``rows`` written as blocks of ``PACKED`` rows in the shared folder, a table for each group of ``by``.

    ``order`` numbers the rows of a group from 0.  The driver holds the names of the files.
    """
    spark = rows.sparkSession

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return pd.DataFrame([(*(part[k].iloc[0] for k in [*by, "block"]), len(part), *(part[c].to_numpy(t).tobytes() for c, t in types.items()))], columns=[*by, "block", "rows", *types])

    kinds = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by), "block long, rows long", *(f"{c} binary" for c in types)])
    path = shared_folder(spark)
    blocks = rows.select(*by, order, *types, F.floor(F.col(order) / PACKED).alias("block")).groupBy(*by, "block").applyInPandas(pack, kinds)
    blocks.write.option("maxRecordsPerFile", 1).parquet(path)
    found: dict[tuple, list] = {}
    for r in spark.read.parquet(path).select(*by, "block", "rows", F.input_file_name().alias("file")).collect():
        found.setdefault(tuple(r[k] for k in by), []).append((r.block, r.rows, r.file))
    return {k: Blocks([x[1:] for x in sorted(v)], types) for k, v in found.items()}


def coded(rows: DataFrame, columns: list[str], code: str) -> tuple[DataFrame, list[str], str, np.ndarray | None]:
    """``rows``, its columns to pack, their type, and the table of values: a byte a row where 256 combinations of ``columns`` do."""
    as_doubles = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})
    found = as_doubles.select(*columns).distinct().limit(257).collect()
    if len(found) > 256:
        return as_doubles, columns, "<f8", None
    table = sorted(tuple(r) for r in found)
    names = rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(table)], ", ".join([*(f"{c} double" for c in columns), f"{code} int"]))
    return as_doubles.join(F.broadcast(names), columns), [code], "u1", np.array(table, float).reshape(len(table), len(columns))


def picked_sums(blocks: Blocks, columns: list[str], table: np.ndarray | None, picks: Picks, n: int, count: int):
    """Sums over the next ``count`` replicates of n picks, a batch at a time."""

    def values(held: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Sums of the values at each row of ``at``."""
        if table is None:
            return np.stack([held[c].take(at).sum(1) for c in columns], 1)
        return np.stack([np.bincount(x, minlength=len(table)) for x in held[columns[0]].take(at)]) @ table

    if n <= PICKED and len(blocks.runs) == 1:
        [(_, _, held)] = blocks
        for a in range(0, count, step := max(1, PICKED // n)):
            rows = min(step, count - a)
            yield values(held, picks.take(rows * n).reshape(rows, n))
        return
    for _ in range(count):
        total = 0
        for a in range(0, n, PICKED):
            at = picks.take(min(PICKED, n - a))
            for first, rows, held in blocks:
                inside = at if rows == n else at[(at >= first) & (at < first + rows)] - first
                total = total + values(held, inside[None, :])
        yield total


def pickable(blocks: Blocks, columns: list[str], table: np.ndarray | None) -> list[tuple[np.ndarray, int, int]]:
    """An array a column, a number that is added to it, and its largest: bytes if they can hold the column.

    A 0 follows the last row, which stands for raw numbers that are no picks.
    """
    runs = [held for _, _, held in blocks]
    held = {c: np.concatenate([x[c] for x in runs]) for c in columns}
    out = []
    for k, c in enumerate(columns if table is None else range(table.shape[1])):
        found = held[c] if table is None else table[:, k]
        low = found.min()
        if np.isfinite(found).all() and (found == np.rint(found)).all() and found.max() - low <= 255 and abs(low) < 1 << 52:
            found, low = (found - low).astype(np.uint8), int(low)
        else:
            low = 0
        most = int(found.max()) if found.dtype == np.uint8 else 0
        out.append((np.append(found if table is None else found.take(held[columns[0]]), found.dtype.type(0)), low, most))
    return out


def lane_sums(values: list[tuple[np.ndarray, int, int]], n: int, seed: int, size: int, block: int, before: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What some blocks of a stream, from ``block`` on, hold of each replicate: replicates, and a row of sums for each.

    ``before`` tells how many picks the blocks before each of them make.
    """
    stream, lanes = Lanes(n, seed, block * size, size, len(before)), len(before)
    at, index = np.array(before, np.int64), np.empty((WORDS, lanes), np.int64)
    running = np.zeros((len(values), lanes))
    replicates, sums = [], []
    for _ in range(size // WORDS):
        np.copyto(index, stream.next())
        inside = stream.out < n
        picks = folded(inside.view(np.uint8), 1)
        ends = (at + picks) // n > at // n
        for k, (held, low, most) in enumerate(values):
            found = held.take(index, mode="clip")
            running[k, ~ends] += ((folded(found, most) + low * picks) if most or found.dtype == np.uint8 else found.sum(0))[~ends]
        for lane in np.flatnonzero(ends):  # replicates end here
            own = index[inside[:, lane], lane]
            cuts = np.arange(n - at[lane] % n, picks[lane] + 1, n)
            parts = np.stack([np.add.reduceat(np.append(held.take(own).astype(float) + low, 0.0), np.append(0, cuts)) for held, low, _ in values], 1)
            parts[0] += running[:, lane]
            running[:, lane] = parts[-1]
            replicates.append(at[lane] // n + np.arange(len(cuts)))
            sums.append(parts[:-1])
        at += picks
    return np.concatenate([*replicates, at // n]), np.concatenate([*sums, running.T])


def replicate_sums(spark: SparkSession, streams: list[tuple[int, int]], replicates: int, sent: list[tuple], names: list[str]) -> DataFrame:
    """``stream, replicate`` and sums over its picks, the same as one task would draw.

    ``sent`` has blocks, columns and table (see ``coded``) of each stream.
    Tables that a task cannot keep are read in runs, a replicate at a time.
    """
    wide = [len(blocks.runs) > 1 or n * 8 * len(names) > 8 * KEPT for (n, _), (blocks, _, _) in zip(streams, sent)]
    if any(wide):
        return replayed(spark, streams, replicates, lambda i, picks, n, count: picked_sums(*sent[i], picks, n, count), names)
    jobs = []
    for i, (size, known) in enumerate(accepted(spark, streams, replicates)):
        before = [0, *np.cumsum(known).tolist()]
        jobs += [(i, size, k, before[k : min(k + LANES, len(known))]) for k in range(0, len(known), LANES)]

    def run(batches):
        for batch in batches:
            for i, size, block, before in zip(*(c.to_pylist() for c in batch.columns)):
                found, sums = lane_sums(pickable(*sent[i]), *streams[i], size, block, before)
                kept = found < replicates
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), i)), pa.array(found[kept]), *(pa.array(x) for x in sums[kept].T)], ["stream", "replicate", *names])

    shape = ", ".join(["stream long", "replicate long", *(f"{c} double" for c in names)])
    parts = spread(spark, jobs, "stream long, size long, block long, before array<long>").mapInArrow(run, shape)
    return parts.groupBy("stream", "replicate").agg(*(F.sum(c).alias(c) for c in names))


def checked(sizes: list[int]) -> None:
    if max(sizes, default=0) > EXACT_QUESTIONS:
        raise ValueError(f"{max(sizes)} questions; the exact mode takes {EXACT_QUESTIONS}")


def exact_paired(rows: DataFrame, seeds: dict[tuple[str, str], int], by: str = "comparison", order: str = "question_id", replicates: int = REPLICATES) -> DataFrame:
    """``by, metric, estimate, low, high`` of the mean of each metric of each group, by the published streams.

    ``seeds`` names (group, metric); metrics are columns of ``rows``; groups
    without a row have no result.
    """
    spark, metrics = rows.sparkSession, list(dict.fromkeys(m for _, m in seeds))
    numbered = ordinal(written_once(rows.where(F.col(by).isNotNull()).select(by, order, *metrics)), by, order, name="at")
    groups = {r[by]: r for r in numbered.groupBy(by).agg(F.min("at").alias("base"), F.count("*").alias("n"), *(F.avg(F.col(m).cast("double")).alias(m) for m in metrics)).collect()}  # a row a group
    named = [(g, m) for g, m in seeds if g in groups]
    if not named:
        return spark.createDataFrame([], f"{by} string, metric string, estimate double, low double, high double")
    checked([r["n"] for r in groups.values()])
    bases = spark.createDataFrame([(g, r["base"]) for g, r in groups.items()], f"{by} {rows.schema[by].dataType.simpleString()}, base long")
    own = numbered.join(F.broadcast(bases), by).withColumn("at", F.col("at") - F.col("base"))
    sent = {}
    for m in metrics:
        values, columns, kind, table = coded(own.select(by, "at", m), [m], "code")
        for (g,), blocks in packed(values, [by], "at", {c: kind for c in columns}).items():
            sent[g, m] = (blocks, columns, table)
    sums = replicate_sums(spark, [(groups[g]["n"], seeds[g, m]) for g, m in named], replicates, [sent[k] for k in named], ["value"])
    what = spark.createDataFrame([(i, g, m, groups[g]["n"], groups[g][m]) for i, (g, m) in enumerate(named)], f"stream long, {by} string, metric string, n long, estimate double")
    bounds = what.join(percentile_rows(sums, replicates, by=("stream",)), "stream")  # a mean rises with its sum
    return bounds.select(by, "metric", "estimate", (F.col("low") / F.col("n")).alias("low"), (F.col("high") / F.col("n")).alias("high"))


def three_of(sums: np.ndarray, n: int) -> np.ndarray:
    """Headroom, avoidable share of searches, mean reduction, a row each of ``sums``."""
    sums = np.asarray(sums, float).reshape(-1, 3)
    share = np.divide(sums[:, 1], sums[:, 2], out=np.zeros(len(sums)), where=sums[:, 2] != 0)
    return np.stack((sums[:, 0] / n, share, sums[:, 1] / n), 1)


def exact_three_intervals(questions: DataFrame, replicates: int = REPLICATES, seed: int = GATE_SEED, order: str = "question_id") -> DataFrame:
    """As ``three_metric_intervals``, by the published stream."""
    spark, names, columns = questions.sparkSession, ["quality_headroom", "avoidable_search_fraction", "mean_search_reduction"], ["quality", "avoidable", "native"]
    numbered = ordinal(questions.select(order, *columns), order, name="at")
    whole = numbered.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).first()
    checked([n := whole["n"]])
    values, held, kind, table = coded(numbered.select("at", *columns), columns, "code")
    blocks = packed(values, [], "at", {c: kind for c in held})[()]
    drawn = replicate_sums(spark, [(n, seed)], replicates, [(blocks, held, table)], columns)
    long = drawn.select(_three(F.col("quality"), F.col("avoidable"), F.col("native"), F.lit(n)).alias("m")).select("m.metric", "m.value")
    estimates = three_of(np.array([[whole[c] for c in columns]], float), n)[0].tolist()
    return spark.createDataFrame(list(zip(names, estimates)), "metric string, estimate double").join(percentile_rows(long, replicates, last_exclusive=False), "metric")


def by_score(states: DataFrame, model: str) -> Blocks:
    """``states(at, truth)`` and a column of scores as blocks that descend by score; ``last`` marks the end of equal scores."""
    falling = F.desc_nulls_last(model)
    ranged = states.select("at", "truth", F.col(model).cast("double").alias(model))
    numbered = ordinal(ranged, falling, F.col("truth"), name="place")
    # the next block's first score tells whether a block ends within equal scores
    groups = numbered.groupBy(model).agg(F.max("place").alias("place"), F.lit(1).alias("last"))
    rows = numbered.join(groups.select("place", "last"), "place", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    return packed(rows, [], "place", {"at": "<u4", "truth": "u1", "last": "u1"})[()]


def state_pieces(blocks: Blocks):
    """Runs of ``STATES`` states: their questions, where sums begin, which of these are of positives, and which end a score.

    States of one score and truth are added up, ``SHORT`` at a time, so that 16 bits hold a sum of bytes.
    """
    for _, _, held in blocks:
        for a in range(0, len(held["at"]), STATES):
            at, truth, last = (held[c][a : a + STATES] for c in ("at", "truth", "last"))
            cut = np.append(True, (last[:-1] == 1) | (truth[1:] != truth[:-1]))
            cut[::SHORT] = True
            starts = np.flatnonzero(cut)
            yield at.astype(np.int64), starts, truth[starts] == 1, last[np.append(starts[1:], len(at)) - 1] == 1


def positives_of(blocks: Blocks, times: np.ndarray) -> np.ndarray:
    """How often a positive state is drawn in each replicate."""
    total = np.zeros(times.shape[1], np.int64)
    for _, _, held in blocks:
        at = held["at"][held["truth"] == 1]
        for a in range(0, len(at), STATES):
            total += times.take(at[a : a + STATES], axis=0).sum(0, dtype=np.int64)
    return total


def falling_precision(blocks: Blocks, times: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """``tied_precision`` of the states in ``blocks`` for each column of ``times``: how often questions count, a byte each."""
    value = np.zeros(times.shape[1])
    stops, tp, open_tp = (np.zeros(times.shape[1], np.int64) for _ in range(3))  # open_tp: positives above the score at work
    for at, starts, positive, ends in state_pieces(blocks):
        sums = np.add.reduceat(times.take(at, axis=0), starts, axis=0, dtype=np.uint16).astype(np.int64)
        all_stops = stops + np.cumsum(sums, 0)
        sums[~positive] = 0
        all_tp = tp + np.cumsum(sums, 0)
        if ends.any():
            at_end = all_tp[ends]
            value += (_share(np.diff(at_end, axis=0, prepend=open_tp[None]), positives) * _share(at_end, all_stops[ends])).sum(0)
            open_tp = at_end[-1]
        stops, tp = all_stops[-1], all_tp[-1]
    return value


def falling_gain(better: Blocks, base: Blocks, times: np.ndarray) -> np.ndarray:
    positives = positives_of(base, times)
    return falling_precision(better, times, positives) - falling_precision(base, times, positives)


def counted_picks(picks: Picks, n: int, count: int):
    """How often each of n questions, a row each, is drawn in the next replicates, a column each, some at a time."""
    for first in range(0, count, step := max(1, min(ABREAST, KEPT // n))):
        times = np.zeros((min(step, count - first), n), np.uint8)  # a question is not drawn 256 times in n draws, or its count is an error
        for row in times:
            for a in range(0, n, PICKED):
                np.add.at(row, picks.take(min(PICKED, n - a)), np.uint8(1))
            if int(row.sum(dtype=np.int64)) != n:
                raise OverflowError("a question was drawn more than 255 times")
        yield np.ascontiguousarray(times.T)


def exact_ap_interval(states: DataFrame, better: str, base: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``metric, estimate, low, high`` of the gain in average precision, by the published stream.

    ``states(question_id, state_index, truth)`` and a column of scores for each
    of the two models.  A task holds a byte, or two, for each question and each
    of the replicates it weighs side by side, and streams states.
    """
    spark = states.sparkSession
    questions = ordinal(states.select("question_id").distinct(), "question_id", name="at")
    n = questions.count()
    checked([n])
    numbered = written_once(states.join(questions, "question_id").select("at", "truth", better, base))
    sent = by_score(numbered, better), by_score(numbered, base)
    drawn = replayed(spark, [(n, seed)], replicates, lambda _, picks, n, count: (falling_gain(*sent, times) for times in counted_picks(picks, n, count)), ["value"]).withColumn("metric", F.lit("average_precision"))
    whole = spark.range(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([falling_gain(*sent, np.ones((n, 1), np.uint8))[0]] * b.num_rows, pa.float64())], ["estimate"]) for b in batches), "estimate double")
    return percentile_rows(drawn, replicates).join(whole).select("metric", "estimate", "low", "high")


def comparison_pairs(models: list[str], reference: str = "structured_base") -> list[tuple[str, str]]:
    """(model, base) for every model but the base: the reference, or the first one if it is not there."""
    against = reference if reference in models else models[0]
    return [(m, against) for m in models if m != against]
