"""Metrics over scored states and policy outcomes; long tables, one plan for all models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scores import clipped_sigmoid, ratio, wilson_upper


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def fractions(rows: DataFrame, key: str) -> DataFrame:
    """Share of each value; the window sees one row a value."""
    counts = count_by(rows, key)
    return counts.select(key, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction"))


def confusion(states: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per model: tp, fp, fn, tn at its threshold, and rates from them.

    ``states(model, score, truth)`` with truth 0 or 1.
    """
    stop = F.col("score") >= F.col("threshold")
    good = F.col("truth") == 1
    counts = states.join(F.broadcast(thresholds), "model").groupBy("model").agg(
        F.count_if(stop & good).alias("tp"), F.count_if(stop & ~good).alias("fp"), F.count_if(~stop & good).alias("fn"), F.count_if(~stop & ~good).alias("tn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns({
        "precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")),
        "stop_rate": ratio(F.col("tp") + F.col("fp"), n), "unsafe_stop_rate": ratio("fp", n),
    })


#: Slices of the angle of a score; a slice is the largest unit of a running total.
SLICES = 2048

#: Positions of a block of rows of equal score.
POSITIONS = 65_536


def _slice(score: Column) -> Column:
    """A number that never falls as the score rises; not-a-number comes above all."""
    return F.when(F.isnan(score), SLICES * 2).otherwise(F.floor(F.atan(score) * SLICES)).cast("long")


def _running(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows(model, score, n, pos, ..)`` with totals up to each row: ``stops``, ``tp``, and ``positives`` of the model.

    ``order`` starts with the score, descending.  A task sees one slice of the
    scores of a model; the slices before it are a row each, at most 6,436 a model.
    """
    sliced = rows.withColumn("_slice", _slice(F.col("score")))
    inner = Window.partitionBy("model", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sliced.groupBy("model", "_slice").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    before = Window.partitionBy("model").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("model").alias("_model"), F.col("_slice").alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_stops"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("_tp"),
        F.sum("pos").over(Window.partitionBy("model")).alias("positives"),
    )
    totals = sliced.withColumns({"_n": F.sum("n").over(inner), "_pos": F.sum("pos").over(inner)})
    met = totals.join(F.broadcast(bases), F.col("model").eqNullSafe(F.col("_model")) & F.col("_slice").eqNullSafe(F.col("_at")))
    return met.select(*rows.columns, (F.col("_stops") + F.col("_n")).alias("stops"), (F.col("_tp") + F.col("_pos")).alias("tp"), "positives")


def cumulative(states: DataFrame) -> DataFrame:
    """Per model and distinct score: stops and correct stops at that threshold.

    Scores are counted first, so a row is a distinct score.
    """
    by_score = states.groupBy("model", "score").agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("long")).alias("pos"))
    return _running(by_score, F.desc("score"))


def average_precision_tied(states: DataFrame) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; 0 without positives."""
    step = ratio("pos", "positives") * ratio("tp", "stops")
    return cumulative(states).groupBy("model").agg(F.sum(step).alias("average_precision"))


def average_precision_ordered(states: DataFrame, position: str = "position") -> DataFrame:
    """Mean precision at the positives, ranked by score and input position.

    Rows of one score are cut into blocks of positions, so that a score of many
    rows is many units; ranks are those of the blocks before plus those inside.
    ``position`` is a whole number.
    """
    rows = states.withColumn("_block", F.floor(F.col(position) / POSITIONS))
    key = ["model", "score", "_block"]
    blocks = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("long")).alias("pos"))
    ends = _running(blocks, F.desc("score"), F.col("_block"))
    bases = ends.select(*(F.col(c).alias(f"{c}_") for c in key), (F.col("stops") - F.col("n")).alias("_k"), (F.col("tp") - F.col("pos")).alias("_tp"))
    inner = Window.partitionBy(*key).orderBy(position)
    ranked = rows.withColumns({"_row": F.row_number().over(inner), "_hits": F.sum("truth").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    met = ranked.join(bases, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key])
    at = F.when(F.col("truth") == 1, (F.col("_tp") + F.col("_hits")) / (F.col("_k") + F.col("_row")))
    return met.groupBy("model").agg(F.coalesce(F.avg(at), F.lit(0.0)).alias("average_precision"))


def recall_at_precision(states: DataFrame, least: float) -> DataFrame:
    """Most recall with at least one stop and that precision; else 0 and nulls."""
    table = cumulative(states).withColumns({"precision": ratio("tp", "stops"), "recall": ratio("tp", "positives")})
    best = F.max(F.when(F.col("precision") >= least, F.struct("recall", "precision", F.col("score").alias("threshold")))).alias("b")
    return table.groupBy("model").agg(best).select("model", F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.col("b.precision").alias("precision"), F.col("b.threshold").alias("threshold"))


def select_threshold(states: DataFrame, least_precision: float, least_stops: int) -> DataFrame:
    """As above with a least number of stops; infeasible: never stop, above every score."""
    table = cumulative(states).withColumns({"precision": ratio("tp", "stops"), "recall": ratio("tp", "positives")})
    able = (F.col("precision") >= least_precision) & (F.col("stops") >= least_stops)
    best = F.max(F.when(able, F.struct("recall", "precision", F.col("score").alias("threshold"), "stops"))).alias("b")
    found = table.groupBy("model").agg(best, F.max("score").alias("top"))
    return found.select(
        "model", F.col("b").isNotNull().alias("feasible"), F.coalesce("b.threshold", F.col("top") + 1).alias("threshold"),
        F.coalesce("b.precision", F.lit(0.0)).alias("precision"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.stops", F.lit(0)).cast("long").alias("stops"),
    )


def bin_of(p: Column, bins: int = 10) -> Column:
    """The bin with low <= p < high for bounds i / bins, the last one closed.

    The product may round across a bound, so the bounds themselves decide.
    """
    k = F.floor(p * bins)
    k = k + F.when(p >= (k + 1) / bins, 1).otherwise(0) - F.when(p < k / bins, 1).otherwise(0)
    return F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)).cast("long")


def calibration_bins(states: DataFrame, bins: int = 10) -> DataFrame:
    p = states.withColumn("p", clipped_sigmoid("score"))
    return p.groupBy("model", bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("truth").alias("mean_truth"))


def calibration(states: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error per model."""
    brier = states.withColumn("p", clipped_sigmoid("score")).groupBy("model").agg(F.avg((F.col("p") - F.col("truth")) ** 2).alias("brier"), F.count("*").alias("states"))
    gaps = calibration_bins(states, bins).groupBy("model").agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_truth"))).alias("gap"))
    return brier.join(gaps, "model").select("model", "states", "brier", (F.col("gap") / F.col("states")).alias("ece"))


def policy_metrics(outcomes: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Means of ``first_crossing`` outcomes per model.

    ``opportunities(question_id, earliest_safe)``: null where there is none.
    """
    o = outcomes.join(opportunities, "question_id", "left")
    early, safe = F.col("stopped_early"), F.col("stopped_early") & (F.col("em") == 1)
    able = F.col("earliest_safe").isNotNull()
    sums = o.groupBy("model").agg(
        F.count("*").alias("questions"), F.avg("em").alias("mean_em"), F.avg("f1").alias("mean_f1"), F.avg("searches").alias("mean_searches"),
        F.sum((F.col("native_searches") - F.col("searches")).cast("long")).alias("searches_saved"),
        F.count_if(early).alias("early_stops"), F.count_if(safe).alias("safe_stops"), F.count_if(early & (F.col("em") == 0)).alias("unsafe_stops"),
        F.count_if(able).alias("opportunities"), F.count_if(able & safe).alias("caught"), F.avg(F.when(safe & able, F.col("stop_index") - F.col("earliest_safe"))).alias("mean_delay"),
        F.count_if((F.col("native_em") == 1) & (F.col("em") == 0)).alias("correct_to_wrong"), F.count_if((F.col("native_em") == 0) & (F.col("em") == 1)).alias("wrong_to_correct"),
    )
    return sums.withColumns({"accepted_risk": ratio("unsafe_stops", "early_stops"), "opportunity_recall": ratio("caught", "opportunities")})


def native_metrics(natives: DataFrame) -> DataFrame:
    return natives.agg(F.count("*").alias("questions"), F.avg("native_em").alias("mean_em"), F.avg("native_f1").alias("mean_f1"), F.avg("native_searches").alias("mean_searches"))


def core_policy(outcomes: DataFrame, reach: DataFrame) -> DataFrame:
    """The older report: coverage, wrong and premature stops, rescues, risk bound.

    ``reach(question_id, state_index, reachable)``: a correct state comes later.
    """
    o = outcomes.join(reach, (outcomes.question_id == reach.question_id) & (outcomes.stop_index == reach.state_index), "left").select(outcomes["*"], "reachable")
    early, wrong = F.col("stopped_early"), F.col("stopped_early") & (F.col("em") == 0)
    later = F.coalesce("reachable", F.lit(False)) | (F.col("native_em") == 1)
    sums = o.groupBy("model").agg(
        F.count("*").alias("questions"), F.avg("em").alias("em"), F.avg("searches").alias("searches"), F.avg("native_em").alias("native_em"), F.avg("native_searches").alias("native_searches"),
        F.count_if(early).alias("stops"), F.count_if(wrong).alias("wrong_stops"), F.count_if(wrong & later).alias("premature_stops"),
        F.count_if(early & (F.col("em") == 1) & (F.col("native_em") == 0)).alias("harmful_search_rescues"),
    )
    return sums.select(
        "model", "questions", "em", "searches", (F.col("em") - F.col("native_em")).alias("em_delta"), ratio(F.col("native_searches") - F.col("searches"), "native_searches").alias("search_reduction"),
        ratio("stops", "questions").alias("coverage"), "stops", "wrong_stops", "premature_stops", "harmful_search_rescues", wilson_upper("wrong_stops", "stops").alias("accepted_risk_upper_90"),
    )


def improvement_flags(core: DataFrame, ap: DataFrame, better: str, base: str) -> DataFrame:
    """Six comparisons of two models, one row."""
    both = core.join(ap, "model")
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return both.agg(
        (pick(better, "average_precision") > pick(base, "average_precision")).alias("ap_improved"), (pick(better, "em") >= pick(base, "em")).alias("em_not_worse"),
        (pick(better, "search_reduction") > pick(base, "search_reduction")).alias("reduction_improved"), (pick(better, "wrong_stops") < pick(base, "wrong_stops")).alias("fewer_wrong_stops"),
        (pick(better, "premature_stops") < pick(base, "premature_stops")).alias("fewer_premature_stops"), (pick(better, "accepted_risk_upper_90") < pick(base, "accepted_risk_upper_90")).alias("risk_bound_improved"),
    )


def headroom_questions(states: DataFrame, natives: DataFrame) -> DataFrame:
    """Per question: quality and cost oracle, rescues, avoidable searches."""
    search = F.col("next_action") == "SEARCH"
    sums = states.groupBy("question_id").agg(
        F.min(F.when((F.col("em") == 1), F.col("state_index"))).alias("earliest_correct"), F.min(F.when((F.col("em") == 1) & search, F.col("state_index"))).alias("earliest_early_stop"),
        F.count_if(search).alias("search_states"),
    )
    q = natives.join(sums, "question_id")
    able = F.col("earliest_early_stop").isNotNull()
    cost = F.when((F.col("native_em") == 1) & able, F.least("native_searches", "earliest_early_stop")).otherwise(F.col("native_searches")).cast("long")
    return q.withColumns({
        "quality_oracle": ((F.col("native_em") == 1) | able).cast("int"), "terminal_only_rescue": ((F.col("native_em") == 0) & ~able & F.col("earliest_correct").isNotNull()).cast("int"),
        "cost_oracle": cost, "avoidable": F.col("native_searches") - cost,
    })


def headroom(questions: DataFrame) -> DataFrame:
    return questions.agg(
        F.count("*").alias("questions"), F.avg("native_em").alias("native_em"), F.avg("quality_oracle").alias("quality_oracle"), F.sum("terminal_only_rescue").cast("long").alias("terminal_only_rescues"),
        F.sum("avoidable").alias("avoidable_searches"), F.sum("native_searches").cast("long").alias("native_searches"), F.avg("cost_oracle").alias("mean_oracle_searches"),
    ).withColumns({"quality_headroom": F.col("quality_oracle") - F.col("native_em"), "avoidable_fraction": ratio("avoidable_searches", "native_searches")})


def cells(rows: DataFrame, now: str, native: str) -> DataFrame:
    """Counts of correct or wrong now by native correct or wrong."""
    name = lambda c: F.when(F.col(c) == 1, "correct").otherwise("wrong")
    return rows.groupBy(name(now).alias("now"), name(native).alias("native")).agg(F.count("*").alias("n"))


def budget_curve(reachable: DataFrame, natives: DataFrame) -> DataFrame:
    """Means of ``last_reachable`` per budget, and exact coverage."""
    return reachable.groupBy("budget").agg(F.avg("em").alias("mean_em"), F.avg("f1").alias("mean_f1"), F.avg("state_index").alias("mean_searches"), F.count_if("covered").alias("covered"), F.count("*").alias("questions"))


def supplement(states: DataFrame) -> DataFrame:
    """State and question rates of a separate universe of states."""
    by_question = states.groupBy("question_id").agg(F.max("em").alias("any_correct"), F.count("*").alias("n"), F.sum("em").alias("c"))
    return by_question.agg(F.sum("n").cast("long").alias("states"), F.sum("c").cast("long").alias("correct_states"), F.count("*").alias("questions"), F.count_if(F.col("any_correct") == 1).alias("rescued_questions")).withColumn("state_rate", ratio("correct_states", "states"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return rows.agg(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.raise_error(F.lit("no tokens")).cast("double")).alias("weighted_mean"))


def loss_summary(steps: DataFrame, loss: str = "loss", order: str = "step") -> DataFrame:
    finite = F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    return steps.agg(F.min_by(loss, order).alias("first"), F.max_by(loss, order).alias("last"), F.min(loss).alias("least"), F.max(loss).alias("most"), F.bool_and(finite).alias("all_finite"))
