"""Operators on ordered groups: trajectories, states, policies.

Models are rows (column ``model``), so one plan serves all of them.  Every
operator has an explicit order column; none relies on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import NO_EVIDENCE
from waymark.operators.staging import written_once

MOST_STATES, BUDGET = 4, 3


def ordinal(df: DataFrame, *order, name: str = "sequence_index") -> DataFrame:
    """Dense numbers from 0 in an order, without sorting all rows in one task.

    Rows are range-partitioned and written once, so that a partition's rows are
    the same for whoever counts them; a partition's first number is the count of
    the rows before it, found from one small row a partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    ranged = written_once(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_base")


def with_next_action(steps: DataFrame, group: str = "question_id", order: str = "step", action: str = "action") -> DataFrame:
    """The action of the following step of any kind; ``INVALID`` after the last."""
    w = Window.partitionBy(group).orderBy(order)
    return steps.withColumn("native_next_action", F.coalesce(F.lead(action).over(w), F.lit("INVALID")))


def expand_states(steps: DataFrame, most: int = MOST_STATES, budget: int = BUDGET) -> DataFrame:
    """States of trajectories from steps ``question_id, step, action, executed, block``.

    One before the first step, and one after each executed search while fewer
    than ``most`` searches were made, with the evidence so far as context.
    """
    w = Window.partitionBy("question_id").orderBy("step")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    search = F.col("executed") & (F.col("action") == "SEARCH")
    marked = with_next_action(steps).withColumn("state_index", F.sum(search.cast("long")).over(so_far))
    # only the few searches that become states gather blocks, however long the trajectory is
    few = marked.where(search & (F.col("state_index") < most)).withColumn("context", F.array_join(F.collect_list("block").over(so_far), "\n\n"))
    later = few.select("question_id", "state_index", "native_next_action", "context")
    first = steps.groupBy("question_id").agg(F.min_by("action", "step").alias("native_next_action"))
    first = first.select("question_id", F.lit(0).cast("long").alias("state_index"), F.coalesce("native_next_action", F.lit("INVALID")).alias("native_next_action"), F.lit(NO_EVIDENCE).alias("context"))
    return first.unionByName(later).withColumns({
        "state_id": F.concat_ws(":", F.col("question_id").cast("string"), F.lit("search-state"), F.col("state_index").cast("string")),
        "turn_index": F.col("state_index") + 1,
        "remaining_search_budget": F.greatest(F.lit(0), budget - F.col("state_index")),
    })


def reconstruction(steps: DataFrame, reported: DataFrame) -> DataFrame:
    """Whether each question's counted searches equal the reported ``search_calls``."""
    counted = steps.groupBy("question_id").agg(F.count_if(F.col("executed") & (F.col("action") == "SEARCH")).alias("counted"))
    return reported.join(counted, "question_id", "left").select("question_id", (F.col("search_calls") == F.coalesce("counted", F.lit(0))).alias("consistent"))


def first_crossing(states: DataFrame, natives: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each model's outcome of each question: the first state whose score reaches
    the model's threshold, else what the agent did itself.

    ``states(model, question_id, state_index, score, em, f1)``, ``natives
    (question_id, native_em, native_f1, native_searches)``, ``thresholds
    (model, threshold)``: a row a model.  Every question of ``natives`` has a
    row for every model, also one without states.
    """
    every = natives.join(F.broadcast(thresholds.select("model")))  # a few models
    crossed = states.join(F.broadcast(thresholds), "model").where(F.col("score") >= F.col("threshold"))
    stops = crossed.groupBy("model", "question_id").agg(F.min(F.struct("state_index", "em", "f1")).alias("hit"))
    early = F.col("hit").isNotNull()
    return every.join(stops, ["model", "question_id"], "left").select(
        "model", "question_id", early.alias("stopped_early"), F.col("hit.state_index").alias("stop_index"),
        F.when(early, F.col("hit.em")).otherwise(F.col("native_em")).alias("em"), F.when(early, F.col("hit.f1")).otherwise(F.col("native_f1")).alias("f1"),
        F.when(early, F.col("hit.state_index")).otherwise(F.col("native_searches")).alias("searches"), "native_em", "native_f1", "native_searches",
    )


def earliest(states: DataFrame, condition: Column, name: str) -> DataFrame:
    """The first state index of each question at which a condition holds."""
    return states.groupBy("question_id").agg(F.min(F.when(condition, F.col("state_index"))).alias(name))


def terminal_state(states: DataFrame) -> DataFrame:
    """The first state of each question that no search follows."""
    done = F.min(F.when(F.col("next_action") != "SEARCH", F.struct("state_index", "next_action", "em"))).alias("t")
    return states.groupBy("question_id").agg(done).where("t is not null").select("question_id", "t.*")


def later_correct(em: str = "em") -> Column:
    """Whether a later state of the question is correct."""
    after = Window.partitionBy("question_id").orderBy("state_index").rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.max(em).over(after), F.lit(0)) == 1


def causal_labels(states: DataFrame) -> DataFrame:
    """STOP, CONTINUE or NO_REACHABLE_CORRECT for each search state."""
    label = F.when(F.col("em") == 1, "STOP").when(F.col("later"), "CONTINUE").otherwise("NO_REACHABLE_CORRECT")
    return states.withColumn("later", later_correct()).where("next_action = 'SEARCH'").select("question_id", "state_index", label.alias("label"))


def high_confidence_truth(states: DataFrame, natives: DataFrame) -> DataFrame:
    """STOP if correct, CONTINUE if a later state or the agent is; others go."""
    truth = F.when(F.col("em") == 1, "STOP").when(F.col("later") | (F.col("native_em") == 1), "CONTINUE")
    marked = states.withColumn("later", later_correct()).where("next_action = 'SEARCH'").join(natives, "question_id")
    return marked.select("question_id", "state_index", truth.alias("truth")).where("truth is not null")


def last_reachable(states: DataFrame, budgets: int = 4) -> DataFrame:
    """For budgets 0 .. ``budgets``: the state at that list position, else the last.

    States are numbered within their question; sums keep one state a budget,
    however many a question has.
    """
    numbered = states.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy("state_index", "em", "f1")) - 1)
    state = F.struct("state_index", "em", "f1")
    at = lambda b: F.max_by(state, F.when(F.col("_k") <= b, F.col("_k"))).alias(f"s{b}")
    each = numbered.groupBy("question_id").agg(F.max("_k").alias("top"), *(at(b) for b in range(budgets + 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("budget"), F.col(f"s{b}").alias("s")) for b in range(budgets + 1))))
    return each.select("question_id", "top", rows.alias("r")).select("question_id", "r.budget", "r.s.state_index", "r.s.em", "r.s.f1", (F.col("top") >= F.col("r.budget")).alias("covered"))


def first_candidate(trajectories: DataFrame) -> DataFrame:
    """Answer and searches of the first candidate event, or of the trajectory
    without events; a null answer of the first event stays null."""
    there = F.size("candidate_events") > 0
    first = F.get("candidate_events", F.lit(0))
    return trajectories.select("question_id", F.when(there, first["candidate_answer"]).otherwise(F.col("answer")).alias("answer"), F.when(there, first["search_calls"]).otherwise(F.col("search_calls")).alias("search_calls"))
