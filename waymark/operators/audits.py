"""Audits: a table of ``check, passed``; a run passes if every row does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.ordered import ordinal


def checks(rows: DataFrame, *by: str, **conditions) -> DataFrame:
    """One aggregation (of each group), one row a named condition; null counts as failed."""
    one = rows.groupBy(*by).agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()))
    return one.unpivot(list(by), list(conditions), "check", "passed")


def every(condition):
    """All rows hold; true for no rows."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def judge_run(rows: DataFrame, *by: str) -> DataFrame:
    """``sequence_index, request_id, state_id, expected_id, score, labels_mounted, status, kind`` of runs; ``by`` tells runs apart."""
    kind = lambda k: F.col("kind") == k
    scores, n = kind("judge_score"), F.count_if(kind("judge_score"))
    s = F.when(scores, F.col("sequence_index"))
    return checks(
        rows, *by,
        one_start=F.count_if(kind("run_start")) == 1, one_end=F.count_if(kind("run_end")) == 1, status_complete=every(~kind("run_end") | (F.col("status") == "complete")), no_errors=F.count_if(kind("judge_error")) == 0,
        ids_unique=F.count_distinct(F.when(scores, F.col("request_id"))) == n, order_exact=every(~scores | F.col("state_id").eqNullSafe(F.col("expected_id"))),
        sequence_contiguous=(F.count_distinct(s) == n) & F.coalesce((F.min(s) == 0) & (F.max(s) == n - 1), n == 0), scores_finite=every(~scores | (~F.isnan("score") & (F.abs("score") < float("inf")))), labels_absent=every(F.col("labels_mounted") == False),  # noqa: E712
    )


def bound_judge_run(records: DataFrame, inputs: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """A run of the judge against what it was given: all fourteen conditions.

    ``records(position, kind, request_id, sequence_index, score, status,
    labels_mounted, gold_fields, protocol_sha256, inputs_sha256,
    adapter_sha256)`` in order of ``position``, ``inputs(position, request_id)``
    numbered from 0, ``expected(protocol_sha256, inputs_sha256,
    adapter_sha256)``, one row a run; ``by`` tells runs apart in all three.
    Records are numbered by ranges of (run, position), so no task sorts a run.
    An adapter may be expected to be null; runs without a record fail.
    """
    kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    keys, results = list(by), records.where(kind("judge_score"))
    of = lambda c, k="run_start": F.max(F.when(kind(k), F.col(c)))
    n = F.count_if(kind("judge_score"))
    log = records.groupBy(*keys).agg(
        F.count_if(kind("run_start")).alias("starts"), F.count_if(kind("run_end")).alias("ends"), F.count_if(kind("judge_error")).alias("errors"), n.alias("results"), of("status", "run_end").alias("status"),
        F.count_distinct(F.when(kind("judge_score"), F.coalesce("request_id", F.lit(-1)))).alias("ids"),
        every(~kind("judge_score") | (~F.isnan("score") & (F.abs("score") < float("inf")))).alias("finite"), of("labels_mounted").alias("labels"), of("gold_fields").alias("gold"),
        of("protocol_sha256").alias("protocol"), of("inputs_sha256").alias("given"), of("adapter_sha256").alias("adapter"),
    )
    # results are numbered as they stand in the log
    numbered = ordinal(results.select(*keys, "position", "request_id", "sequence_index"), *keys, "position", name="at")
    first = numbered.groupBy(*keys).agg(F.min("at").alias("first"))
    placed = numbered.join(first, keys).select(*keys, (F.col("at") - F.col("first")).alias("i"), "request_id", "sequence_index")
    paired = inputs.select(*keys, F.col("position").alias("i"), F.col("request_id").alias("wanted")).join(placed, [*keys, "i"], "full")
    order = paired.groupBy(*keys).agg(every(F.col("wanted") == F.col("request_id")).alias("order_exact"))
    steps = placed.groupBy(*keys).agg(every(F.col("sequence_index") == F.col("i")).alias("contiguous"))
    sizes = inputs.groupBy(*keys).agg(F.count("*").alias("wanted"))
    one = expected.select(*keys, *(F.col(c).alias(f"expected_{c}") for c in ("protocol_sha256", "inputs_sha256", "adapter_sha256")))
    for other in (sizes, log, order, steps):
        one = one.join(other, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = lambda c, e: F.col(c).isNotNull() & (F.col(c) == F.col(f"expected_{e}"))
    conditions = {
        "one_start": F.col("starts") == 1, "one_end": F.col("ends") == 1, "status_complete": (F.col("ends") == 1) & (F.col("status") == "complete"), "no_errors": F.col("errors") == 0,
        "count_expected": F.col("results") == zero("wanted"), "order_exact": F.coalesce("order_exact", F.lit(True)) & F.col("results").isNotNull(), "ids_unique": F.col("ids") == F.col("results"),
        "sequence_contiguous": F.coalesce("contiguous", F.col("results") == 0),
        "scores_finite": F.col("finite"), "labels_absent": (F.col("starts") == 1) & (F.col("labels") == False), "gold_absent": (F.col("starts") == 1) & (F.col("gold") == 0),  # noqa: E712
        "protocol_bound": same("protocol", "protocol_sha256"), "inputs_bound": same("given", "inputs_sha256"), "adapter_bound": (F.col("starts") == 1) & F.col("adapter").eqNullSafe(F.col("expected_adapter_sha256")),
    }
    return one.select(*keys, *(F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions.items())).unpivot(keys, list(conditions), "check", "passed")


def run_summary(records: DataFrame, *by: str) -> DataFrame:
    """``by, parsed, total, rate, errors, completed`` of runs: how many results parsed, and how the run went.

    ``records(kind, parsed, status)``; a run without results has rate 0.
    """
    kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    sums = records.groupBy(*by).agg(
        F.count_if(kind("judge_score") & F.coalesce(F.col("parsed"), F.lit(False))).alias("parsed"), F.count_if(kind("judge_score")).alias("total"), F.count_if(kind("judge_error")).alias("errors"),
        F.count_if(kind("run_end") & F.coalesce(F.col("status") == "complete", F.lit(False))).alias("completed"),
    )
    return sums.withColumn("rate", F.when(F.col("total") > 0, F.col("parsed") / F.col("total")).otherwise(0.0))


def trajectory_run(rows: DataFrame, expected: int, *by: str, isolation_waived: bool = False) -> DataFrame:
    """``kind, question_id, status, labels_mounted`` of runs of the agent."""
    kind = lambda k: F.col("kind") == k
    n = F.count_if(kind("trajectory"))
    return checks(
        rows, *by,
        one_start=F.count_if(kind("run_start")) == 1, one_end=F.count_if(kind("run_end")) == 1, no_errors=F.count_if(kind("trajectory_error")) == 0, status_completed=every(~kind("run_end") | (F.col("status") == "completed")),
        count_expected=n == expected, ids_unique=F.count_distinct(F.when(kind("trajectory"), F.col("question_id"))) == n, isolated=F.lit(isolation_waived) | every(~kind("run_start") | (F.col("labels_mounted") == False)),  # noqa: E712
    )


def causal_inputs(rows: DataFrame, text: str = "prompt", digest: str = "prompt_sha256") -> DataFrame:
    return checks(rows, not_empty=F.count("*") > 0, ids_unique=F.count_distinct("state_id") == F.count("*"), prompt_hashes_match=every(F.sha2(text, 256) == F.col(digest)), labels_known=every(F.col("label").isin("STOP", "CONTINUE")))


def conflict_filter(given: DataFrame, retained: DataFrame, excluded: DataFrame) -> DataFrame:
    """Whether what was kept and what was taken out (``request_id``) make up what was given, each once."""
    parts = retained.select("request_id", F.lit(1).alias("kept")).unionAll(excluded.select("request_id", F.lit(0)))
    sides = given.select("request_id", F.lit(1).alias("given"), F.lit(0).alias("kept"), F.lit(0).alias("out"))
    both = sides.unionAll(parts.select("request_id", F.lit(0), "kept", 1 - F.col("kept")))
    each = both.groupBy("request_id").agg(*(F.sum(c).alias(c) for c in ("given", "kept", "out")))
    return checks(
        each, counts_add_up=F.sum("kept") + F.sum("out") == F.sum("given"), retained_ids_unique=every(F.col("kept") <= 1),
        every_id_once=every(F.col("kept") + F.col("out") == F.col("given")), nothing_new=every(F.col("given") > 0),
    )


# Names that must not reach a model, by place of use.
DENIED = {
    "final_inputs": ("answer", "answers", "gold", "gold_answer", "label", "labels", "native_answer", "native_prediction", "official_em", "prediction", "reward_model", "target", "targets", "token_f1"),
    "states": ("answer", "answers", "gold", "gold_answer", "golden_answers", "label", "labels", "official_em", "prediction", "reward_model", "supporting_facts", "target", "targets"),
    "teacher_inputs": ("action_label", "gold", "gold_answer", "official_em", "prediction", "answer"),
}


def forbidden_columns(df: DataFrame, denied) -> list[str]:
    """Denied names among a frame's columns, known without a job."""
    return sorted(set(df.columns) & set(denied))


def leaking(raw, denied) -> Column:
    """Whether a JSON object (text) has a denied key at its top; what is no object has none."""
    keys = F.json_object_keys(F.col(raw) if isinstance(raw, str) else raw)
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, denied))), F.lit(False))


def firewall(df: DataFrame, raw: str, denied) -> DataFrame:
    """``df``, but reading a row with a denied key is an error."""
    return df.where(F.when(leaking(raw, denied), F.raise_error(F.lit("forbidden fields")).cast("boolean")).otherwise(True))


def data_gate(rows: DataFrame, held_back: DataFrame, verdicts: DataFrame, least_rows: int, least_validation: int, least_questions: int, least_class: float, least_turn: float, least_parsed: float) -> DataFrame:
    """Sizes, the smallest shares of classes and turns, the share of ``verdicts(parsed)``
    that parsed, and questions shared with ``held_back`` (the validation rows)."""
    share = lambda key: rows.groupBy(key).agg(F.count("*").alias("n")).agg((F.min("n") / F.sum("n")).alias(key + "_share"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("q"))
    validation = held_back.agg(F.count("*").alias("v"))
    shared = rows.select("question_id").distinct().join(held_back, "question_id", "left_semi").agg(F.count("*").alias("shared"))
    parsed = verdicts.agg(F.avg(F.col("parsed").cast("int")).alias("parsed_share"))
    one = sizes
    for other in (share("label"), share("turn_index"), validation, shared, parsed):  # one-row tables
        one = one.join(F.broadcast(other))
    return checks(one, enough_validation=F.max("v") >= least_validation, no_overlap=F.max("shared") == 0, parse_rate=F.max("parsed_share") >= least_parsed, enough_rows=F.max("n") >= least_rows, enough_questions=F.max("q") >= least_questions, classes_balanced=F.max("label_share") >= least_class, turns_covered=F.max("turn_index_share") >= least_turn)


def noninferiority(intervals: DataFrame, margin: float = 0.02) -> DataFrame:
    """EM may fall by less than the margin, searches must fall."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return checks(intervals, em_not_inferior=pick("em", "low") > -margin, searches_reduced=pick("searches", "high") < 0)


# How many records the gate was declared for.
GATE_COUNTS = {"states": 798, "native": 723, "counterfactual": 75, "native_search": 523, "questions": 200}


def gate_checks(states: DataFrame, run: DataFrame, labels: DataFrame, natives: DataFrame, facts: DataFrame, counts: dict = GATE_COUNTS) -> DataFrame:
    """The named checks of a gate's evaluation; all must hold.

    ``states(position, state_id, question_id, state_role, native_next_action,
    native_search_count, input_sha256)``, ``run(position, kind, state_id,
    action, answer, input_sha256, status, labels_mounted, gold_fields)``,
    ``labels(position, question_id, n_targets)``, ``natives(position,
    question_id, search_calls)``, ``facts``: one row with ``structure_passed,
    labels_sha256, expected_labels_sha256, materialized_labels,
    final_test_labels_read``.  ``position`` is the order of records.
    """
    kind, count = lambda k: F.col("kind") == k, lambda c: F.count_if(c)
    role = lambda r: F.col("state_role") == r
    native = role("native_prefix")
    starts = count(kind("run_start"))
    of_run = run.agg(
        (starts == 1).alias("one_run_start"), (count(kind("run_end")) == 1).alias("one_run_end"),
        ((count(kind("run_end")) == 1) & (count(kind("run_end") & (F.col("status") == "complete")) == 1)).alias("run_complete"), (count(kind("probe_error")) == 0).alias("zero_probe_errors"),
        ((starts == 1) & (count(kind("run_start") & ~F.col("labels_mounted") & (F.col("gold_fields") == 0)) == 1)).alias("probe_inference_declared_label_blind"),
        (count(kind("probe")) == counts["states"]).alias("expected_probe_count"), every(~kind("probe") | ((F.col("action") == "ANSWER") & F.col("answer").isNotNull())).alias("all_probes_are_answers"),
        (F.count_distinct(F.when(kind("probe"), F.col("state_id"))) == count(kind("probe"))).alias("unique_probe_ids"),
    )
    of_states = states.agg(
        (F.count("*") == counts["states"]).alias("expected_state_count"), (count(native) == counts["native"]).alias("expected_native_state_count"),
        (count(role("counterfactual_forced_continue")) == counts["counterfactual"]).alias("expected_counterfactual_state_count"),
        (count(native & (F.col("native_next_action") == "SEARCH")) == counts["native_search"]).alias("expected_native_search_state_count"),
        (F.count_distinct("state_id") == F.count("*")).alias("unique_state_ids"), (F.count_distinct("question_id") == counts["questions"]).alias("expected_question_count"),
    )
    # first occurrences in order: of states and probes, and of questions in the three tables
    first = lambda df, key, name: df.groupBy(F.col(key).alias("key")).agg(F.min("position").alias(name))
    ranked = lambda df, key, name: ordinal(first(df, key, "p"), "p", name=name).drop("p")
    probes = run.where(kind("probe"))
    same = lambda a, b, name: a.join(b, "key", "full").agg(every(F.col("x").eqNullSafe(F.col("y"))).alias(name))
    ids = same(ranked(states, "state_id", "x"), ranked(probes, "state_id", "y"), "state_probe_ids_exact")
    hashes = states.select("state_id", F.col("input_sha256").alias("x")).join(probes.select("state_id", F.col("input_sha256").alias("y")), "state_id", "left").agg(every(F.col("x").eqNullSafe(F.col("y"))).alias("prompt_hashes_exact"))
    questions = ranked(states, "question_id", "x")
    orders = [same(questions, ranked(df, "question_id", "y"), name) for df, name in ((labels, "label_order_exact"), (natives, "native_order_exact"))]
    sizes = lambda df, a, b: df.agg((F.count("*") == counts["questions"]).alias(a), (F.count_distinct("question_id") == counts["questions"]).alias(b))
    targets = labels.agg(every(F.col("n_targets") > 0).alias("all_labels_have_targets"))
    most = states.where(native).groupBy("question_id").agg(F.max("native_search_count").alias("most"))
    searches = states.select("question_id").distinct().join(most, "question_id", "left").join(natives, "question_id", "left").agg(every(F.col("most") == F.col("search_calls")).alias("native_search_counts_match_manifest"))
    declared = facts.select(
        F.col("structure_passed").alias("structure_audit_passed"), (F.col("labels_sha256") == F.col("expected_labels_sha256")).alias("labels_hash_matches_materialization"),
        (F.col("materialized_labels") == counts["questions"]).alias("labels_materialization_count"), (~F.col("final_test_labels_read")).alias("final_test_labels_not_used"),
    )
    one = declared
    for other in (of_run, of_states, ids, hashes, *orders, sizes(labels, "expected_label_count", "unique_label_ids"), sizes(natives, "expected_native_comparison_count", "unique_native_ids"), targets, searches):  # one-row tables
        one = one.join(F.broadcast(other))
    names = one.columns
    return one.select(*(F.coalesce(c, F.lit(False)).alias(c) for c in names)).unpivot([], names, "check", "passed")


def gate_decision(passed: DataFrame, decision: Column) -> DataFrame:
    """The decision if every check holds, else ``ANALYSIS_FAILED``."""
    return passed.agg(every(F.col("passed")).alias("ok")).select(F.when(F.col("ok"), decision).otherwise("ANALYSIS_FAILED").alias("decision"))
