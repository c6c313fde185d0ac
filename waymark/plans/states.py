"""Queries: trajectories to states, oracles, headroom."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.scores import resource_decision
from waymark.functions.text import NO_EVIDENCE
from waymark.operators import metrics, ordered
from waymark.plans import tables as t
from waymark.plans.registry import query, rounded

EXPANDED = f"""m AS (SELECT *, coalesce(lead(action) OVER w, 'INVALID') AS native_next_action, action = 'SEARCH' AND executed AS search,
    sum(CASE WHEN action = 'SEARCH' AND executed THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY step) AS k,
    string_agg(CASE WHEN action = 'SEARCH' AND executed THEN block END, chr(10) || chr(10)) OVER (PARTITION BY question_id ORDER BY step) AS context
  FROM steps WINDOW w AS (PARTITION BY question_id ORDER BY step)),
expanded AS (SELECT question_id, CAST(k AS BIGINT) AS state_index, native_next_action, context FROM m WHERE search AND k < 4
  UNION ALL SELECT question_id, 0, arg_min(action, step), '{NO_EVIDENCE}' FROM steps GROUP BY question_id)"""


@query("expand_states", t.sql(f"WITH {EXPANDED} SELECT *, concat_ws(':', CAST(question_id AS VARCHAR), 'search-state', CAST(state_index AS VARCHAR)) AS state_id, state_index + 1 AS turn_index, greatest(0, 3 - state_index) AS remaining_search_budget FROM expanded"))
def expand_states(spark, sf_dir):
    return ordered.expand_states(t.steps(spark, sf_dir))


@query("running_context", t.sql(f"WITH {EXPANDED} SELECT question_id, state_index, sha256(context) AS context_sha256, length(context) AS context_chars FROM expanded"))
def running_context(spark, sf_dir):
    s = ordered.expand_states(t.steps(spark, sf_dir))
    return s.select("question_id", "state_index", F.sha2("context", 256).alias("context_sha256"), F.length("context").cast("long").alias("context_chars"))


@query("conversation_context", "SELECT conv_id, turn, sha256(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS context_sha256, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'INVALID') AS next_role FROM conversations")
def conversation_context(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    texts = F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.array_join(texts, "\n"), 256).alias("context_sha256"), F.coalesce(F.lead("role").over(w), F.lit("INVALID")).alias("next_role"))


@query("next_action", t.sql("SELECT question_id, step, coalesce(lead(action) OVER (PARTITION BY question_id ORDER BY step), 'INVALID') AS native_next_action FROM steps"))
def next_action(spark, sf_dir):
    return ordered.with_next_action(t.steps(spark, sf_dir)).select("question_id", "step", "native_next_action")


@query("reconstruction", t.sql("SELECT question_id, count(*) FILTER (action = 'SEARCH' AND executed) = max(n) AS consistent FROM steps JOIN (SELECT question_id AS q, count(*) FILTER (action = 'SEARCH') AS n FROM steps GROUP BY 1) ON q = question_id GROUP BY question_id"))
def reconstruction(spark, sf_dir):
    s = t.steps(spark, sf_dir)
    return ordered.reconstruction(s, s.groupBy("question_id").agg(F.count_if(F.col("action") == "SEARCH").alias("search_calls")))


@query("budget_exhausted", t.sql("SELECT count(*) FILTER (native_searches >= 4) AS exhausted, count(*) AS questions FROM natives"))
def budget_exhausted(spark, sf_dir):
    return t.natives(spark, sf_dir).agg(F.count_if(F.col("native_searches") >= 4).alias("exhausted"), F.count("*").alias("questions"))


@query("earliest_correct", t.sql("SELECT question_id, min(state_index) FILTER (em = 1) AS earliest_correct FROM probes GROUP BY question_id"))
def earliest_correct(spark, sf_dir):
    return ordered.earliest(t.probes(spark, sf_dir), F.col("em") == 1, "earliest_correct")


@query("earliest_early_stop", t.sql("SELECT question_id, min(state_index) FILTER (em = 1 AND next_action = 'SEARCH') AS earliest_early_stop FROM probes GROUP BY question_id"))
def earliest_early_stop(spark, sf_dir):
    return ordered.earliest(t.probes(spark, sf_dir), (F.col("em") == 1) & (F.col("next_action") == "SEARCH"), "earliest_early_stop")


@query("terminal_state", t.sql("SELECT question_id, min(state_index) AS state_index, arg_min(next_action, state_index) AS next_action, arg_min(em, state_index) AS em FROM probes WHERE next_action <> 'SEARCH' GROUP BY question_id"))
def terminal_state(spark, sf_dir):
    return ordered.terminal_state(t.probes(spark, sf_dir))


LATER = "l AS (SELECT *, coalesce(max(em) OVER (PARTITION BY question_id ORDER BY state_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS later FROM probes)"


@query("causal_labels", t.sql(f"WITH {LATER} SELECT question_id, state_index, CASE WHEN em = 1 THEN 'STOP' WHEN later THEN 'CONTINUE' ELSE 'NO_REACHABLE_CORRECT' END AS label FROM l WHERE next_action = 'SEARCH'"))
def causal_labels(spark, sf_dir):
    return ordered.causal_labels(t.probes(spark, sf_dir))


@query("high_confidence_truth", t.sql(f"WITH {LATER} SELECT * FROM (SELECT question_id, state_index, CASE WHEN em = 1 THEN 'STOP' WHEN later OR native_em = 1 THEN 'CONTINUE' END AS truth FROM l JOIN natives USING (question_id) WHERE next_action = 'SEARCH') WHERE truth IS NOT NULL"))
def high_confidence_truth(spark, sf_dir):
    return ordered.high_confidence_truth(t.probes(spark, sf_dir), t.natives(spark, sf_dir))


@query("fixed_budget_curve", t.sql("""WITH k AS (SELECT question_id, unnest(range(5)) AS budget, max(state_index) AS top FROM probes GROUP BY question_id)
SELECT budget, round(avg(em), 9) AS mean_em, round(avg(f1), 9) AS mean_f1, round(avg(state_index), 9) AS mean_searches, count(*) FILTER (top >= budget) AS covered, count(*) AS questions FROM k JOIN probes p ON p.question_id = k.question_id AND p.state_index = least(budget, top) GROUP BY budget"""))
def fixed_budget_curve(spark, sf_dir):
    return rounded(metrics.budget_curve(ordered.last_reachable(t.probes(spark, sf_dir)), t.natives(spark, sf_dir)))


@query("first_candidate", t.sql("""SELECT question_id, CASE WHEN count(*) FILTER (executed) > 0 THEN arg_min(block, step) FILTER (executed) ELSE 'none' END AS answer, CAST(CASE WHEN count(*) FILTER (executed) > 0 THEN min(step) FILTER (executed) ELSE -1 END AS BIGINT) AS search_calls FROM steps GROUP BY question_id"""))
def first_candidate(spark, sf_dir):
    e = F.array_sort(F.collect_list(F.when(F.col("executed"), F.struct("step", "block"))))
    r = t.steps(spark, sf_dir).groupBy("question_id").agg(F.transform(e, lambda x: F.struct(x["block"].alias("candidate_answer"), x["step"].alias("search_calls"))).alias("candidate_events"))
    return ordered.first_candidate(r.withColumns({"answer": F.lit("none"), "search_calls": F.lit(-1).cast("long")}))


@query("native_count_check", t.sql("SELECT question_id, count(*) FILTER (next_action = 'SEARCH') = max(native_searches) AS consistent FROM probes JOIN natives USING (question_id) GROUP BY question_id"))
def native_count_check(spark, sf_dir):
    counted = t.probes(spark, sf_dir).groupBy("question_id").agg(F.count_if(F.col("next_action") == "SEARCH").alias("counted"))
    return t.natives(spark, sf_dir).join(counted, "question_id").select("question_id", (F.col("counted") == F.col("native_searches")).alias("consistent"))


HEAD = """h AS (SELECT question_id, native_em, native_searches, min(state_index) FILTER (em = 1) AS ec, min(state_index) FILTER (em = 1 AND next_action = 'SEARCH') AS es FROM probes JOIN natives USING (question_id) GROUP BY 1, 2, 3),
hq AS (SELECT question_id, native_em, native_searches, CAST(native_em = 1 OR es IS NOT NULL AS INT) AS quality_oracle, CAST(native_em = 0 AND es IS NULL AND ec IS NOT NULL AS INT) AS terminal_only_rescue,
  CASE WHEN native_em = 1 AND es IS NOT NULL THEN least(native_searches, es) ELSE native_searches END AS cost_oracle FROM h)"""


@query("quality_oracle", t.sql(f"WITH {HEAD} SELECT question_id, quality_oracle, terminal_only_rescue FROM hq"))
def quality_oracle(spark, sf_dir):
    return metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir)).select("question_id", "quality_oracle", "terminal_only_rescue")


@query("cost_oracle", t.sql(f"WITH {HEAD} SELECT question_id, cost_oracle, native_searches - cost_oracle AS avoidable FROM hq"))
def cost_oracle(spark, sf_dir):
    return metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir)).select("question_id", "cost_oracle", "avoidable")


HEADROOM = """s AS (SELECT count(*) AS questions, avg(native_em) AS native_em, avg(quality_oracle) AS quality_oracle, CAST(sum(terminal_only_rescue) AS BIGINT) AS terminal_only_rescues, CAST(sum(native_searches - cost_oracle) AS BIGINT) AS avoidable_searches, CAST(sum(native_searches) AS BIGINT) AS native_searches, avg(cost_oracle) AS mean_oracle_searches FROM hq)"""


@query("headroom", t.sql(f"WITH {HEAD}, {HEADROOM} SELECT questions, round(native_em, 9) AS native_em, round(quality_oracle, 9) AS quality_oracle, terminal_only_rescues, avoidable_searches, native_searches, round(mean_oracle_searches, 9) AS mean_oracle_searches, round(quality_oracle - native_em, 9) AS quality_headroom, round(avoidable_searches / native_searches::DOUBLE, 9) AS avoidable_fraction FROM s"))
def headroom(spark, sf_dir):
    return rounded(metrics.headroom(metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir))))


@query("resource_decision", t.sql(f"""WITH {HEAD}, {HEADROOM}, d AS (SELECT quality_oracle - native_em AS h, avoidable_searches / native_searches::DOUBLE AS a FROM s)
SELECT CASE WHEN h >= 0.05 THEN 'STRONG_QUALITY_HEADROOM' WHEN h >= 0.02 AND a >= 0.2 THEN 'QUALITY_COST_PARETO' WHEN h >= 0.02 THEN 'MODERATE_QUALITY_HEADROOM' WHEN a >= 0.2 THEN 'EFFICIENCY_ONLY' ELSE 'LOW_STOPPING_HEADROOM' END AS decision FROM d"""))
def decision(spark, sf_dir):
    h = metrics.headroom(metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir)))
    return h.select(resource_decision("quality_headroom", "avoidable_fraction").alias("decision"))


@query("action_cells", t.sql("SELECT CASE WHEN em = 1 THEN 'correct' ELSE 'wrong' END AS now, CASE WHEN native_em = 1 THEN 'correct' ELSE 'wrong' END AS native, count(*) AS n FROM probes JOIN natives USING (question_id) WHERE next_action = 'SEARCH' GROUP BY 1, 2"))
def action_cells(spark, sf_dir):
    return metrics.cells(t.probes(spark, sf_dir).where("next_action = 'SEARCH'").join(t.natives(spark, sf_dir), "question_id"), "em", "native_em")


@query("question_cells", t.sql("SELECT CASE WHEN em = 1 THEN 'correct' ELSE 'wrong' END AS now, CASE WHEN native_em = 1 THEN 'correct' ELSE 'wrong' END AS native, count(*) AS n FROM (SELECT question_id, max(em) AS em FROM probes WHERE next_action = 'SEARCH' GROUP BY 1) JOIN natives USING (question_id) GROUP BY 1, 2"))
def question_cells(spark, sf_dir):
    q = t.probes(spark, sf_dir).where("next_action = 'SEARCH'").groupBy("question_id").agg(F.max("em").alias("em"))
    return metrics.cells(q.join(t.natives(spark, sf_dir), "question_id"), "em", "native_em")


@query("counterfactual_supplement", t.sql("SELECT CAST(sum(n) AS BIGINT) AS states, CAST(sum(c) AS BIGINT) AS correct_states, count(*) AS questions, count(*) FILTER (c > 0) AS rescued_questions, round(sum(c) / sum(n)::DOUBLE, 9) AS state_rate FROM (SELECT question_id, count(*) AS n, sum(em) AS c FROM probes WHERE next_action <> 'SEARCH' GROUP BY 1)"))
def counterfactual_supplement(spark, sf_dir):
    return rounded(metrics.supplement(t.probes(spark, sf_dir).where("next_action <> 'SEARCH'")))


@query("turn_fractions", t.sql(f"WITH {EXPANDED} SELECT turn_index, n, round(n / sum(n) OVER (), 9) AS fraction FROM (SELECT state_index + 1 AS turn_index, count(*) AS n FROM expanded GROUP BY 1)"))
def turn_fractions(spark, sf_dir):
    return rounded(metrics.fractions(ordered.expand_states(t.steps(spark, sf_dir)), "turn_index"))


@query("sequence_index", t.sql("SELECT question_id, state_index, row_number() OVER (ORDER BY question_id, state_index) - 1 AS sequence_index FROM probes"))
def sequence_index(spark, sf_dir):
    return ordered.ordinal(t.probes(spark, sf_dir).select("question_id", "state_index"), "question_id", "state_index").select("question_id", "state_index", "sequence_index")


@query("loss_summary", t.sql("SELECT round(arg_min(value, event_id), 9) AS first, round(arg_max(value, event_id), 9) AS last, round(min(value), 9) AS least, round(max(value), 9) AS most, bool_and(isfinite(value)) AS all_finite FROM probes"))
def loss_summary(spark, sf_dir):
    return rounded(metrics.loss_summary(t.probes(spark, sf_dir), "value", "event_id"))


@query("weighted_mean", t.sql("SELECT round(sum(value * (state_index + 1)) / sum(state_index + 1), 9) AS weighted_mean FROM probes"))
def weighted_mean(spark, sf_dir):
    return rounded(metrics.weighted_mean(t.probes(spark, sf_dir).withColumn("tokens", F.col("state_index") + 1), "value", "tokens"))
