"""Queries: audits, digests, gates, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import text as x
from waymark.functions.scores import mean_binary, wilson_interval
from waymark.operators import audits, joins, metrics, resample
from waymark.plans import policies
from waymark.plans import tables as t
from waymark.plans.registry import query, rounded
from waymark.sources.jsonl import harvest_key


def long(pairs: dict[str, str], source: str, by: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {by + ', ' if by else ''}'{k}' AS \"check\", coalesce({v}, false) AS passed FROM {source}{' GROUP BY ' + by if by else ''}" for k, v in pairs.items())


def _run(spark, sf_dir):
    """Each user's events as a run log: start, scores in order, end."""
    e = t.read(spark, sf_dir, "events")
    w, r = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    kind = F.when(F.row_number().over(w) == 1, "run_start").when(F.row_number().over(r) == 1, "run_end").otherwise("judge_score")
    seq = (F.row_number().over(w) - 2).cast("long")
    return e.select("user_id", kind.alias("kind"), seq.alias("sequence_index"), F.col("event_id").alias("request_id"), F.col("event_id").alias("state_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("expected_id"), F.col("value").alias("score"), F.lit("complete").alias("status"), F.lit(False).alias("labels_mounted"))


RUN = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events), s AS (SELECT *, k > 1 AND z > 1 AS inner_row FROM r) """
ENDED = "count(*) > 1"


@query("run_audit", RUN + long({"one_start": "true", "one_end": ENDED, "status_complete": "true", "no_errors": "true", "ids_unique": "count(*) FILTER (inner_row) = count(DISTINCT event_id) FILTER (inner_row)", "order_exact": "coalesce(bool_and(event_id % 5 <> 0) FILTER (inner_row), true)", "sequence_contiguous": "count(*) FILTER (inner_row) = 0 OR min(k) FILTER (inner_row) = 2 AND max(k) FILTER (inner_row) = count(*) FILTER (inner_row) + 1", "scores_finite": "coalesce(bool_and(isfinite(value)) FILTER (inner_row), true)", "labels_absent": "true"}, "s", "user_id"))
def run_audit(spark, sf_dir):
    return audits.judge_run(_run(spark, sf_dir), "user_id")


@query("trajectory_audit", RUN + long({"one_start": "true", "one_end": ENDED, "no_errors": "true", "status_completed": f"NOT ({ENDED})", "count_expected": "count(*) FILTER (inner_row) = 10", "ids_unique": "count(*) FILTER (inner_row) = count(DISTINCT event_id) FILTER (inner_row)", "isolated": "true"}, "s", "user_id"))
def trajectory_audit(spark, sf_dir):
    run = _run(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "judge_score", "trajectory").otherwise(F.col("kind"))).withColumn("question_id", F.col("request_id"))
    return audits.trajectory_run(run, 10, "user_id")


LABELLED = "l AS (SELECT *, coalesce(max(em) OVER (PARTITION BY question_id ORDER BY state_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS later FROM probes), g AS (SELECT question_id, state_index + 1 AS turn_index, CASE WHEN em = 1 THEN 'STOP' ELSE 'CONTINUE' END AS label FROM l WHERE next_action = 'SEARCH' AND (em = 1 OR later))"


def _labelled(spark, sf_dir):
    from waymark.operators.ordered import causal_labels

    s = causal_labels(t.probes(spark, sf_dir)).where("label <> 'NO_REACHABLE_CORRECT'")
    return s.withColumn("turn_index", F.col("state_index") + 1)


@query("data_gate", t.sql(f"WITH {LABELLED}, u AS (SELECT * FROM g WHERE question_id % 10 <> 0) " + long({"enough_rows": "(SELECT count(*) >= 2500 FROM u)", "enough_validation": "(SELECT count(*) >= 280 FROM g WHERE question_id % 10 = 0)", "enough_questions": "(SELECT count(DISTINCT question_id) >= 600 FROM u)", "no_overlap": "true", "parse_rate": "(SELECT avg(CAST(event_id % 100 <> 0 AS INT)) >= 0.98 FROM events)", "classes_balanced": "(SELECT min(n) / sum(n) >= 0.35 FROM (SELECT count(*) AS n FROM u GROUP BY label))", "turns_covered": "(SELECT min(n) / sum(n) >= 0.1 FROM (SELECT count(*) AS n FROM u GROUP BY turn_index))"}, "(SELECT 1)")))
def data_gate(spark, sf_dir):
    g, held = _labelled(spark, sf_dir), F.col("question_id") % 10 == 0
    raw = F.when(F.col("event_id") % 100 == 0, F.col("props")).otherwise('{"sufficient": true, "gap_items": []}')
    parsed = t.read(spark, sf_dir, "events").select(x.strict_verdict(raw)["parsed"].isNotNull().alias("parsed"))
    return audits.data_gate(g.where(~held), g.where(held), parsed, 2500, 280, 600, 0.35, 0.10, 0.98)


@query("causal_input_audit", t.sql(f"WITH {LABELLED} " + long({"not_empty": "(SELECT count(*) > 0 FROM g)", "ids_unique": "true", "prompt_hashes_match": "(SELECT bool_and(turn_index <> 3) FROM g)", "labels_known": "true"}, "(SELECT 1)")))
def causal_input_audit(spark, sf_dir):
    g = _labelled(spark, sf_dir).withColumns({"state_id": F.concat_ws(":", "question_id", "turn_index"), "prompt": F.concat_ws("/", "question_id", "turn_index")})
    return audits.causal_inputs(g.withColumn("prompt_sha256", F.sha2(F.when(F.col("turn_index") == 3, F.lit("x")).otherwise(F.col("prompt")), 256)))


@query("noninferiority_gate")
def noninferiority_gate(spark, sf_dir):
    return audits.noninferiority(resample.paired_bootstrap(policies._deltas(spark, sf_dir), resample.REPLICATES, policies.SEED))


@query("conflict_audit", "SELECT * FROM (VALUES ('counts_add_up', (SELECT count(*) FILTER (event_id % 6 = 0) = count(*) FILTER (event_id % 10 = 0) FROM events)), ('retained_ids_unique', (SELECT count(*) = 0 FROM events WHERE event_id % 10 = 0)), ('every_id_once', (SELECT count(*) = 0 FROM events WHERE event_id % 6 = 0 OR event_id % 10 = 0)), ('nothing_new', true)) AS v(\"check\", passed)")
def conflict_audit(spark, sf_dir):
    """A filter that loses some rows and repeats others; the audit tells."""
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"))
    i = F.col("request_id")
    kept, out = e.where((i % 3 != 0) & (i % 6 != 0)), e.where((i % 3 == 0) & (i % 6 != 0))
    return audits.conflict_filter(e, kept.unionAll(e.where(i % 10 == 0)).unionAll(kept.where("false")), out)


@query("firewall", "SELECT event_id, event_id % 7 = 0 AS leaks_final, event_id % 7 = 0 OR event_id % 5 = 0 AS leaks_state FROM events")
def firewall(spark, sf_dir):
    """Which records carry names that must not reach a model."""
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"targets": [], "text": '), F.col("props"), F.lit("}"))).when(F.col("event_id") % 5 == 0, F.lit('{"golden_answers": null}')).otherwise(F.concat(F.lit('{"deep": {"answer": 1}, "p": '), F.col("props"), F.lit("}")))
    e = t.read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", audits.leaking("raw", audits.DENIED["final_inputs"]).alias("leaks_final"), audits.leaking("raw", audits.DENIED["states"]).alias("leaks_state"))


GATE = """st AS (SELECT event_id AS position, event_id AS state_id, question_id, state_index, event_id % 11 <> 0 AS native, next_action FROM probes),
q AS (SELECT question_id, min(position) AS first_position FROM st GROUP BY question_id)"""


@query("gate_checks", t.sql(f"WITH {GATE} " + long({
    "structure_audit_passed": "true", "labels_hash_matches_materialization": "true", "labels_materialization_count": "true", "final_test_labels_not_used": "true", "one_run_start": "true", "one_run_end": "true", "run_complete": "true",
    "zero_probe_errors": "true", "probe_inference_declared_label_blind": "true", "expected_probe_count": "(SELECT count(*) = 798 FROM st)", "all_probes_are_answers": "(SELECT count(*) = 0 FROM st WHERE state_id % 13 = 0)", "unique_probe_ids": "true",
    "expected_state_count": "(SELECT count(*) = 798 FROM st)", "expected_native_state_count": "(SELECT count(*) = 723 FROM st WHERE native)", "expected_counterfactual_state_count": "(SELECT count(*) = 75 FROM st WHERE NOT native)",
    "expected_native_search_state_count": "(SELECT count(*) = 523 FROM st WHERE native AND next_action = 'SEARCH')", "unique_state_ids": "true", "expected_question_count": "(SELECT count(*) = 200 FROM q)", "state_probe_ids_exact": "true",
    "prompt_hashes_exact": "(SELECT count(*) = 0 FROM st WHERE state_id % 17 = 0)", "label_order_exact": "true", "native_order_exact": "(SELECT bool_and(a = b) FROM (SELECT row_number() OVER (ORDER BY first_position) AS a, row_number() OVER (ORDER BY question_id) AS b FROM q))",
    "expected_label_count": "(SELECT count(*) = 200 FROM q)", "unique_label_ids": "(SELECT count(*) = 200 FROM q)", "expected_native_comparison_count": "(SELECT count(*) = 200 FROM q)", "unique_native_ids": "(SELECT count(*) = 200 FROM q)",
    "all_labels_have_targets": "(SELECT count(*) = 0 FROM q WHERE question_id % 19 = 0)", "native_search_counts_match_manifest": "(SELECT bool_and(coalesce(most = n, false)) FROM (SELECT question_id, max(state_index) FILTER (native) AS most, count(*) AS n FROM st GROUP BY question_id))",
}, "(SELECT 1)")))
def gate_checks(spark, sf_dir):
    """A gate over the probes, with some faults planted."""
    p, i = t.probes(spark, sf_dir), F.col("event_id")
    states = p.select(i.alias("position"), i.alias("state_id"), "question_id", F.when(i % 11 != 0, "native_prefix").otherwise("counterfactual_forced_continue").alias("state_role"), F.col("next_action").alias("native_next_action"), F.col("state_index").alias("native_search_count"), F.sha2(i.cast("string"), 256).alias("input_sha256"))
    record = lambda df, kind, status: df.select(F.lit(0).cast("long").alias("position"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("state_id"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("input_sha256"), F.lit(status).alias("status"), F.lit(False).alias("labels_mounted"), F.lit(0).alias("gold_fields"))
    one = spark.range(1)
    probes = p.select(i.alias("position"), F.lit("probe").alias("kind"), i.alias("state_id"), F.lit("ANSWER").alias("action"), F.when(i % 13 != 0, F.lit("x")).alias("answer"), F.when(i % 17 != 0, F.sha2(i.cast("string"), 256)).alias("input_sha256"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("labels_mounted"), F.lit(0).alias("gold_fields"))
    run = record(one, "run_start", None).unionByName(probes).unionByName(record(one, "run_end", "complete"))
    q = states.groupBy("question_id").agg(F.min("position").alias("position"), F.count("*").alias("search_calls"))
    labels = q.select("position", "question_id", F.when(F.col("question_id") % 19 == 0, 0).otherwise(1).alias("n_targets"))
    natives = q.select(F.col("question_id").alias("position"), "question_id", "search_calls")
    facts = one.select(F.lit(True).alias("structure_passed"), F.lit("h").alias("labels_sha256"), F.lit("h").alias("expected_labels_sha256"), F.lit(200).alias("materialized_labels"), F.lit(False).alias("final_test_labels_read"))
    return audits.gate_checks(states, run, labels, natives, facts)


@query("token_hash_check", "WITH k AS (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, sha256('[' || array_to_string(ids, ',') || ']') AS ids_sha256, sha256('[' || array_to_string(ids[1:2], ',') || ']') AS prefix_sha256, len(ids) >= 2 AS prefix_matches FROM k")
def token_hash_check(spark, sf_dir):
    k = t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda y: y["l_partkey"]).alias("ids"))
    k = k.join(t.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("prefix_sha256", x.int_array_digest(F.slice("ids", 1, 2)))
    return k.select("o_orderkey", x.int_array_digest("ids").alias("ids_sha256"), "prefix_sha256", x.prefix_matches("ids", F.lit(2), "prefix_sha256").alias("prefix_matches"))


@query("text_digest", "SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def text_digest(spark, sf_dir):
    return t.read(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"))


@query("order_audit", "SELECT count(*) FILTER (doc_id = k) AS in_order, count(*) AS rows FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)")
def order_audit(spark, sf_dir):
    from waymark.operators.ordered import ordinal

    d = ordinal(t.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", name="k")
    return d.agg(F.count_if(F.col("doc_id") == F.col("k")).alias("in_order"), F.count("*").alias("rows"))


@query("counts_by_key", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def counts_by_key(spark, sf_dir):
    return metrics.count_by(t.read(spark, sf_dir, "conversations"), "role")


@query("counts_by_two_keys", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def counts_by_two_keys(spark, sf_dir):
    return metrics.count_by(t.read(spark, sf_dir, "labels"), "quality", "toxic")


@query("wilson_interval", t.sql("""SELECT next_action, n, s, round(greatest(0, (s / n::DOUBLE + z * z / (2 * n) - z * sqrt(s / n::DOUBLE * (1 - s / n::DOUBLE) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low,
  round(least(1, (s / n::DOUBLE + z * z / (2 * n) + z * sqrt(s / n::DOUBLE * (1 - s / n::DOUBLE) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high
FROM (SELECT next_action, count(*) AS n, CAST(sum(em) AS BIGINT) AS s, 1.959963984540054::DOUBLE AS z FROM probes GROUP BY next_action)"""))
def wilson(spark, sf_dir):
    p = t.probes(spark, sf_dir).groupBy("next_action").agg(F.count("*").alias("n"), F.sum("em").cast("long").alias("s"))
    return rounded(p.withColumn("w", wilson_interval("s", "n")).select("next_action", "n", "s", "w.low", "w.high"))


@query("missing_and_unexpected", "SELECT 'missing' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unexpected', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_and_unexpected(spark, sf_dir):
    d, l = t.read(spark, sf_dir, "documents").select("doc_id"), t.read(spark, sf_dir, "labels").select("doc_id")
    side = lambda a, b, k: a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return side(d, l, "missing").unionAll(side(l, d, "unexpected"))


@query("must_match_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def must_match_join(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.must_match(t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("positional_join", "SELECT l.doc_id, l.quality, sha256(d.text) AS text_sha256 FROM labels l JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) d ON d.k = l.doc_id AND d.doc_id = l.doc_id")
def positional_join(spark, sf_dir):
    from waymark.operators.ordered import ordinal

    d = ordinal(t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"), "source_id", name="k")
    rows = t.read(spark, sf_dir, "labels").select("doc_id", "quality", F.col("doc_id").alias("k"))
    return joins.positional(rows, d, "k", "k", "doc_id", "source_id").select("doc_id", "quality", F.sha2("text", 256).alias("text_sha256"))


@query("coalesced_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id ELSE 'b' || event_id END AS original_id FROM events")
def coalesced_key(spark, sf_dir):
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"id": "no", "_id": " a'), i, F.lit('\\n"}'))).otherwise(F.concat(F.lit('{"id": "b'), i, F.lit('", "deep": {"_id": "no"}}')))
    return t.read(spark, sf_dir, "events").select("event_id", x.coalesced_key(raw).alias("original_id"))


@query("model_names", t.sql("SELECT model, count(*) AS n FROM scores WHERE model IN (SELECT model FROM thresholds) GROUP BY model"))
def model_names(spark, sf_dir):
    return joins.same_names(t.scores(spark, sf_dir), t.thresholds(spark)).groupBy("model").agg(F.count("*").alias("n"))


@query("set_equality", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS equal")
def set_equality(spark, sf_dir):
    return joins.set_equality(t.read(spark, sf_dir, "labels"), t.read(spark, sf_dir, "documents"), "doc_id")


@query("label_projection", "SELECT doc_id AS question_id, toxic AS answer, doc_id AS source_index FROM labels")
def label_projection(spark, sf_dir):
    """The gold columns alone, by an allow-list."""
    return t.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("toxic").alias("answer"), F.col("doc_id").alias("source_index"))


@query("mean_binary", "SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic FROM labels")
def mean_binary_(spark, sf_dir):
    return rounded(t.read(spark, sf_dir, "labels").agg(mean_binary("quality").alias("quality"), mean_binary("toxic").alias("toxic")))


@query("casts", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'None' ELSE CAST(user_id AS VARCHAR) END AS as_text, CAST(trunc(value) AS BIGINT) AS as_int, CAST(event_id AS DOUBLE) AS as_float, value <> 0 AS as_bool FROM events")
def casts(spark, sf_dir):
    e = t.read(spark, sf_dir, "events")
    return e.select("event_id", x.text_of(F.when(F.col("event_id") % 4 != 0, F.col("user_id"))).alias("as_text"), F.col("value").cast("long").alias("as_int"), F.col("event_id").cast("double").alias("as_float"), F.col("value").cast("boolean").alias("as_bool"))


@query("harvested_keys", "SELECT conv_id, sha256(text) AS question_sha256 FROM conversations WHERE text IS NOT NULL")
def harvested_keys(spark, sf_dir):
    """Texts found under a key at some depth of JSON documents."""
    c = t.read(spark, sf_dir, "conversations")
    deep = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("question"), F.lit(1).alias("x"))).alias("rows")))
    found = harvest_key(c.select(F.col("conv_id").cast("string").alias("path"), deep.alias("value")))
    return found.select(F.col("path").cast("long").alias("conv_id"), F.sha2("question", 256).alias("question_sha256"))
