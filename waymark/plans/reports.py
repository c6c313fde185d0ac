"""Queries: runs bound to what they were given, and a whole evaluation in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import audits, metrics, resample
from waymark.plans import audits as audit_plans
from waymark.plans import policies, states
from waymark.plans import tables as t
from waymark.plans.registry import ORACLES, QUERIES, query, rounded
from waymark.sources.jsonl import guard_stored, write_jsonl

#: Faults planted in the run of a user, by what is left of its id: (rest of 17, the check that must fail).
FAULTS = {
    1: "one_start", 2: "one_end", 3: "status_complete", 4: "no_errors", 5: "count_expected", 6: "order_exact", 7: "ids_unique", 8: "sequence_contiguous", 9: "scores_finite", 10: "labels_absent", 11: "gold_absent",
    12: "protocol_bound", 13: "inputs_bound", 14: "adapter_bound", 15: "the first two results change places in the log",
}
RUNS = """e AS (SELECT user_id, user_id % 17 AS f, event_id, value, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, coalesce(lead(event_id) OVER w, event_id) AS later, coalesce(lag(event_id) OVER w, event_id) AS earlier
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
inputs AS (SELECT user_id, k AS position, event_id AS request_id FROM e),
u AS (SELECT DISTINCT user_id, f FROM e),
expected AS (SELECT user_id, 'protocol' AS protocol_sha256, 'inputs' AS inputs_sha256, CASE WHEN user_id % 2 = 0 THEN 'adapter' END AS adapter_sha256 FROM u),
results AS (SELECT user_id, CASE WHEN f = 15 AND k < 2 THEN 1 - k ELSE k END AS position, 'judge_score' AS kind,
    CASE WHEN f = 6 AND k = 0 THEN later WHEN f = 6 AND k = 1 THEN earlier WHEN f = 7 AND k = 1 THEN earlier ELSE event_id END AS request_id, CASE WHEN f = 8 THEN k + 1 ELSE k END AS sequence_index,
    CASE WHEN f = 9 AND k = 0 THEN 'nan'::DOUBLE ELSE value END AS score, event_id FROM e WHERE NOT (f = 5 AND k = n - 1)),
starts AS (SELECT user_id, f = 10 AS labels_mounted, CASE WHEN f = 11 THEN 3 ELSE 0 END AS gold_fields, CASE WHEN f = 12 THEN 'x' ELSE 'protocol' END AS protocol_sha256, CASE WHEN f = 13 THEN NULL ELSE 'inputs' END AS inputs_sha256,
    CASE WHEN (user_id % 2 = 0) <> (f = 14) THEN 'adapter' END AS adapter_sha256 FROM u WHERE f <> 1),
ends AS (SELECT user_id, CASE WHEN f = 3 THEN 'stopped' ELSE 'complete' END AS status FROM u UNION ALL SELECT user_id, 'complete' FROM u WHERE f = 2),
errors AS (SELECT user_id FROM u WHERE f = 4)"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, inputs and expected hashes of a run of each user, with ``FAULTS`` planted."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.read(spark, sf_dir, "events").select(
        "user_id", (F.col("user_id") % 17).alias("f"), "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"),
        F.lead("event_id", 1).over(w).alias("later"), F.lag("event_id", 1).over(w).alias("earlier"),
    )
    f, k, i = F.col("f"), F.col("k"), F.col("event_id")
    request = F.when((f == 6) & (k == 0), F.coalesce("later", i)).when(f.isin(6, 7) & (k == 1), F.coalesce("earlier", i)).otherwise(i)
    results = e.where(~((f == 5) & (k == F.col("n") - 1))).select(
        "user_id", F.when((f == 15) & (k < 2), 1 - k).otherwise(k).alias("position"), F.lit("judge_score").alias("kind"), request.alias("request_id"), F.when(f == 8, k + 1).otherwise(k).alias("sequence_index"),
        F.when((f == 9) & (k == 0), float("nan")).otherwise(F.col("value")).alias("score"), (i % 4 != 0).alias("parsed"),
    )
    users = e.select("user_id", "f").distinct()
    adapter = F.when(F.col("user_id") % 2 == 0, "adapter")
    starts = users.where(f != 1).select(
        "user_id", F.lit(-1).cast("long").alias("position"), F.lit("run_start").alias("kind"), (f == 10).alias("labels_mounted"), F.when(f == 11, 3).otherwise(0).alias("gold_fields"), F.when(f == 12, "x").otherwise("protocol").alias("protocol_sha256"),
        F.when(f != 13, "inputs").alias("inputs_sha256"), F.when((F.col("user_id") % 2 == 0) != (f == 14), "adapter").alias("adapter_sha256"),
    )
    end = users.select("user_id", "f", F.lit(1 << 40).alias("position"), F.lit("run_end").alias("kind"))
    ends = end.select("user_id", "position", "kind", F.when(f == 3, "stopped").otherwise("complete").alias("status")).unionByName(end.where(f == 2).select("user_id", "position", "kind", F.lit("complete").alias("status")))
    errors = end.where(f == 4).select("user_id", "position", F.lit("judge_error").alias("kind"))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (results, starts, ends, errors))
    expected = users.select("user_id", F.lit("protocol").alias("protocol_sha256"), F.lit("inputs").alias("inputs_sha256"), adapter.alias("adapter_sha256"))
    return records, e.select("user_id", k.alias("position"), i.alias("request_id")), expected


_CHECKS = {
    "one_start": "s.n = 1", "one_end": "d.n = 1", "status_complete": "d.n = 1 AND d.complete", "no_errors": "coalesce(x.n, 0) = 0", "count_expected": "r.n = i.n", "order_exact": "r.ids = i.ids", "ids_unique": "r.different = r.n",
    "sequence_contiguous": "r.numbers = range(r.n)", "scores_finite": "r.finite", "labels_absent": "NOT s.labels", "gold_absent": "s.gold = 0", "protocol_bound": "s.protocol = p.protocol_sha256", "inputs_bound": "s.given = p.inputs_sha256",
    "adapter_bound": "s.n = 1 AND s.adapter IS NOT DISTINCT FROM p.adapter_sha256",
}
# the twin compares whole lists in the order of the log, as the run's own auditor does
_BOUND = f"""WITH {RUNS},
i AS (SELECT user_id, count(*) AS n, list(request_id ORDER BY position) AS ids FROM inputs GROUP BY 1), s AS (SELECT user_id, count(*) AS n, bool_or(labels_mounted) AS labels, max(gold_fields) AS gold, max(protocol_sha256) AS protocol, max(inputs_sha256) AS given, max(adapter_sha256) AS adapter FROM starts GROUP BY 1),
d AS (SELECT user_id, count(*) AS n, bool_and(status = 'complete') AS complete FROM ends GROUP BY 1), x AS (SELECT user_id, count(*) AS n FROM errors GROUP BY 1),
r AS (SELECT user_id, count(*) AS n, list(request_id ORDER BY position) AS ids, count(DISTINCT request_id) AS different, list(CAST(sequence_index AS BIGINT) ORDER BY position) AS numbers, bool_and(isfinite(score)) AS finite FROM results GROUP BY 1),
a AS (SELECT p.user_id, {', '.join(f'coalesce({c}, false) AS {k}' for k, c in _CHECKS.items())} FROM expected p JOIN i USING (user_id) LEFT JOIN r USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN d USING (user_id) LEFT JOIN x USING (user_id))
{' UNION ALL '.join(f"SELECT user_id, '{k}' AS \"check\", {k} AS passed FROM a" for k in _CHECKS)}"""


@query("bound_run_audit", _BOUND)
def bound_run_audit(spark, sf_dir):
    """All conditions of the judge's audit for a run of each user; one kind of fault for each."""
    return audits.bound_judge_run(*_log(spark, sf_dir), "user_id")


@query("run_parse_rates", f"""WITH {RUNS} SELECT u.user_id, coalesce(parsed, 0) AS parsed, coalesce(total, 0) AS total, CAST(CASE WHEN u.f = 4 THEN 1 ELSE 0 END AS BIGINT) AS errors, CAST(CASE WHEN u.f = 3 THEN 0 WHEN u.f = 2 THEN 2 ELSE 1 END AS BIGINT) AS completed,
  round(CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE parsed / total::DOUBLE END, 9) AS rate FROM u LEFT JOIN (SELECT user_id, count(*) FILTER (event_id % 4 <> 0) AS parsed, count(*) AS total FROM results GROUP BY 1) USING (user_id)""")
def run_parse_rates(spark, sf_dir):
    return rounded(audits.run_summary(_log(spark, sf_dir)[0], "user_id"))


def _headroom(spark, sf_dir):
    return metrics.headroom(metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir)))


@query("gate_decision", f"SELECT 'all checks' AS gate, 'ANALYSIS_FAILED' AS decision WHERE EXISTS (SELECT * FROM ({ORACLES['gate_checks']}) WHERE NOT passed) UNION ALL SELECT 'checks that hold', decision FROM ({ORACLES['resource_decision']})")
def gate_decision(spark, sf_dir):
    """The decision of the gate with planted faults, and of its checks without those."""
    from waymark.functions.scores import resource_decision

    checks, head = audit_plans.gate_checks(spark, sf_dir), _headroom(spark, sf_dir)
    made = head.select(resource_decision("quality_headroom", "avoidable_fraction").alias("made"))
    rows = checks.select(F.lit("all checks").alias("gate"), "passed").unionAll(checks.where("passed").select(F.lit("checks that hold"), "passed"))
    held = rows.groupBy("gate").agg(F.bool_and("passed").alias("passed"))
    return held.join(F.broadcast(made)).select("gate", F.when(F.col("passed"), F.col("made")).otherwise("ANALYSIS_FAILED").alias("decision"))


#: Sections of a report: the query, and the column that names its rows (none: one row).
SECTIONS = {
    "states": ("threshold_metrics", "model"), "precision_tied": ("average_precision_tied", "model"), "precision_ordered": ("average_precision_ordered", "model"), "calibration": ("calibration", "model"), "policies": ("policy_metrics", "model"),
    "native": ("native_metrics", None), "core": ("core_policy", "model"), "masked": ("mask_counts", "model"), "comparisons": ("model_comparisons", "comparison"), "headroom": ("headroom", None), "curve": ("fixed_budget_curve", "budget"),
}


def long(df: DataFrame, section: str, name: str | None) -> DataFrame:
    """``section, name, metric, value``: a row for each number of a table."""
    values = [c for c, kind in df.dtypes if c != name and kind != "string"]
    named = (F.col(name).cast("string") if name else F.lit("all")).alias("name")
    return df.select(F.lit(section).alias("section"), named, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(["section", "name"], values, "metric", "value")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that one evaluation reports, but for what is drawn at random."""
    return reduce(DataFrame.unionAll, (long(QUERIES[q](spark, sf_dir), section, name) for section, (q, name) in SECTIONS.items()))


def _long_sql(section: str, q: str, name: str | None) -> str:
    wide = f"SELECT {f'CAST({name} AS VARCHAR)' if name else repr('all')} AS row_name, CAST(COLUMNS(* EXCLUDE ({name or 'row_name'})) AS DOUBLE) FROM (SELECT {'*' if name else repr('all') + ' AS row_name, *'} FROM ({ORACLES[q]}))"
    return f"SELECT '{section}' AS section, row_name AS name, metric, value FROM ({wide}) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (row_name))))"


@query("evaluation_report", " UNION ALL ".join(_long_sql(section, *q) for section, q in SECTIONS.items()))
def evaluation_report(spark, sf_dir):
    """All metrics of models, policies, comparisons and headroom, from one call."""
    return evaluation(spark, sf_dir)


def gated_evaluation(spark: SparkSession, sf_dir: str, replicates: int = resample.REPLICATES) -> DataFrame:
    """``section, name, metric, value, text``: the report, its intervals, its gate and what it decides.

    Intervals are those of the exact stream; the gate asks that no required
    number is missing, that EM is not inferior and that searches fall; the
    decision is ``ANALYSIS_FAILED`` unless every check holds.
    """
    from waymark.functions.scores import resource_decision

    numbers = evaluation(spark, sf_dir)
    seeds = {k: v for k, v in resample.seed_schedule(list(t.THRESHOLDS), policies.SEED).items() if k[1] != "average_precision"}
    intervals = resample.exact_paired(policies._wide(spark, sf_dir), seeds, replicates=replicates)
    bounds = intervals.select(F.lit("intervals").alias("section"), F.concat_ws(".", "comparison", "metric").alias("name"), "estimate", "low", "high").unpivot(["section", "name"], ["estimate", "low", "high"], "metric", "value")
    expanded = intervals.where("comparison = 'expanded_minus_native'").select("metric", "estimate", "low", "high")
    gate = audits.noninferiority(expanded).unionAll(audits.checks(numbers.where("section IN ('states', 'native', 'headroom')"), numbers_complete=audits.every(F.col("value").isNotNull())))
    made = _headroom(spark, sf_dir).select(resource_decision("quality_headroom", "avoidable_fraction").alias("made"))
    held = gate.agg(audits.every(F.col("passed")).alias("ok"))
    decision = held.join(F.broadcast(made)).select(F.when(F.col("ok"), F.col("made")).otherwise("ANALYSIS_FAILED").alias("text"))
    none = F.lit(None).cast("double")
    rows = numbers.unionAll(bounds).withColumn("text", F.lit(None).cast("string"))
    checks = gate.select(F.lit("gate").alias("section"), F.lit("checks").alias("name"), F.col("check").alias("metric"), F.col("passed").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
    return rows.unionAll(checks).unionAll(decision.select(F.lit("gate"), F.lit("decision"), F.lit("decision"), none, "text"))


def materialise(spark: SparkSession, sf_dir: str, path: str, replicates: int = resample.REPLICATES) -> None:
    """Write an evaluation once: ``report``, ``questions`` and ``states`` under ``path``.

    Fails before any work if one of them is there.
    """
    parts = {"report": lambda: gated_evaluation(spark, sf_dir, replicates), "questions": lambda: t.outcomes(spark, sf_dir), "states": lambda: t.scores(spark, sf_dir)}
    guard_stored(spark, *(f"{path}/{name}" for name in parts))
    for name, make in parts.items():
        write_jsonl(make(), f"{path}/{name}")
