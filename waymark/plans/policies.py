"""Queries: policies, state metrics, calibration, thresholds, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.scores import ratio
from waymark.operators import joins, metrics, ordered, resample
from waymark.plans import tables as t
from waymark.plans.registry import query, rounded

OUTCOME_COLUMNS = "model, question_id, stopped_early, stop_index, em, round(f1, 9) AS f1, searches"


@query("policy_first_crossing", t.sql(f"SELECT {OUTCOME_COLUMNS} FROM outcomes"))
def policy_first_crossing(spark, sf_dir):
    return rounded(t.outcomes(spark, sf_dir).select("model", "question_id", "stopped_early", "stop_index", "em", "f1", "searches"))


SAFE = "opp AS (SELECT question_id, min(state_index) FILTER (em = 1) AS earliest_safe FROM scores WHERE model = 'structured_base' GROUP BY question_id)"


def _opportunities(spark, sf_dir):
    s = t.scores(spark, sf_dir).where("model = 'structured_base'")
    return ordered.earliest(s, F.col("em") == 1, "earliest_safe")


@query(
    "policy_metrics",
    t.sql(f"""WITH {SAFE}, a AS (
  SELECT model, count(*) AS questions, avg(em) AS mean_em, avg(f1) AS mean_f1, avg(searches) AS mean_searches, CAST(sum(native_searches - searches) AS BIGINT) AS searches_saved,
    count(*) FILTER (stopped_early) AS early_stops, count(*) FILTER (stopped_early AND em = 1) AS safe_stops, count(*) FILTER (stopped_early AND em = 0) AS unsafe_stops,
    count(*) FILTER (earliest_safe IS NOT NULL) AS opportunities, count(*) FILTER (earliest_safe IS NOT NULL AND stopped_early AND em = 1) AS caught,
    avg(stop_index - earliest_safe) FILTER (stopped_early AND em = 1 AND earliest_safe IS NOT NULL) AS mean_delay,
    count(*) FILTER (native_em = 1 AND em = 0) AS correct_to_wrong, count(*) FILTER (native_em = 0 AND em = 1) AS wrong_to_correct
  FROM outcomes LEFT JOIN opp USING (question_id) GROUP BY model)
SELECT model, questions, round(mean_em, 9) AS mean_em, round(mean_f1, 9) AS mean_f1, round(mean_searches, 9) AS mean_searches, searches_saved, early_stops, safe_stops, unsafe_stops, opportunities, caught, round(mean_delay, 9) AS mean_delay, correct_to_wrong, wrong_to_correct,
  round(CASE WHEN early_stops = 0 THEN 0 ELSE unsafe_stops / early_stops::DOUBLE END, 9) AS accepted_risk, round(CASE WHEN opportunities = 0 THEN 0 ELSE caught / opportunities::DOUBLE END, 9) AS opportunity_recall FROM a"""),
)
def policy_metrics(spark, sf_dir):
    return rounded(metrics.policy_metrics(t.outcomes(spark, sf_dir), _opportunities(spark, sf_dir)))


@query("native_metrics", t.sql("SELECT count(*) AS questions, round(avg(native_em), 9) AS mean_em, round(avg(native_f1), 9) AS mean_f1, round(avg(native_searches), 9) AS mean_searches FROM natives"))
def native_metrics(spark, sf_dir):
    return rounded(metrics.native_metrics(t.natives(spark, sf_dir)))


@query(
    "threshold_metrics",
    t.sql("""WITH c AS (SELECT s.model, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp, count(*) FILTER (score < threshold AND truth = 1) AS fn, count(*) FILTER (score < threshold AND truth = 0) AS tn
  FROM scores s JOIN thresholds USING (model) GROUP BY s.model)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9) AS recall,
  round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 9) AS stop_rate, round(fp / (tp + fp + fn + tn)::DOUBLE, 9) AS unsafe_stop_rate FROM c"""),
)
def threshold_metrics(spark, sf_dir):
    return rounded(metrics.confusion(t.scores(spark, sf_dir), t.thresholds(spark)))


CUMULATIVE = """cum AS (SELECT model, score, n, pos, sum(n) OVER w AS stops, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY model) AS positives
  FROM (SELECT model, score, count(*) AS n, sum(truth) AS pos FROM scores GROUP BY model, score) WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query("average_precision_tied", t.sql(f"WITH {CUMULATIVE} SELECT model, round(sum(CASE WHEN positives = 0 THEN 0 ELSE pos / positives::DOUBLE * (tp / stops::DOUBLE) END), 9) AS average_precision FROM cum GROUP BY model"))
def average_precision_tied(spark, sf_dir):
    return rounded(metrics.average_precision_tied(t.scores(spark, sf_dir)))


@query(
    "average_precision_ordered",
    t.sql("""SELECT model, round(coalesce(avg(tp / k::DOUBLE) FILTER (truth = 1), 0), 9) AS average_precision FROM (
  SELECT model, truth, sum(truth) OVER w AS tp, row_number() OVER w AS k FROM scores WINDOW w AS (PARTITION BY model ORDER BY score DESC, position ROWS UNBOUNDED PRECEDING)) GROUP BY model"""),
)
def average_precision_ordered(spark, sf_dir):
    return rounded(metrics.average_precision_ordered(t.scores(spark, sf_dir)))


@query(
    "recall_at_precision",
    t.sql(f"""WITH {CUMULATIVE}, best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tp DESC, tp / stops::DOUBLE DESC, score DESC) AS k FROM cum WHERE tp / stops::DOUBLE >= 0.45)
SELECT m.model, round(coalesce(tp / positives::DOUBLE, 0), 9) AS recall, round(tp / stops::DOUBLE, 9) AS precision, round(score, 9) AS threshold FROM (SELECT DISTINCT model FROM cum) m LEFT JOIN best ON best.model = m.model AND k = 1"""),
)
def recall_at_precision(spark, sf_dir):
    return rounded(metrics.recall_at_precision(t.scores(spark, sf_dir), 0.45))


@query(
    "select_threshold",
    t.sql(f"""WITH {CUMULATIVE}, best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tp DESC, tp / stops::DOUBLE DESC, score DESC) AS k FROM cum WHERE tp / stops::DOUBLE >= 0.42 AND stops >= 20)
SELECT m.model, k IS NOT NULL AS feasible, round(coalesce(score, top + 1), 9) AS threshold, round(coalesce(tp / stops::DOUBLE, 0), 9) AS precision, round(coalesce(tp / positives::DOUBLE, 0), 9) AS recall, CAST(coalesce(stops, 0) AS BIGINT) AS stops
FROM (SELECT model, max(score) AS top FROM cum GROUP BY model) m LEFT JOIN best ON best.model = m.model AND k = 1"""),
)
def select_threshold(spark, sf_dir):
    return rounded(metrics.select_threshold(t.scores(spark, sf_dir), 0.42, 20))


BINS = """p AS (SELECT model, truth, 1 / (1 + exp(-greatest(-40, least(40, score)))) AS p FROM scores),
b AS (SELECT model, CAST(i AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(truth) AS mean_truth FROM p JOIN (SELECT unnest(range(10)) AS i) ON p >= i / 10.0::DOUBLE AND (p < (i + 1) / 10.0::DOUBLE OR i = 9) GROUP BY model, i)"""


@query("calibration_bins", t.sql(f"WITH {BINS} SELECT model, bin, n, round(mean_p, 9) AS mean_p, round(mean_truth, 9) AS mean_truth FROM b"))
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(t.scores(spark, sf_dir)))


@query(
    "calibration",
    t.sql(f"""WITH {BINS} SELECT a.model, states, round(brier, 9) AS brier, round(gap / states, 9) AS ece FROM (SELECT model, count(*) AS states, avg((p - truth) ** 2) AS brier FROM p GROUP BY model) a
JOIN (SELECT model, sum(n * abs(mean_p - mean_truth)) AS gap FROM b GROUP BY model) USING (model)"""),
)
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(t.scores(spark, sf_dir)))


@query("mask_counts", t.sql("SELECT model, count(*) FILTER (failed) AS masked, count(*) AS states FROM raw_scores GROUP BY model"))
def mask_counts(spark, sf_dir):
    return t.raw_scores(spark, sf_dir).groupBy("model").agg(F.count_if("failed").alias("masked"), F.count("*").alias("states"))


@query("effective_score", t.sql("SELECT model, question_id, state_index, score FROM scores"))
def effective_score(spark, sf_dir):
    return t.scores(spark, sf_dir).select("model", "question_id", "state_index", "score")


REACH = "reach AS (SELECT question_id, state_index, coalesce(max(em) OVER (PARTITION BY question_id ORDER BY state_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS reachable FROM probes)"
CORE = f"""{REACH}, core AS (SELECT model, questions, em, searches, em - native_em AS em_delta, (native_searches - searches) / native_searches AS search_reduction, stops / questions::DOUBLE AS coverage, stops, wrong_stops, premature_stops, harmful_search_rescues,
  CASE WHEN stops = 0 THEN 1 ELSE least(1, (wrong_stops / stops::DOUBLE + z * z / (2 * stops) + z * sqrt(wrong_stops / stops::DOUBLE * (1 - wrong_stops / stops::DOUBLE) / stops + z * z / (4 * stops * stops))) / (1 + z * z / stops)) END AS accepted_risk_upper_90
  FROM (SELECT model, 1.6448536269514722::DOUBLE AS z, count(*) AS questions, avg(em) AS em, avg(searches) AS searches, avg(native_em) AS native_em, avg(native_searches) AS native_searches, count(*) FILTER (stopped_early) AS stops,
    count(*) FILTER (stopped_early AND em = 0) AS wrong_stops, count(*) FILTER (stopped_early AND em = 0 AND (coalesce(reachable, false) OR native_em = 1)) AS premature_stops, count(*) FILTER (stopped_early AND em = 1 AND native_em = 0) AS harmful_search_rescues
    FROM outcomes o LEFT JOIN reach r ON r.question_id = o.question_id AND r.state_index = o.stop_index GROUP BY model))"""


def _core(spark, sf_dir):
    reach = t.probes(spark, sf_dir).withColumn("reachable", ordered.later_correct()).select("question_id", "state_index", "reachable")
    return metrics.core_policy(t.outcomes(spark, sf_dir), reach)


@query("core_policy", t.sql(f"WITH {CORE} SELECT model, questions, round(em, 9) AS em, round(searches, 9) AS searches, round(em_delta, 9) AS em_delta, round(search_reduction, 9) AS search_reduction, round(coverage, 9) AS coverage, stops, wrong_stops, premature_stops, harmful_search_rescues, round(accepted_risk_upper_90, 9) AS accepted_risk_upper_90 FROM core"))
def core_policy(spark, sf_dir):
    return rounded(_core(spark, sf_dir))


@query(
    "improvement_flags",
    t.sql(f"""WITH {CORE}, {CUMULATIVE}, ap AS (SELECT model, sum(pos / positives::DOUBLE * (tp / stops::DOUBLE)) AS average_precision FROM cum GROUP BY model), x AS (SELECT * FROM core JOIN ap USING (model))
SELECT a.average_precision > b.average_precision AS ap_improved, a.em >= b.em AS em_not_worse, a.search_reduction > b.search_reduction AS reduction_improved, a.wrong_stops < b.wrong_stops AS fewer_wrong_stops, a.premature_stops < b.premature_stops AS fewer_premature_stops, a.accepted_risk_upper_90 < b.accepted_risk_upper_90 AS risk_bound_improved
FROM x a, x b WHERE a.model = 'expanded' AND b.model = 'structured_base'"""),
)
def improvement_flags(spark, sf_dir):
    return metrics.improvement_flags(_core(spark, sf_dir), metrics.average_precision_tied(t.scores(spark, sf_dir)), "expanded", "structured_base")


@query("pairwise_transitions", t.sql("SELECT a.model, a.em AS em, b.em AS base_em, count(*) AS n FROM outcomes a JOIN outcomes b ON a.question_id = b.question_id AND b.model = 'structured_base' WHERE a.model <> 'structured_base' GROUP BY 1, 2, 3"))
def pairwise_transitions(spark, sf_dir):
    o = t.outcomes(spark, sf_dir).select("model", "question_id", "em")
    base = o.where("model = 'structured_base'").select("question_id", F.col("em").alias("base_em"))
    return o.where("model <> 'structured_base'").join(base, "question_id").groupBy("model", "em", "base_em").agg(F.count("*").alias("n"))


SEED = 20260728
#: Replicates of the one bootstrap that draws questions as rows (n times as many joins).
HASHED = 100


def _wide(spark, sf_dir):
    return joins.comparisons(t.outcomes(spark, sf_dir))


def _deltas(spark, sf_dir):
    """Differences of one model from the agent, a row a metric."""
    o = _wide(spark, sf_dir).where("comparison = 'expanded_minus_native'")
    return o.select("question_id", F.col("em").cast("double").alias("em"), F.col("searches").cast("double").alias("searches")).unpivot("question_id", ["em", "searches"], "metric", "delta")


@query(
    "model_comparisons",
    t.sql("""WITH p AS (SELECT a.model || '_minus_native' AS comparison, em - native_em AS em, searches - native_searches AS searches FROM outcomes a
  UNION ALL SELECT a.model || '_minus_structured_base', a.em - b.em, a.searches - b.searches FROM outcomes a JOIN outcomes b ON a.question_id = b.question_id AND b.model = 'structured_base' AND a.model <> 'structured_base')
SELECT comparison, count(*) AS questions, round(avg(em), 9) AS em, round(avg(searches), 9) AS searches FROM p GROUP BY comparison"""),
)
def model_comparisons(spark, sf_dir):
    return rounded(_wide(spark, sf_dir).groupBy("comparison").agg(F.count("*").alias("questions"), F.avg("em").alias("em"), F.avg("searches").alias("searches")))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    return rounded(resample.paired_bootstrap(_deltas(spark, sf_dir), resample.REPLICATES, SEED))


@query("paired_bootstrap_exact")
def paired_bootstrap_exact(spark, sf_dir):
    """Every comparison with the seed of its place in the schedule; questions in order of their ids."""
    return rounded(resample.exact_paired(_wide(spark, sf_dir), {k: v for k, v in resample.seed_schedule(list(t.THRESHOLDS), SEED).items() if k[1] != "average_precision"}))


def _questions(spark, sf_dir):
    h = metrics.headroom_questions(t.probes(spark, sf_dir), t.natives(spark, sf_dir))
    return h.select("question_id", (F.col("quality_oracle") - F.col("native_em")).alias("quality"), "avoidable", F.col("native_searches").alias("native"))


@query("three_metric_intervals")
def three_metric_intervals(spark, sf_dir):
    return rounded(resample.three_metric_intervals(_questions(spark, sf_dir)))


@query("three_metric_intervals_exact")
def three_metric_intervals_exact(spark, sf_dir):
    return rounded(resample.exact_three_intervals(_questions(spark, sf_dir)))


@query("seed_schedule", t.sql(f"""WITH m AS (SELECT m.model, row_number() OVER (ORDER BY i) - 1 AS i FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(t.THRESHOLDS))}) AS m(model, i) WHERE model IN (SELECT DISTINCT model FROM scores)), r AS (SELECT model, row_number() OVER (ORDER BY i) AS i FROM m WHERE model <> 'structured_base')
SELECT model || '_minus_native' AS comparison, metric, CAST({SEED} + o + i AS BIGINT) AS seed FROM m, (VALUES ('em', 200), ('searches', 300)) AS k(metric, o)
UNION ALL SELECT model || '_minus_structured_base', metric, CAST({SEED} + o + i AS BIGINT) FROM r, (VALUES ('em', 0), ('searches', 100), ('average_precision', 400)) AS k(metric, o)"""))
def seed_schedule(spark, sf_dir):
    """Seeds of the comparisons of the models that the scores hold, in the order of their thresholds."""
    found = {r["model"] for r in t.scores(spark, sf_dir).select("model").distinct().collect()}  # a row a model
    rows = [(c, m, s) for (c, m), s in resample.seed_schedule([m for m in t.THRESHOLDS if m in found], SEED).items()]
    return spark.createDataFrame(rows, "comparison string, metric string, seed long")


@query("grouped_ap_bootstrap_exact")
def grouped_ap_bootstrap_exact(spark, sf_dir):
    """The gain of one model, questions resampled by the exact stream."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score"))).alias(m)
    states = t.scores(spark, sf_dir).groupBy("question_id", "state_index").agg(pick("expanded"), pick("structured_base"), F.max("truth").alias("truth"))

    seed = resample.seed_schedule(list(t.THRESHOLDS), SEED)["expanded_minus_structured_base", "average_precision"]
    return rounded(resample.exact_ap_interval(states, "expanded", "structured_base", resample.REPLICATES, seed))


@query("grouped_ap_bootstrap")
def grouped_ap_bootstrap(spark, sf_dir):
    """The same at the published number of replicates, for any number of states."""
    return rounded(resample.ap_bootstrap(t.scores(spark, sf_dir), "expanded", "structured_base", resample.REPLICATES, SEED))


@query(
    "grouped_ap_bootstrap_hash",
    t.sql(f"""WITH names AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS pick FROM (SELECT DISTINCT question_id FROM scores)),
draws AS (SELECT id // n AS replicate, id % n AS slot, CAST(('0x' || substr(sha256('{SEED}:' || (id // n) || ':' || (id % n)), 1, 8)) AS BIGINT) % n AS pick
  FROM (SELECT unnest(range({HASHED} * (SELECT count(*) FROM names))) AS id), (SELECT count(*) AS n FROM names)),
times AS (SELECT replicate, pick, count(*) AS times FROM draws GROUP BY 1, 2), b AS (SELECT replicate, model, score, sum(times) AS n, sum(times * truth) AS pos FROM times JOIN names USING (pick) JOIN scores USING (question_id) GROUP BY 1, 2, 3),
c AS (SELECT replicate, model, pos, sum(n) OVER w AS stops, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY replicate, model) AS positives FROM b WINDOW w AS (PARTITION BY replicate, model ORDER BY score DESC)),
ap AS (SELECT replicate, model, sum(CASE WHEN positives > 0 THEN pos / positives::DOUBLE * tp / stops ELSE 0 END) AS ap FROM c GROUP BY 1, 2),
s AS (SELECT list_sort(list(v)) AS v FROM (SELECT replicate, max(ap) FILTER (model = 'expanded') - max(ap) FILTER (model = 'structured_base') AS v FROM ap GROUP BY replicate))
SELECT 'average_precision' AS metric, round(v[{int(0.025 * HASHED) + 1}], 9) AS low, round(v[{int(0.975 * HASHED) + 1}], 9) AS high FROM s"""),
)
def grouped_ap_bootstrap_hash(spark, sf_dir):
    return rounded(resample.grouped_ap_bootstrap(t.scores(spark, sf_dir), "expanded", "structured_base", HASHED, SEED))


@query("system_figure", t.sql("""SELECT model, round(100 * avg(em - native_em), 9) AS em_difference_pp, round(avg(searches - native_searches), 9) AS search_difference, count(*) FILTER (stopped_early) AS early_stop_total,
  count(*) FILTER (stopped_early AND em IN (0, 1)) AS safe_plus_unsafe, round(count(*) FILTER (stopped_early AND em = 0) / count(*) FILTER (stopped_early)::DOUBLE, 9) AS unsafe_fraction FROM outcomes GROUP BY model"""))
def system_figure(spark, sf_dir):
    """What the figure of quality, cost and risk is drawn from, per model."""
    early = F.col("stopped_early")
    sums = t.outcomes(spark, sf_dir).groupBy("model").agg(
        (100 * F.avg(F.col("em") - F.col("native_em"))).alias("em_difference_pp"), F.avg(F.col("searches") - F.col("native_searches")).alias("search_difference"), F.count_if(early).alias("early_stop_total"),
        (F.count_if(early & (F.col("em") == 1)) + F.count_if(early & (F.col("em") == 0))).alias("safe_plus_unsafe"), F.count_if(early & (F.col("em") == 0)).alias("unsafe"),
    )
    return rounded(sums.withColumn("unsafe_fraction", ratio("unsafe", "early_stop_total")).drop("unsafe"))
