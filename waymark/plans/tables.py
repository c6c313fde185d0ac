"""How the driver's tables stand in for trajectories, states, probes and scores.

Each frame has a SQL twin in ``CTES``, under the name given there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Operating points of the three score functions.
THRESHOLDS = {"expanded": 3.0, "older": 3.5, "structured_base": 2.5}

CTES = {
    "steps": """steps AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ts, event_id) - 1 AS step FROM (
  SELECT event_id, ts, value, props, event_type, user_id, user_id * 100 + day(ts) AS question_id,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'SEARCH' WHEN event_type = 'purchase' THEN 'ANSWER' ELSE 'INVALID' END AS action,
    event_id % 11 <> 0 AS executed, 'fact ' || event_type || ' ' || CAST(event_id AS VARCHAR) AS block FROM events))""",
    "probes": """probes AS (SELECT question_id, step AS state_index, event_id, action AS next_action, value, CAST(event_id * 7919 % 10 < 4 AS INT) AS em,
  CASE WHEN event_id * 7919 % 10 < 4 THEN 1.0::DOUBLE ELSE (event_id % 5) / 10.0::DOUBLE END AS f1 FROM steps)""",
    "natives": """natives AS (SELECT question_id, CAST(question_id % 9 < 4 AS INT) AS native_em, (question_id % 13) / 16.0::DOUBLE AS native_f1,
  count(*) FILTER (action = 'SEARCH') AS native_searches FROM steps GROUP BY question_id)""",
    "raw_scores": """raw_scores AS (
  SELECT 'structured_base' AS model, question_id, state_index, event_id, next_action, em, f1, value / 10.0::DOUBLE - 5 AS score, false AS failed FROM probes
  UNION ALL SELECT 'expanded', question_id, state_index, event_id, next_action, em, f1, value / 16.0::DOUBLE - 3 + em, false FROM probes
  UNION ALL SELECT 'older', question_id, state_index, event_id, next_action, em, f1, (event_id * 31 % 101) / 8.0::DOUBLE - 5, event_id % 17 = 0 FROM probes)""",
    "scores": """scores AS (SELECT model, question_id, state_index, event_id, next_action, em, f1, CASE WHEN failed THEN -1e30::DOUBLE ELSE score END AS score, em AS truth, event_id AS position FROM raw_scores WHERE next_action = 'SEARCH')""",
    "thresholds": """thresholds(model, threshold) AS (VALUES """ + ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in THRESHOLDS.items()) + ")",
    "outcomes": """outcomes AS (SELECT t.model, n.question_id, h.state_index IS NOT NULL AS stopped_early, h.state_index AS stop_index, coalesce(h.em, n.native_em) AS em,
  coalesce(h.f1, n.native_f1) AS f1, coalesce(h.state_index, n.native_searches) AS searches, native_em, native_f1, native_searches
  FROM natives n CROSS JOIN thresholds t LEFT JOIN (SELECT s.*, row_number() OVER (PARTITION BY s.model, s.question_id ORDER BY s.state_index) AS k FROM scores s JOIN thresholds u ON u.model = s.model AND s.score >= u.threshold) h
  ON h.model = t.model AND h.question_id = n.question_id AND h.k = 1)""",
}
ORDER = list(CTES)


def sql(body: str) -> str:
    """A query over the tables above: those it names, and those they name, come first."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in ORDER:
            if name not in needed and f" {name}" in text.replace("\n", " ").replace("(", " "):
                needed.add(name)
                add(CTES[name].split(" AS (", 1)[1])

    add(" " + body)
    own = body.strip()
    head = "WITH " + ",\n".join(CTES[n] for n in ORDER if n in needed)
    return head + (",\n" + own[5:] if own[:5] == "WITH " else "\n" + own)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day are one trajectory."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type").isin("view", "click", "signup"), "SEARCH").when(F.col("event_type") == "purchase", "ANSWER").otherwise("INVALID")
    rows = e.select("*", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("question_id"), action.alias("action"), (F.col("event_id") % 11 != 0).alias("executed"), F.concat_ws(" ", F.lit("fact"), "event_type", F.col("event_id").cast("string")).alias("block"))
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("question_id").orderBy("ts", "event_id")).cast("long") - 1)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    correct = F.col("event_id") * 7919 % 10 < 4
    return steps(spark, sf_dir).select(
        "question_id", F.col("step").alias("state_index"), "event_id", F.col("action").alias("next_action"), "value", correct.cast("int").alias("em"), F.when(correct, 1.0).otherwise(F.col("event_id") % 5 / 10.0).alias("f1"),
    )


def natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question_id")
    return steps(spark, sf_dir).groupBy("question_id").agg(F.count_if(F.col("action") == "SEARCH").alias("native_searches")).select("question_id", (q % 9 < 4).cast("int").alias("native_em"), (q % 13 / 16.0).alias("native_f1"), "native_searches")


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' scores as rows, from one pass over the probes."""
    models = F.array(
        F.struct(F.lit("structured_base").alias("model"), (F.col("value") / 10.0 - 5).alias("score"), F.lit(False).alias("failed")),
        F.struct(F.lit("expanded").alias("model"), (F.col("value") / 16.0 - 3 + F.col("em")).alias("score"), F.lit(False).alias("failed")),
        F.struct(F.lit("older").alias("model"), (F.col("event_id") * 31 % 101 / 8.0 - 5).alias("score"), (F.col("event_id") % 17 == 0).alias("failed")),
    )
    return probes(spark, sf_dir).withColumn("m", F.explode(models)).select("m.model", "question_id", "state_index", "event_id", "next_action", "em", "f1", "m.score", "m.failed")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision states with effective scores."""
    from waymark.functions.scores import effective_score

    s = raw_scores(spark, sf_dir).where("next_action = 'SEARCH'")
    return s.select("model", "question_id", "state_index", "event_id", "next_action", "em", "f1", effective_score("score", "failed").alias("score"), F.col("em").alias("truth"), F.col("event_id").alias("position"))


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(THRESHOLDS.items()), "model string, threshold double")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.operators.ordered import first_crossing

    return first_crossing(scores(spark, sf_dir), natives(spark, sf_dir), thresholds(spark))
