"""Queries: splits, exclusions, class samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text as x
from waymark.operators import permute, splits
from waymark.operators.digests import ordered_digest
from waymark.plans import tables as t
from waymark.plans.registry import query, rounded

ROWS = r"q AS (SELECT CAST(doc_id AS VARCHAR) AS original_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g')) AS normalized_question, doc_id AS source_index, lang FROM documents)"


def _rows(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("original_id"), x.normalize_question("text").alias("normalized_question"), F.col("doc_id").alias("source_index"), "lang")


def ranked(seed: str, source: str) -> str:
    return f"SELECT *, sha256('{seed}' || chr(0) || original_id || chr(0) || normalized_question) AS rank FROM {source}"


@query("hash_rank_split", f"WITH {ROWS} SELECT original_id, rank FROM ({ranked('alpha', 'q')}) ORDER BY rank, source_index LIMIT 50")
def hash_rank_split(spark, sf_dir):
    return splits.hash_rank_split(_rows(spark, sf_dir), "alpha", 50).select("original_id", "rank")


SPECS = [("train", "alpha", 40), ("validation", "beta", 20), ("test", "gamma", 20)]
DISJOINT = f"""{ROWS}, s1 AS (SELECT * FROM ({ranked('alpha', 'q')}) ORDER BY rank, source_index LIMIT 40),
s2 AS (SELECT * FROM ({ranked('beta', 'q')}) WHERE original_id NOT IN (SELECT original_id FROM s1) AND normalized_question NOT IN (SELECT normalized_question FROM s1) ORDER BY rank, source_index LIMIT 20),
s3 AS (SELECT * FROM ({ranked('gamma', 'q')}) WHERE original_id NOT IN (SELECT original_id FROM s1 UNION SELECT original_id FROM s2) AND normalized_question NOT IN (SELECT normalized_question FROM s1 UNION SELECT normalized_question FROM s2) ORDER BY rank, source_index LIMIT 20),
sp AS (SELECT 'train' AS split, * FROM s1 UNION ALL SELECT 'validation', * FROM s2 UNION ALL SELECT 'test', * FROM s3)"""


@query("disjoint_splits", f"WITH {DISJOINT} SELECT split, original_id, rank FROM sp")
def disjoint_splits(spark, sf_dir):
    return splits.disjoint_splits(_rows(spark, sf_dir), SPECS).select("split", "original_id", "rank")


@query("overlap_matrix", f"WITH {DISJOINT}, n AS (SELECT DISTINCT split FROM sp) SELECT a.split AS a, b.split AS b, (SELECT count(*) FROM sp u JOIN sp v USING (original_id) WHERE u.split = a.split AND v.split = b.split) AS shared FROM n a JOIN n b ON a.split < b.split")
def overlap_matrix(spark, sf_dir):
    return splits.overlap_matrix(splits.disjoint_splits(_rows(spark, sf_dir), SPECS), "split", "original_id")


@query("split_manifest", f"WITH {DISJOINT} SELECT split, count(*) AS n, sha256(string_agg(original_id, chr(10) ORDER BY rank, source_index)) AS ids_sha256 FROM sp GROUP BY split")
def split_manifest(spark, sf_dir):
    s = splits.disjoint_splits(_rows(spark, sf_dir), SPECS)
    return ordered_digest(s, "original_id", ["rank", "source_index"], ["split"]).withColumnRenamed("sha256", "ids_sha256")


@query("core_reserve", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY sha256('core' || chr(0) || lower(trim(c_mktsegment)) || chr(0) || CAST(c_custkey AS VARCHAR)), c_custkey) <= 20 THEN 'core' ELSE 'reserve' END AS part FROM customer")
def core_reserve(spark, sf_dir):
    return splits.core_reserve(t.read(spark, sf_dir, "customer"), "core", 20, "c_custkey", "c_mktsegment").select("c_custkey", "part")


@query("first_unique", "SELECT user_id, event_id FROM (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) ORDER BY event_id LIMIT 40")
def first_unique(spark, sf_dir):
    return splits.first_unique(t.read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 40)


@query("ordered_distinct", "SELECT user_id, min(event_id) AS first_position FROM events GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    return splits.ordered_distinct(t.read(spark, sf_dir, "events"), "user_id", "event_id")


@query("exclude_prior", f"WITH {ROWS}, u AS (SELECT * FROM q WHERE source_index % 10 = 0) SELECT original_id FROM q WHERE original_id NOT IN (SELECT original_id FROM u) AND normalized_question NOT IN (SELECT normalized_question FROM u)")
def exclude_prior(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    used = rows.where("source_index % 10 = 0")
    return splits.exclude(rows, used, "original_id", "normalized_question").select("original_id")


@query("prior_union", f"WITH {ROWS} SELECT count(*) AS n FROM (SELECT normalized_question FROM q WHERE source_index % 10 = 0 UNION SELECT normalized_question FROM q WHERE source_index % 7 = 0)")
def prior_union(spark, sf_dir):
    q = _rows(spark, sf_dir).select("normalized_question", "source_index")
    pick = lambda c: q.where(c).select("normalized_question")
    return pick("source_index % 10 = 0").union(pick("source_index % 7 = 0")).distinct().agg(F.count("*").alias("n"))


@query("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("subset_and_disjoint", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS subset, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT -doc_id - 1 FROM documents)) = 0 AS disjoint")
def subset_and_disjoint(spark, sf_dir):
    labels, docs = t.read(spark, sf_dir, "labels").select("doc_id"), t.read(spark, sf_dir, "documents").select("doc_id")
    missing = labels.join(docs, "doc_id", "left_anti").agg((F.count("*") == 0).alias("subset"))
    shared = labels.join(docs.select((-F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi").agg((F.count("*") == 0).alias("disjoint"))
    return missing.join(F.broadcast(shared))  # two one-row tables


@query("duplicate_count", f"WITH {ROWS} SELECT count(*) AS rows, count(DISTINCT normalized_question) AS different, count(*) - count(DISTINCT normalized_question) AS duplicates FROM q")
def duplicate_count(spark, sf_dir):
    return splits.duplicate_count(_rows(spark, sf_dir), "normalized_question")


@query("class_take_k", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 25")
def class_take_k(spark, sf_dir):
    return splits.class_take_k(t.read(spark, sf_dir, "labels"), "quality", "doc_id", 25).select("doc_id", "quality")


@query("oversampled", "SELECT doc_id, quality, CAST(most // n + CASE WHEN k <= most % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels), (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM labels GROUP BY quality))")
def oversampled(spark, sf_dir):
    return splits.oversampled(t.read(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "copies")


@query("best_epoch", "SELECT user_id AS epoch, round(min(value), 9) AS validation_token_nll FROM events GROUP BY user_id ORDER BY min(value), user_id LIMIT 1")
def best_epoch(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.min("value").alias("validation_token_nll"))
    return rounded(splits.best_epoch(e))


@query("suffix_slice", t.sql("SELECT question_id, native_em FROM (SELECT *, row_number() OVER (ORDER BY question_id) - 1 AS question_order FROM natives) WHERE question_order BETWEEN 20 AND 99"))
def suffix_slice(spark, sf_dir):
    from waymark.operators.ordered import ordinal

    return ordinal(t.natives(spark, sf_dir), "question_id", name="question_order").where("question_order between 20 and 99").select("question_id", "native_em")


@query("label_blind", "SELECT doc_id AS question_id, sha256(text) AS question_sha256, source AS source_split, doc_id AS source_index FROM documents")
def label_blind(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.sha2("text", 256).alias("question_sha256"), F.col("source").alias("source_split"), F.col("doc_id").alias("source_index"))


@query("epoch_order")
def epoch_order(spark, sf_dir):
    """The exact order of one balanced epoch over the labelled rows (a list on one machine)."""
    import pandas as pd

    rows = t.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("y"))

    def run(batches):
        frames = list(batches)
        if frames:
            whole = pd.concat(frames).sort_values("doc_id")
            order = splits.epoch_order(whole["y"].tolist(), 7, 1)
            yield pd.DataFrame({"place": range(len(order)), "doc_id": whole["doc_id"].to_numpy()[order]})

    return rows.coalesce(1).mapInPandas(run, "place long, doc_id long")


_EPOCH = """WITH RECURSIVE m AS (SELECT quality AS class, doc_id AS id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS member FROM labels WHERE quality IS NOT NULL),
s AS (SELECT class, count(*) AS n FROM m GROUP BY class), z AS (SELECT class, n, row_number() OVER (ORDER BY class) - 1 AS rank, max(n) OVER () AS size, count(*) OVER () AS classes FROM s),
c AS (SELECT m.*, z.* EXCLUDE (class), unnest(range(0, (size - 1) // n + 1)) AS cycle FROM m JOIN z USING (class)),
{inner},
d AS (SELECT *, size * classes AS total, rank * size + cycle * n + p AS own FROM p_done WHERE cycle * n + p < size),
{outer}
SELECT CAST(place AS BIGINT) AS place, id AS doc_id, class AS quality, CAST(cycle AS BIGINT) AS cycle FROM place_done"""


@query("balanced_epoch", _EPOCH.format(inner=permute.permuted_sql("c", "member", "n", "'7:1:' || class || ':' || cycle", "p"), outer=permute.permuted_sql("d", "own", "total", "'7:1:all'", "place")))
def balanced_epoch(spark, sf_dir):
    """One balanced epoch of the labelled rows, in an order that every row finds alone."""
    rows = permute.balanced_epoch(t.read(spark, sf_dir, "labels"), "quality", "doc_id", 7, 1)
    return rows.select("place", F.col("id").alias("doc_id"), F.col("class").alias("quality"), "cycle")
