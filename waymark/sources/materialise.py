"""Splits and states as files that are written once and accounted for."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import audits
from waymark.operators.digests import ordered_digest
from waymark.operators.ordered import expand_states
from waymark.operators.splits import overlap_matrix
from waymark.operators.staging import written_once
from waymark.sources.jsonl import _records, file_digests, guard_stored

#: What a model may see of a question.
BLIND = ("question_id", "question", "source_split", "source_index")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store; one that exists is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_splits(rows: DataFrame, path: str, labels: tuple[str, ...], order: tuple[str, ...] = ("rank", "question_id"), blind: tuple[str, ...] = BLIND) -> dict:
    """Blind inputs, labels and a manifest of splits under ``path``, in one create-only step; the manifest.

    ``rows`` has a column ``split``, the ``blind`` columns, ``labels`` and
    those of the order.  Inputs and labels lie in folders of their own, one a
    split, so they can be mounted apart.  The manifest has every split's count,
    a digest of its ids in order, the digest of every file, and how many ids
    each two splits share.  An id that a split repeats, a split that is null,
    or a label among the blind columns is an error before anything is written;
    so is a path that exists.
    """
    spark = rows.sparkSession
    guard_stored(spark, path)
    if shared := sorted(set(blind) & set(labels)):
        raise ValueError(f"labels among the inputs: {shared}")
    if leaks := audits.forbidden_columns(rows.select(*blind), audits.DENIED["final_inputs"]):
        raise ValueError(f"forbidden inputs: {leaks}")
    rows = written_once(rows)
    bad = rows.groupBy("split", "question_id").agg(F.count("*").alias("n")).where("n > 1 OR split IS NULL OR question_id IS NULL")
    if not bad.isEmpty():
        raise ValueError("ids repeat, or ids or splits are missing")
    for kind, columns in (("inputs", blind), ("labels", ("question_id", *labels))):
        _records(rows.select("split", *columns)).write.partitionBy("split").mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{kind}")
    digests = {r["split"]: (r["n"], r["sha256"]) for r in ordered_digest(rows.withColumn("id", F.col("question_id").cast("string")), "id", list(order), ["split"]).collect()}  # a row a split
    files = {}
    for r in file_digests(spark, path).orderBy("path").collect():  # a row a file
        found = re.search(r"/(inputs|labels)/split=([^/]*)/(part-[^/]+\.json)$", r["path"])
        if found:
            files.setdefault(found[2], {}).setdefault(found[1], {})[found[3]] = r["sha256"]
    overlaps = {f"{r['a']}__{r['b']}": r["shared"] for r in overlap_matrix(rows, "split", "question_id").collect()}
    manifest = {
        "files": {k: {"count": n, "question_ids_sha256": h, **files.get(k, {})} for k, (n, h) in digests.items()},
        "id_overlap_counts": overlaps, "all_overlap_counts_zero": not any(overlaps.values()), "input_gold_field_count": 0,
    }
    _write_text(spark, f"{path}/split-manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return manifest


def verify_splits(spark: SparkSession, path: str) -> list[str]:
    """Files that are not as the manifest has them, or not in it; none if all is well."""
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/split-manifest.json", wholetext=True).collect()))
    wanted = {f"{kind}/split={split}/{name}": h for split, kinds in manifest["files"].items() for kind in ("inputs", "labels") for name, h in kinds.get(kind, {}).items()}
    found = {}
    for r in file_digests(spark, path).collect():
        name = re.search(r"/((?:inputs|labels)/split=[^/]*/part-[^/]+\.json)$", r["path"])
        if name:
            found[name[1]] = r["sha256"]
    return sorted(k for k in {*wanted, *found} if wanted.get(k) != found.get(k))


class RunRefused(ValueError):
    """A run of the agent that states must not be built from."""

    def __init__(self, failed: list[str]):
        super().__init__(f"checks failed: {', '.join(failed)}")
        self.failed = failed


def states_of_run(records: DataFrame, steps: DataFrame, expected: int, isolation_waived: bool = False) -> DataFrame:
    """States of the trajectories of a run; a run that is not whole is refused before any is built.

    ``records(kind, question_id, status, labels_mounted)`` is the run's log,
    ``steps(question_id, step, action, executed, block)`` its trajectories.
    The log needs one start and one end, ``completed``, no errors, ``expected``
    trajectories of different ids, and a declared isolation from labels (or a
    waiver); every trajectory needs steps, and steps a trajectory.
    """
    records = written_once(records)
    passed = audits.trajectory_run(records, expected, isolation_waived=isolation_waived)
    ids = records.where("kind = 'trajectory'").select("question_id").distinct()
    walked = steps.select("question_id").distinct()
    whole = ids.join(walked, "question_id", "full_outer").agg(F.count("*").alias("n")).join(ids.join(walked, "question_id").agg(F.count("*").alias("both")))  # two one-row tables
    checks = passed.unionAll(whole.select(F.lit("steps_match").alias("check"), (F.col("n") == F.col("both")).alias("passed")))
    blank = records.where("kind = 'trajectory'").agg(F.coalesce(F.bool_and(F.coalesce(F.btrim(F.col("question_id").cast("string")) != "", F.lit(False))), F.lit(True)).alias("passed"))
    checks = checks.unionAll(blank.select(F.lit("ids_present").alias("check"), "passed"))
    failed = sorted(r["check"] for r in checks.where("NOT passed").collect())  # a row a check
    if failed:
        raise RunRefused(failed)
    return expand_states(steps)
