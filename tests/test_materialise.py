"""Splits and states as files."""

import glob

import pytest
from pyspark.sql import functions as F

from waymark.sources.materialise import RunRefused, states_of_run, verify_splits, write_splits

ROWS = "split string, rank string, question_id string, question string, source_split string, source_index long, answer string"


def splits(spark):
    rows = [(s, f"{i:03}", f"{s}{i}", f"q{i}?", "train", i, f"gold {i}") for s, n in (("train", 20), ("dev", 5)) for i in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def test_splits_are_written_once_and_accounted_for(spark, tmp_path):
    path = str(tmp_path / "splits")
    manifest = write_splits(splits(spark), path, ("answer",))
    assert {k: v["count"] for k, v in manifest["files"].items()} == {"train": 20, "dev": 5} and manifest["id_overlap_counts"] == {"dev__train": 0} and manifest["all_overlap_counts_zero"]
    assert all(v["inputs"] and v["labels"] and len(v["question_ids_sha256"]) == 64 for v in manifest["files"].values())
    inputs = spark.read.json(f"{path}/inputs")
    assert "answer" not in inputs.columns and inputs.count() == 25 and "gold" not in "".join(open(f).read() for f in glob.glob(f"{path}/inputs/*/part*"))
    assert {r.answer for r in spark.read.json(f"{path}/labels").collect()} == {f"gold {i}" for i in range(20)}
    assert verify_splits(spark, path) == []
    changed = glob.glob(f"{path}/labels/split=dev/part*")[0]
    open(changed, "a").write("{}\n")
    assert [x.split("/")[1] for x in verify_splits(spark, path)] == ["split=dev"]
    with pytest.raises(FileExistsError):
        write_splits(splits(spark), path, ("answer",))


def test_what_splits_refuse(spark, tmp_path):
    rows, path = splits(spark), str(tmp_path / "x")
    for bad, labels in ((rows.unionAll(rows.limit(1)), ("answer",)), (rows.withColumn("split", F.lit(None).cast("string")), ("answer",)), (rows, ("answer", "question"))):
        with pytest.raises(ValueError):
            write_splits(bad, path, labels)
    with pytest.raises(ValueError, match="forbidden"):
        write_splits(rows, path, ("rank",), blind=("question_id", "answer"))
    assert not glob.glob(path)


LOG = "kind string, question_id string, status string, labels_mounted boolean"
GOOD = [("run_start", None, None, False), ("trajectory", "a", None, None), ("trajectory", "b", None, None), ("run_end", None, "completed", None)]
STEPS = [("a", 0, "SEARCH", True, "x"), ("a", 1, "ANSWER", True, None), ("b", 0, "ANSWER", True, None)]


def test_states_are_built_of_whole_runs_only(spark):
    steps = lambda rows=STEPS: spark.createDataFrame(rows, "question_id string, step long, action string, executed boolean, block string")
    log = lambda rows: spark.createDataFrame(rows, LOG)
    assert states_of_run(log(GOOD), steps(), 2).count() == 3
    faults = {
        "one_start": [*GOOD, GOOD[0]], "one_end": GOOD[:3], "no_errors": [*GOOD, ("trajectory_error", "a", None, None)], "status_completed": [*GOOD[:3], ("run_end", None, "stopped", None)], "count_expected": [*GOOD[:2], GOOD[3]],
        "ids_unique": [*GOOD[:2], GOOD[1], GOOD[3]], "isolated": [("run_start", None, None, True), *GOOD[1:]], "ids_present": [*GOOD[:2], ("trajectory", " ", None, None), GOOD[3]],
    }
    for name, rows in faults.items():
        with pytest.raises(RunRefused) as refused:
            states_of_run(log(rows), steps(), 2)
        assert name in refused.value.failed
    with pytest.raises(RunRefused, match="steps_match"):
        states_of_run(log(GOOD), steps(STEPS[:2]), 2)
    assert states_of_run(log([("run_start", None, None, None), *GOOD[1:]]), steps(), 2, isolation_waived=True).count() == 3
