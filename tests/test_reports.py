"""Audits with a fault planted for each condition, and a whole evaluation."""

import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import audits
from waymark.plans import reports
from waymark.sources.jsonl import read_jsonl

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

RECORD = "run int, position long, kind string, request_id long, sequence_index long, score double, status string, labels_mounted boolean, gold_fields int, protocol_sha256 string, inputs_sha256 string, adapter_sha256 string"


def log(run, **fault):
    """A good run of three, but for what ``fault`` changes in its start, its end or its results."""
    start = dict(run=run, position=0, kind="run_start", labels_mounted=False, gold_fields=0, protocol_sha256="p", inputs_sha256="i", adapter_sha256=None)
    rows = [dict(run=run, position=k + 1, kind="judge_score", request_id=10 + k, sequence_index=k, score=0.5) for k in range(3)]
    end = dict(run=run, position=9, kind="run_end", status="complete")
    start |= fault.get("start", {})
    end |= fault.get("end", {})
    for k, change in fault.get("rows", {}).items():
        rows[k] |= change
    rows = [r for k, r in enumerate(rows) if k not in fault.get("lost", ())]
    return [*([] if fault.get("no_start") else [start]), *rows, *fault.get("more", []), end]


FAULTS = {
    "one_start": dict(more=[dict(run=0, position=8, kind="run_start", labels_mounted=False, gold_fields=0, protocol_sha256="p", inputs_sha256="i")]), "one_end": dict(more=[dict(run=0, position=8, kind="run_end", status="complete")]),
    "status_complete": dict(end=dict(status="stopped")), "no_errors": dict(more=[dict(run=0, position=8, kind="judge_error")]), "count_expected": dict(lost=[2]), "order_exact": dict(rows={0: dict(request_id=11), 1: dict(request_id=10)}),
    "ids_unique": dict(rows={1: dict(request_id=10)}), "sequence_contiguous": dict(rows={2: dict(sequence_index=5)}), "scores_finite": dict(rows={1: dict(score=float("inf"))}), "labels_absent": dict(start=dict(labels_mounted=True)),
    "gold_absent": dict(start=dict(gold_fields=1)), "protocol_bound": dict(start=dict(protocol_sha256="q")), "inputs_bound": dict(start=dict(inputs_sha256=None)), "adapter_bound": dict(start=dict(adapter_sha256="a")),
}
#: What else a fault breaks.
ALSO = {"one_start": {"labels_absent", "gold_absent", "adapter_bound"}, "one_end": {"status_complete"}, "count_expected": {"order_exact"}, "ids_unique": {"order_exact"}}


def frame(spark, rows):
    names = [x.split()[0] for x in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORD)


def test_every_condition_of_a_judge_run(spark):
    runs = {0: {}, **{k + 1: FAULTS[n] for k, n in enumerate(FAULTS)}, 90: dict(rows={0: dict(position=3), 2: dict(position=1)}), 91: dict(no_start=True)}
    records = frame(spark, [r | {"run": k} for k, fault in runs.items() for r in log(k, **fault)])
    inputs = spark.createDataFrame([(k, i, 10 + i) for k in [*runs, 92] for i in range(3)], "run int, position long, request_id long")
    expected = spark.createDataFrame([(k, "p", "i", None) for k in [*runs, 92]], "run int, protocol_sha256 string, inputs_sha256 string, adapter_sha256 string")
    found = {}
    for r in audits.bound_judge_run(records, inputs, expected, "run").collect():
        found.setdefault(r.run, {})[r.check] = r.passed
    assert set(found) == {*runs, 92} and all(set(c) == set(FAULTS) for c in found.values())
    failed = {k: {n for n, ok in c.items() if not ok} for k, c in found.items()}
    assert failed[0] == set() and failed[90] == {"sequence_contiguous", "order_exact"} and failed[92] == set(FAULTS)
    assert failed[91] == {"one_start", "labels_absent", "gold_absent", "protocol_bound", "inputs_bound", "adapter_bound"}
    for k, name in enumerate(FAULTS):
        assert failed[k + 1] == {name} | ALSO.get(name, set()), name


@data
def test_planted_faults_reach_every_check(spark):
    rows = reports.bound_run_audit(spark, DATA).groupBy("check").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")).collect()
    assert len(rows) == 14 and all(r.passed and r.failed for r in rows)


@data
def test_an_evaluation_is_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    reports.materialise(spark, DATA, path, replicates=50)
    report = read_jsonl(spark, f"{path}/report", "section string, name string, metric string, value double, text string").collect()
    assert {*reports.SECTIONS, "intervals", "gate"} == {r.section for r in report}
    decision = [r.text for r in report if r.metric == "decision"]
    checks = {r.metric: r.value for r in report if r.name == "checks"}
    assert len(decision) == 1 and set(checks) == {"em_not_inferior", "searches_reduced", "numbers_complete"}
    assert (decision[0] == "ANALYSIS_FAILED") == (min(checks.values()) == 0)
    assert read_jsonl(spark, f"{path}/questions", "model string").count() > 0
    with pytest.raises(FileExistsError):
        reports.materialise(spark, DATA, path)
