"""Streamed decisions against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest

from waymark.operators.ordered import first_crossing
from waymark.streaming.online import decisions

START = datetime(2024, 1, 1)
SHAPE = "question_id long, state_index long, score double, ts timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def run(spark, tmp_path, batches, wait=600):
    """Rows in order of their batches; one more batch, far later, lets every timer fire."""
    src, out = str(tmp_path / "in"), []
    shape = spark.createDataFrame([], SHAPE).schema
    shape_path = spark.createDataFrame([], SHAPE)
    shape_path.write.parquet(src)
    stream = decisions(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1000).parquet(src), 0.8, wait)
    keep = lambda df, k: out.extend((k, *r) for r in df.collect())
    for rows in batches:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination(180)  # a restart a batch: state comes back from the checkpoint
    return out


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_decisions_are_those_of_the_batch_operator(stateful, tmp_path):
    spark, rng = stateful, random.Random(2)
    rows = [(q, i, rng.choice([None, 0.1, 0.5, 0.85, 0.95]), at(rng.randint(0, 300))) for q in range(30) for i in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    end = [(999, 0, 0.0, at(5000))]
    got = run(spark, tmp_path, [rows[:40], rows[40:], end, [(998, 0, 0.0, at(9000))]])
    found = {r[1]: r[2] for r in got if r[1] < 900}
    assert len(found) == 30 == sum(r[1] < 900 for r in got)  # one decision a question
    states = spark.createDataFrame([("m", q, i, s, 0, 0.0) for q, i, s, _ in rows if s is not None], "model string, question_id long, state_index long, score double, em int, f1 double")
    natives = spark.createDataFrame([(q, 0, 0.0, 0) for q in range(30)], "question_id long, native_em int, native_f1 double, native_searches long")
    want = first_crossing(states, natives, spark.createDataFrame([("m", 0.8)], "model string, threshold double"))
    assert {r.question_id: r.stop_index for r in want.collect()} == found


def test_order_lateness_and_expiry(stateful, tmp_path):
    batches = [
        [(1, 0, 0.1, at(0)), (1, 1, 0.9, at(1)), (2, 2, 0.9, at(2)), (3, 1, 0.95, at(3))],  # 1 is certain, 2 and 3 wait for earlier states
        [(2, 0, 0.2, at(20)), (2, 1, 0.85, at(21)), (1, 0, 0.99, at(22))],  # 2: an earlier one comes late; 1 stays as decided
        [(9, 0, 0.0, at(2000))],
        [(9, 1, 0.0, at(2001)), (3, 0, 0.99, at(5))],  # too late for 3
        [(8, 0, 0.0, at(9000))],
        [(8, 1, None, at(9001)), (1, 0, 0.9, at(9001))],  # 1 was forgotten and begins anew
    ]
    got = run(stateful, tmp_path, batches)
    by_question = {}
    for r in got:
        by_question.setdefault(r[1], []).append((r[2], r[3], r[4]))
    assert by_question[1] == [(1, 0.9, True), (0, 0.9, True)]
    assert by_question[2] == [(1, 0.85, True)]
    assert by_question[3] == [(1, 0.95, False)]
    assert by_question[9] == [(None, None, True)]
