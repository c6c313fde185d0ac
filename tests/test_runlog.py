"""Run logs: killed and resumed runs, guards, damaged batches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from waymark.sources import runlog
from waymark.sources.runlog import RunLog, log_stream

START = {"protocol_sha256": "p", "labels_mounted": False}
SHAPE = "id long, x string"


def records(spark, a, b):
    return spark.range(a, b).select("id", F.concat(F.lit("ü\n"), F.col("id").cast("string")).alias("x")).repartition(3)


def ids(log):
    return sorted((r.number, r.id) for r in log.read(SHAPE).collect())


def test_a_killed_run_goes_on_without_loss_or_repeat(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log = RunLog(spark, path, START)
    assert log.read(SHAPE).count() == 0 and log.append(records(spark, 0, 10), 0)
    # killed while it writes files, after them, and after the commit
    with pytest.raises(Exception, match="boom"):
        log.append(records(spark, 10, 20).withColumn("x", F.raise_error(F.lit("boom"))), 1)
    with monkeypatch.context() as m:
        m.setattr(RunLog, "_put", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            log.append(records(spark, 10, 20), 1)
    assert ids(log) == [(0, i) for i in range(10)]  # what has no commit is no part of the log
    again = RunLog(spark, path, START)
    assert not again.append(records(spark, 0, 10), 0) and again.append(records(spark, 10, 20), 1) and again.append(records(spark, 20, 20), 2)
    assert ids(again) == [(i // 10, i) for i in range(20)] and sorted(again.batches()) == [0, 1, 2]
    again.finish(status="complete", results=20)
    assert ids(again) == [(i // 10, i) for i in range(20)]
    for late in (lambda: again.append(records(spark, 0, 1), 3), lambda: RunLog(spark, path, START), again.finish):
        with pytest.raises(FileExistsError):
            late()


def test_another_run_is_refused_and_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    log = RunLog(spark, path, START)
    log.append(records(spark, 0, 10), 0)
    with pytest.raises(FileExistsError, match="another run"):
        RunLog(spark, path, START | {"protocol_sha256": "q"})
    name = max(glob.glob(f"{path}/_batches/*/*.json"), key=os.path.getsize)
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))  # of the local file system alone
    with open(name, "a") as f:
        f.write('{"id": 99, "x": "added"}\n')
    with pytest.raises(ValueError, match="not as it was committed"):
        log.read(SHAPE)


def test_streamed_batches_are_written_once(spark, tmp_path, monkeypatch):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "check"))
    records(spark, 0, 5).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SHAPE).parquet(source)
    go = lambda: log_stream(stream, path, checkpoint, START).trigger(availableNow=True).start().awaitTermination(120)
    go()
    records(spark, 5, 9).coalesce(1).write.mode("append").parquet(source)
    whole = RunLog.append

    def cut(self, batch, number):
        whole(self, batch, number)
        raise OSError("killed after the commit")

    with monkeypatch.context() as m:
        m.setattr(runlog.RunLog, "append", cut)
        with pytest.raises(Exception, match="killed after"):
            go()
    go()  # Spark tries the batch again
    assert [i for _, i in ids(RunLog(spark, path, START))] == list(range(9))
