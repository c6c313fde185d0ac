"""A run log that a restarted run continues without losing or doubling a record.

Records are appended in batches.  A batch is written as a folder of its own
below ``_batches`` under a name that holds its number, and is part of the log
only once its commit file is there: a small JSON text with the number of
records and a digest for each file of the batch, put in place by one rename.  A
batch whose folder is there without a commit was cut off; it is written anew.
The first commit is the log's ``run_start``, the last its ``run_end``.

All of it goes through Hadoop's file systems, so the log lies wherever Spark
writes; on a store whose rename is a copy, the commit file is what counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.jsonl import _records


class RunLog:
    """``run_start``, numbered batches of records, ``run_end``, under one path."""

    def __init__(self, spark: SparkSession, path: str, start: dict):
        """Begin a run, or go on with the one that is there if it began with the same ``start``.

        Another start, or a run that has ended, is an error before any work.
        """
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        first = self._commit(-1)
        if first is None:
            self._put(-1, {"record_type": "run_start", **start})
        elif first != {"record_type": "run_start", **start}:
            raise FileExistsError(f"{path}: another run is there")
        elif self.ended():
            raise FileExistsError(f"{path}: the run has ended")

    def _at(self, name: str):
        return self.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _name(self, number: int) -> str:
        return "run_start" if number < 0 else f"batch-{number:012}"

    def _read(self, name: str) -> dict | None:
        at = self._at(f"_commits/{name}")
        if not self.files.exists(at):
            return None
        stream = self.files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int) -> dict | None:
        return self._read(self._name(number))

    def _put(self, number: int, content: dict, name: str | None = None) -> None:
        name = name or self._name(number)
        part, whole = self._at(f"_commits/.{name}.part"), self._at(f"_commits/{name}")
        out = self.files.create(part, True)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True, ensure_ascii=False).encode()))
            out.hsync()
        finally:
            out.close()
        if self.files.exists(whole) or not self.files.rename(part, whole):
            raise FileExistsError(f"{self.path}: {name} is committed already")

    def committed(self, number: int) -> bool:
        return self._commit(number) is not None

    def ended(self) -> bool:
        return self._read("run_end") is not None

    def append(self, records: DataFrame, number: int) -> bool:
        """Write a batch; ``False`` if it is in the log already (its records are not looked at then).

        The same number must hold the same records whenever it is tried.
        """
        if self.ended():
            raise FileExistsError(f"{self.path}: the run has ended")
        if self.committed(number):
            return False
        folder = f"{self.path}/_batches/{self._name(number)}"
        # overwrites what an earlier try left; Spark's committer makes the files whole
        _records(records).write.mode("overwrite").option("ignoreNullFields", False).json(folder)
        self._put(number, {"record_type": "batch", "number": number, "files": self._digests(folder)})
        return True

    def _digests(self, folder: str) -> dict[str, list]:
        """Lines and a digest of each file of a batch; one small row a file."""
        lines = self.spark.read.text(folder).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("name"), F.xxhash64("value").alias("h"))
        rows = lines.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).collect()
        return {r["name"]: [r["n"], str(r["s"])] for r in rows}

    def finish(self, **fields) -> None:
        """Write the ``run_end``; a log that has one takes no more records."""
        self._put(-1, {"record_type": "run_end", **fields}, "run_end")

    def batches(self) -> Iterator[int]:
        """Numbers of the committed batches."""
        listed = self._at("_commits")
        if self.files.exists(listed):
            for status in self.files.listStatus(listed):
                name = status.getPath().getName()
                if name.startswith("batch-"):
                    yield int(name.removeprefix("batch-"))

    def read(self, schema: str) -> DataFrame:
        """``number`` and the records of the committed batches, whose files must be as they were committed."""
        numbers = sorted(self.batches())
        for n in numbers:
            if self._commit(n)["files"] != self._digests(f"{self.path}/_batches/{self._name(n)}"):
                raise ValueError(f"{self.path}: batch {n} is not as it was committed")
        if not numbers:
            return self.spark.createDataFrame([], f"number long, {schema}")
        rows = self.spark.read.schema(schema).option("mode", "FAILFAST").json([f"{self.path}/_batches/{self._name(n)}" for n in numbers])
        return rows.select(F.regexp_extract("_metadata.file_path", r"batch-(\d+)/[^/]+$", 1).cast("long").alias("number"), *rows.columns)


def log_stream(stream: DataFrame, path: str, checkpoint: str, start: dict):
    """A streaming query that appends every micro-batch of ``stream`` to a run log, each once.

    Spark numbers micro-batches and tries one again after a failure; a batch
    that is committed is not written again.
    """
    spark = stream.sparkSession
    RunLog(spark, path, start)  # the guard fires before the stream begins

    def write(batch: DataFrame, number: int) -> None:
        RunLog(batch.sparkSession, path, start).append(batch, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
