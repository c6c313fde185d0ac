"""What several operators share: reading tables, shared folders, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For sessions on one machine that name no shared folder (tests).
LOCAL_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read through Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; a cluster that names none is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if base is None:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_DIR
    path = f"{base.rstrip('/')}/waymark-{uuid.uuid4().hex}"
    if base == LOCAL_DIR:  # nobody else looks after the folder
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def staged(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``staged`` frame that nothing reads any more."""
    files = df.sparkSession._jvm.org.apache.hadoop.fs
    # the folder that the frame was read from, not a list of its files
    for root in re.findall(r"[^\s\[\],]*/waymark-[0-9a-f]{32}", df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().mkString(",")):
        path = files.Path(root)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter in ``sifted``; its table has a row for every 64 of them.
FILTER_BITS = 1 << 24


def _filter(ids: DataFrame, column: str) -> tuple[DataFrame, Column, Column]:
    """A table of filter words, the word a row of ``column`` is in, and its bit there.

    What is broadcast has at most ``FILTER_BITS / 64`` rows (4 MB) whatever the
    tables hold.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    words = ids.select(F.shiftright(place("id"), 6).alias("sift_word"), bit("id").alias("m")).groupBy("sift_word").agg(F.bit_or("m").alias("sift_bits"))
    return F.broadcast(words), F.shiftright(place(column), 6), F.coalesce(F.col("sift_bits").bitwiseAND(bit(column)), F.lit(0)) != 0


def sifted(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` may be among ``ids(id)``: all that are, and a few more.

    With very many ids all rows pass.
    """
    words, word, hit = _filter(ids, column)
    return rows.join(words, word == F.col("sift_word")).where(hit).drop("sift_word", "sift_bits")


def split_by(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be among ``ids(id)``, and rows whose is not; equal values stay together."""
    words, word, hit = _filter(ids, column)
    marked = rows.join(words, word == F.col("sift_word"), "left")
    return tuple(marked.where(c).drop("sift_word", "sift_bits") for c in (hit, ~hit))


def without(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is not among ``ids(id)``; nulls stay.

    Only rows that the filter cannot rule out are shuffled.
    """
    maybe, sure = split_by(rows, ids, column)
    return sure.unionAll(maybe.join(ids.select(F.col("id").alias("sift_id")).distinct(), F.col(column) == F.col("sift_id"), "left_anti"))


#: Rows of an Arrow batch; at ten times as many, long texts fill the executors.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches of its session are small, unless they are set already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:  # Spark's default
        conf.set(key, BATCH_ROWS)
    return df


def hand_back() -> None:
    """Unused memory goes back to the system, from Arrow's pool and, with glibc, from malloc, which keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_resident: dict = {}


def resident(key, build):
    """What ``build`` makes, kept in this Python worker until another key asks.

    One operator at a time has its memory there, whatever ran before it.
    """
    if key not in _resident:
        _resident.clear()
        hand_back()
        _resident[key] = build()
    return _resident[key]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    lengths = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
