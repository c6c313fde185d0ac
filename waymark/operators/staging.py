"""Tables written on the way, where a plan has to be evaluated once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, which driver and executors share.

    A cluster that names none is an error; a session on one machine gets a
    temporary folder that ends with the driver.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if base is None:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back.

    Whatever reads it sees the same rows, also after executors were lost.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
