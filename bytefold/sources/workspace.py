"""Intermediate tables in the folder that all executors share.

`spark.checkpoint.dir` names that folder. A written table survives the loss of any
executor and cuts the lineage, and Parquet keeps it smaller than an RDD checkpoint.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; where the session names none (tests on one machine), a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="workspace-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and reads it back. drop() it when what reads it has itself been written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._workspace_path = path
    return out


def within(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few narrow columns, to be broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def drop(*tables: DataFrame) -> None:
    for df in tables:
        path = getattr(df, "_workspace_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, which it does as the driver's garbage is collected."""
    for _ in range(2):  # Python's side lets go of the plans with a delay
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
