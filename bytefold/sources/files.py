"""Whole files as rows, and rows as files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.operators import paths

FILE = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, folder: str, recursive: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content); content is only read where it is selected. Extensions match in any case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.where(paths.extension(F.col("path")).isin([e.lower() for e in extensions])) if extensions else df


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    return read_files(spark, folder, recursive).select("path", "length")


def missing(df: DataFrame, there: DataFrame, path: str = "path") -> DataFrame:
    """Rows of df whose path is not in a listing."""
    return df.join(there.select(F.col("path").alias("_there")), F.col(path) == F.col("_there"), "left_anti")


def write_files(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, written, error): each row's content as one file, parents created; run by an action.

    A path with a scheme (s3, gs, hdfs, file) is written through its filesystem by pyarrow, any other
    must lie in a folder that every executor sees under the same name. A file is written under a
    temporary name and moved, so a repeated task leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, why = [], []
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    data = c.as_py() or b""
                    fs, p = pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", p)) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", p) else (pafs.LocalFileSystem(), p)
                    if os.path.dirname(p):
                        fs.create_dir(os.path.dirname(p), recursive=True)
                    part = f"{p}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, p)
                    done.append(len(data))
                    why.append(None)
                except (OSError, pa.ArrowException) as e:
                    done.append(0)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.int64()), pa.array(why, pa.string())], names=["path", "written", "error"])

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, written long, error string")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a `name = value` file with # comments; the last value of a name wins."""
    lines = spark.read.text(path).withColumn("no", F.monotonically_increasing_id()).withColumn("l", F.trim("value"))
    lines = lines.where("l <> '' and not l like '#%' and instr(l, '=') > 0")
    return lines.groupBy(F.trim(F.substring_index("l", "=", 1)).alias("name")).agg(F.max_by(F.trim(F.expr("substring(l, instr(l, '=') + 1)")), "no").alias("value"))


def as_bool(value: Column) -> Column:
    return value.isin("true", "1", "yes")


def as_int(value: Column) -> Column:
    """The leading whole number; null if there is none."""
    return F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def as_float(value: Column) -> Column:
    """The leading decimal number; null if there is none."""
    return F.regexp_extract(value, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("float")


def setting(df: DataFrame, name: str, default: str | None = None) -> str | None:
    """One setting's text, or the default."""
    row = df.where(F.col("name") == name).select("value").first()
    return default if row is None else row["value"]


def with_setting(df: DataFrame, name: str, value: str | bool | int | float) -> DataFrame:
    """(name, value) with one setting put or replaced; floats have six decimals."""
    shown = str(value).lower() if isinstance(value, bool) else f"{value:.6f}" if isinstance(value, float) else str(value)
    return df.where(F.col("name") != name).unionByName(df.sparkSession.createDataFrame([(name, shown)], "name string, value string"))


def temp_folder() -> str:
    return tempfile.gettempdir()


def home_folder() -> str:
    return os.path.expanduser("~")


def save_settings(df: DataFrame, path: str) -> None:
    """(name, value) as a `name = value` file, sorted by name."""
    df.select(F.concat("name", F.lit(" = "), "value").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)
