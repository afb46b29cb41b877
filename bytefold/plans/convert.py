"""Batches of file conversions: one row a file, errors as data, a summary at the end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.functions import codecs, disks
from bytefold.operators import detection, paths, text
from bytefold.operators.detection import DISC, FAMILIES


@dataclass(frozen=True)
class Params:
    quality: int = 85
    width: int = 0
    height: int = 0
    keep_aspect: bool = True
    method: str = "bilinear"
    degrees: int = 0
    flip_h: bool = False
    flip_v: bool = False
    overwrite: bool = False
    unwrap: bool = False  # read a .gz that holds a tar as one


def family(source: str | None, target: str) -> str | None:
    for name, formats in {**FAMILIES, "disc": DISC}.items():
        if source in formats and target in formats and not (name == "disc" and source == target):
            return name
    return None


def convert_bytes(data: bytes, source: str, target: str, p: Params = Params()) -> bytes:
    """One conversion in memory; raises CodecError."""
    kind = family(source, target)
    codecs.need(kind is not None, "UNSUPPORTED_CONVERSION")
    if kind == "image":
        x = codecs.image_transform(codecs.IMAGE_IN[source](data), p.flip_h, p.flip_v, p.degrees, p.width, p.height, p.method, p.keep_aspect)
        return codecs.image_encode(x, target, p.quality)
    if kind == "model3d":
        mesh = (codecs.obj_decode if source == "obj" else codecs.stl_decode)(data)
        return codecs.obj_encode(mesh) if target == "obj" else codecs.stl_encode(mesh, p.quality >= 50)
    if kind == "archive":
        return codecs.archive_convert(data, source, target, p.quality, p.unwrap)
    if kind == "disc":
        return disks.disc_convert(data, source, target)
    codecs.need(len(data) > 0, "INVALID_PARAMETER")
    return data  # documents are converted by expressions


def convert_files(files: DataFrame, to: str, params: Params = Params(), folder: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(path, out_path, content, error, in_size, out_size) of files (path, content).

    Markdown to text is a column expression; binary formats go through one Arrow pass. existing: a
    listing of files; without `overwrite`, an output that is there counts as failed.
    """
    ext = paths.extension(F.col("path"))
    df = files.select("path", "content").withColumn("ext", ext).withColumn("source", detection.detected("content", "ext"))
    out = paths.change_extension(F.col("path") if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), paths.filename(F.col("path"))), F.lit(to))
    df = df.withColumn("out_path", out).withColumn("in_size", F.length("content").cast("long"))
    taken = F.lit(False)
    if existing is not None and not params.overwrite:
        df = df.join(existing.select(F.col("path").alias("out_path"), F.lit(True).alias("_taken")).distinct(), "out_path", "left")
        taken = F.coalesce("_taken", F.lit(False))
    df = df.withColumn("taken", taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, why = [], []
            for data, source, used in zip(b.column(2), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                try:
                    codecs.need(not used, "FILE_EXISTS")
                    made.append(convert_bytes(data.as_py() or b"", source, to, params))
                    why.append(None)
                except codecs.CodecError as e:
                    made.append(None)
                    why.append(str(e))
                except Exception as e:  # a broken file must not end the batch
                    made.append(None)
                    why.append(f"CORRUPTED_DATA: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array(why, pa.string()), b.column(3), b.column(4)], names=["path", "out_path", "content", "error", "source", "in_size"])

    done = df.select("path", "out_path", "content", "source", "in_size", "taken").mapInArrow(run, "path string, out_path string, content binary, error string, source string, in_size long")
    if to == "txt":
        plain = F.encode(text.strip_markdown("decode(content, 'UTF-8')"), "UTF-8")
        done = done.withColumn("content", F.when((F.col("source") == "md") & F.col("error").isNull(), plain).otherwise(F.col("content")))
    return done.select("path", "out_path", "content", "error", "in_size", F.length("content").cast("long").alias("out_size"))


def summary(done: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(total, successful, failed, percent), one row or one for each value of `by`; failures() has the failed files."""
    bad = F.col("error").isNotNull()
    return done.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(~bad).alias("successful"),
        F.count_if(bad).alias("failed"),
        F.round(F.sum(F.when(~bad, F.col("out_size"))) * 100.0 / F.sum(F.when(~bad, F.col("in_size"))), 1).alias("percent"),
    )


def failures(done: DataFrame) -> DataFrame:
    """(path, error) of the files that failed."""
    return done.where("error is not null").select("path", "error")
