"""Command line: python -m bytefold.cli INPUT... --to FORMAT [options]."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytefold.functions.ship import ship
from bytefold.operators.detection import DISC, FAMILIES
from bytefold.plans.convert import Params, convert_files, failures, summary
from bytefold.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytefold", description="Converts files in one Spark job.")
    p.add_argument("inputs", nargs="*", help="files or folders")
    p.add_argument("--to", "-t", help="output format")
    p.add_argument("--output-folder", "-o")
    p.add_argument("--recursive", "-r", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--quality", "-q", type=int, default=85)
    p.add_argument("--width", type=int, default=0)
    p.add_argument("--height", type=int, default=0)
    p.add_argument("--stretch", action="store_true", help="do not keep the aspect")
    p.add_argument("--method", choices=("nearest", "bilinear", "bicubic"), default="bilinear")
    p.add_argument("--rotate", type=int, default=0)
    p.add_argument("--flip-h", action="store_true")
    p.add_argument("--flip-v", action="store_true")
    p.add_argument("--unwrap", action="store_true", help="read a .gz that holds a tar as one")
    p.add_argument("--formats", action="store_true", help="list what converts")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if every file was converted."""
    a = parser().parse_args(argv)
    if a.formats:
        for name, formats in {**FAMILIES, "disc": DISC}.items():
            print(f"{name}: {', '.join(formats)}")
        return 0
    if not a.inputs or not a.to:
        parser().error("inputs and --to are needed")
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    params = Params(a.quality, a.width, a.height, not a.stretch, a.method, a.rotate, a.flip_h, a.flip_v, a.overwrite, a.unwrap)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(a.recursive).lower())
    target = os.path.abspath(a.output_folder) if a.output_folder else None
    found = reader.load([os.path.abspath(x) for x in a.inputs]).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    there = None
    if target and os.path.isdir(target):
        there = files.listing(spark, target).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    done = convert_files(found, a.to, params, target, there).persist()
    files.write_files(done.where("error is null"), "out_path").write.mode("overwrite").format("noop").save()
    s = summary(done).first()
    print(f"total {s['total']}, successful {s['successful']}, failed {s['failed']}, size {s['percent']} %")
    for f in failures(done).orderBy("path").toLocalIterator():
        print(f"failed: {f['path']}", file=sys.stderr)
    done.unpersist()
    return int(s["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
