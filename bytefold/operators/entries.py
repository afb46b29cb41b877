"""The entries of archives, disc images and filesystems as a relation, and single entries by path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.functions import codecs, disks
from bytefold.operators import detection

KIND = "path string, entry string, is_dir boolean, data binary, error string"


def _members(found: list) -> disks.Tree:
    return [(e.name, e.kind == "5" or e.name.endswith("/"), e.data) for e in found]


READERS = {
    "zip": lambda b: _members(codecs.zip_decode(b)),
    "tar": lambda b: _members(codecs.tar_decode(b)),
    "gzip": lambda b: _members(codecs.tar_decode(raw)) if (raw := codecs.gzip_decode(b))[257:262] == b"ustar" else [("data.bin", False, raw)],
    "iso": disks.iso_decode,
    "fat32": disks.fat_decode,
    "ext2": disks.ext2_decode,
}


def _plain(entry: Column) -> Column:
    return F.regexp_replace(entry, "^/+|/+$", "")


def _with_kind(files: DataFrame, kind: str | None) -> DataFrame:
    return files.select("path", "content", (F.lit(kind) if kind else detection.image_format("content")).alias("kind"))


def _tree(content: bytes | None, kind: str | None) -> tuple[disks.Tree, str | None]:
    """The entries of one file, or why it cannot be read."""
    try:
        codecs.need(kind in READERS and content is not None, "UNSUPPORTED_CONVERSION")
        return READERS[kind](content), None
    except codecs.CodecError as e:
        return [], str(e)
    except Exception as e:  # a broken image must not end the batch
        return [], f"CORRUPTED_DATA: {type(e).__name__}"


def entries(files: DataFrame, kind: str | None = None) -> DataFrame:
    """(path, entry, is_dir, data, error) of files (path, content): a row for each entry, in the image's order.

    kind: zip, tar, gzip, iso, fat32 or ext2; by content if not given. A file that cannot be read is
    one row with an error and no entry; a null content is an unknown format.
    """
    rows = _with_kind(files, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                tree, why = _tree(content.as_py(), k)
                found = [(path, None, None, None, why)] if why else [(path, name, is_dir, data, None) for name, is_dir, data in tree]
                cols = list(zip(*found, strict=True)) or [()] * 5
                types = (pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "entry", "is_dir", "data", "error"])

    return rows.mapInArrow(run, KIND)


def listed(found: DataFrame) -> DataFrame:
    """(path, entry, is_dir, size) of entries; directories end with a slash."""
    name = F.concat(_plain(F.col("entry")), F.when(F.col("is_dir"), "/").otherwise(""))
    return found.where("entry is not null").select("path", name.alias("entry"), "is_dir", F.coalesce(F.length("data"), F.lit(0)).cast("long").alias("size"))


def read_one(content: bytes | None, entry: str, kind: str | None) -> tuple[bytes | None, str | None]:
    """(data, error) of one entry of one file, for use where the content is; the last of equal names counts."""
    tree, why = _tree(content, kind)
    hits = [data for name, is_dir, data in tree if not is_dir and name.strip("/") == entry.strip("/")]
    return (hits[-1], None) if hits else (None, why or "NOT_FOUND")


def read(files: DataFrame, entry: str, kind: str | None = None) -> DataFrame:
    """(path, data, error) of one entry of each file; NOT_FOUND where it is missing or a directory. One pass: only the entry leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data, why = read_one(content.as_py(), entry, k)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary()), pa.array([why], pa.string())], names=["path", "data", "error"])

    return _with_kind(files, kind).mapInArrow(run, "path string, data binary, error string")


def targets(found: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the entries that are files, to be written below folder by write_files. Names that would leave it are left out."""
    name = _plain(F.regexp_replace("entry", r"\\\\", "/"))
    inside = ~F.concat(F.lit("/"), name, F.lit("/")).contains("/../")
    return found.where(~F.col("is_dir") & inside).select(F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path"), F.col("data").alias("content"))
