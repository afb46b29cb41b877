"""Entries of archives and images, by path and into a folder; settings; detection corners."""

import os

import pytest
from pyspark.sql import functions as F

from bytefold.functions import codecs, disks
from bytefold.operators import detection, entries
from bytefold.sources import files

TREE = [("DOCS/", True, b""), ("DOCS/A.TXT", False, b"hello"), ("DOCS/SUB/", True, b""), ("DOCS/SUB/B.BIN", False, bytes(range(256)) * 40), ("TOP.TXT", False, b"top")]
MEMBERS = [codecs.Entry(n, d) for n, is_dir, d in TREE if not is_dir]


@pytest.fixture(scope="module")
def images(spark):
    made = [("i.iso", disks.iso_encode(TREE)), ("f.img", disks.fat_encode(TREE)), ("z.zip", codecs.zip_encode(MEMBERS)), ("t.tar", codecs.tar_encode(MEMBERS)), ("t.tgz", codecs.gzip_encode(codecs.tar_encode(MEMBERS))), ("g.gz", codecs.gzip_encode(b"alone")), ("bad.zip", b"PK\3\4 nothing"), ("none", b"?"), ("null", None)]
    return spark.createDataFrame(made, "path string, content binary").repartition(3)


def test_entries_and_listing(images):
    found = entries.entries(images).cache()
    want = {(n.strip("/"), d) for n, is_dir, d in TREE if not is_dir}
    for p in ("i.iso", "f.img", "z.zip", "t.tar", "t.tgz"):
        assert {(r["entry"], bytes(r["data"])) for r in found.where((F.col("path") == p) & ~F.col("is_dir")).collect()} == want
    assert [(r["entry"], bytes(r["data"])) for r in found.where("path = 'g.gz'").collect()] == [("data.bin", b"alone")]
    assert {r["path"]: r["error"] for r in found.where("error is not null").collect()} == {"bad.zip": "CORRUPTED_DATA", "none": "UNSUPPORTED_CONVERSION", "null": "UNSUPPORTED_CONVERSION"}
    assert {tuple(r) for r in entries.listed(found).where("path = 'i.iso'").select("entry", "size").collect()} == {(n, len(d)) for n, _, d in TREE}
    found.unpersist()


def test_one_entry_by_path(images):
    got = {r["path"]: (r["data"] and bytes(r["data"]), r["error"]) for r in entries.read(images, "/DOCS/SUB/B.BIN").collect()}
    assert all(got[p] == (TREE[3][2], None) for p in ("i.iso", "f.img", "z.zip", "t.tar", "t.tgz"))
    assert got["g.gz"] == (None, "NOT_FOUND") and got["bad.zip"] == (None, "CORRUPTED_DATA")
    assert {r["error"] for r in entries.read(images.where("path = 'i.iso'"), "DOCS").collect()} == {"NOT_FOUND"}


def test_one_entry_in_one_pass(spark):
    """Files are decoded once, each by itself, and what was read is all that moves on."""
    made = [("a", codecs.tar_encode([codecs.Entry("x", b"1"), codecs.Entry("x", b"2")])), ("a", codecs.tar_encode([codecs.Entry("x", b"3")])), (None, codecs.tar_encode([codecs.Entry("x", b"4")]))]
    got = entries.read(spark.createDataFrame(made, "path string, content binary"), "x")
    assert sorted((r["path"] or "", bytes(r["data"])) for r in got.collect()) == [("", b"4"), ("a", b"2"), ("a", b"3")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    assert entries.read_one(disks.fat_encode(TREE), "docs", "fat32") == (None, "NOT_FOUND")


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_volumes_stay_in_their_worker(spark):
    from bytefold.plans import catalog

    plan = catalog.fat_read(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "content" not in plan and "Join" not in plan


def test_extraction_to_a_folder(spark, images, tmp_path):
    out = files.write_files(entries.targets(entries.entries(images.where("path = 'i.iso'")), f"file:{tmp_path}/a"), "path").collect()
    assert len(out) == 3 and all(r["error"] is None for r in out)
    assert (tmp_path / "a/DOCS/SUB/B.BIN").read_bytes() == TREE[3][2] and (tmp_path / "a/TOP.TXT").read_bytes() == b"top"
    evil = spark.createDataFrame([("z", "../x", False, b"1", None), ("z", "a/../../x", False, b"1", None), ("z", "/abs", False, b"2", None)], entries.KIND)
    assert [r["path"] for r in entries.targets(evil, "/out").collect()] == ["/out/abs"]
    assert files.write_files(spark.createDataFrame([("nosuch://a/b", b"x")], "path string, content binary")).first()["error"]


def test_settings(spark, tmp_path):
    (tmp_path / "s.ini").write_text("# c\na = 12x\nb= yes\nc =1.5e1 k\na = 7\nbroken\n")
    s = files.settings(spark, str(tmp_path / "s.ini"))
    got = {r["name"]: (r["i"], r["f"], r["b"]) for r in s.select("name", files.as_int(F.col("value")).alias("i"), files.as_float(F.col("value")).alias("f"), files.as_bool(F.col("value")).alias("b")).collect()}
    assert got == {"a": (7, 7.0, False), "b": (None, None, True), "c": (1, 15.0, False)}
    s = files.with_setting(files.with_setting(files.with_setting(s, "a", True), "d", 0.25), "e", 3)
    assert [files.setting(s, n) for n in "ade"] == ["true", "0.250000", "3"] and files.setting(s, "zz", "no") == "no"
    assert files.temp_folder() and files.home_folder()


def test_extensions_in_any_case(spark):
    df = spark.createDataFrame([("PNG",), ("md",), ("nope",), (None,)], "ext string")
    got = {r["ext"]: (r["category"], r["ok"], r["disc"]) for r in detection.by_extension(df).withColumn("ok", detection.is_supported("ext")).withColumn("disc", detection.disc_extension(F.lit("iso"))).collect()}
    assert got == {"PNG": ("image", True, ".iso"), "md": ("document", True, ".iso"), "nope": ("unknown", False, ".iso"), None: ("unknown", False, ".iso")}
