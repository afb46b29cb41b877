import io
import zipfile

import numpy as np
import pytest

from bytefold import cli
from bytefold.functions import codecs
from bytefold.plans.convert import Params, convert_bytes, convert_files, failures, family, summary
from bytefold.sources import files
from bytefold.streaming import inbox


def gradient():
    y, x = np.mgrid[:64, :64]
    return np.stack([x * 255 // 64, y * 255 // 64, (x + y) * 255 // 128], axis=2).astype(np.uint8)


def test_families():
    assert family("bmp", "png") == "image" and family("vhd", "iso") == "disc" and family("iso", "iso") is None
    assert family("png", "zip") is None and family(None, "png") is None
    with pytest.raises(codecs.CodecError):
        convert_bytes(b"x", "png", "zip")


def test_batch(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    rows = [("a/g.bmp", codecs.bmp_encode(gradient())), ("a/bad.png", b"nope"), ("a/x.zip", z.getvalue()), ("a/there.bmp", codecs.bmp_encode(gradient())), ("a/none.xyz", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    there = spark.createDataFrame([("out/there.png",)], "path string")
    done = convert_files(df, "png", Params(width=32, height=64), "out", there).cache()
    got = {r["path"]: r for r in done.collect()}
    assert codecs.png_decode(bytes(got["a/g.bmp"]["content"])).shape == (32, 32, 3)
    assert got["a/g.bmp"]["out_path"] == "out/g.png" and got["a/g.bmp"]["error"] is None
    assert got["a/bad.png"]["error"] == "INVALID_FORMAT" and got["a/x.zip"]["error"] == got["a/none.xyz"]["error"] == "UNSUPPORTED_CONVERSION"
    assert got["a/there.bmp"]["error"] == "FILE_EXISTS"
    s = summary(done).first()
    assert (s["total"], s["successful"], s["failed"]) == (5, 1, 4) and failures(done).count() == 4


def test_documents_and_sniffed_types(spark):
    rows = [("n.md", b"# T\n**x** [a](b)"), ("empty.md", b""), ("p.txt", codecs.png_encode(gradient()))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in convert_files(df, "txt").collect()}
    assert bytes(got["n.md"]["content"]) == b"T\nx a\n"
    assert got["empty.md"]["error"] == "INVALID_PARAMETER" and got["p.txt"]["error"] == "UNSUPPORTED_CONVERSION"


def test_files_cli_and_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "deep").mkdir(parents=True)
    (src / "g.BMP").write_bytes(codecs.bmp_encode(gradient()))
    (src / "deep" / "h.ppm").write_bytes(codecs.netpbm_encode(gradient()))
    assert files.read_files(spark, str(src), True, ["bmp"]).count() == 1
    assert files.missing(files.listing(spark, str(src), True), files.listing(spark, str(src))).count() == 1
    assert cli.main([str(src), "-r", "--to", "png", "-o", str(out)]) == 0
    assert (codecs.png_decode((out / "g.png").read_bytes()) == gradient()).all() and (out / "h.png").exists()
    assert cli.main([str(src), "-r", "--to", "png", "-o", str(out)]) == 1  # outputs are there
    assert cli.main([str(src), "-r", "--to", "png", "-o", str(out), "--overwrite"]) == 0
    (tmp_path / "c.ini").write_text("# note\na = 1\na = yes\nb=x=y\n")
    got = {r["name"]: r["value"] for r in files.settings(spark, str(tmp_path / "c.ini")).collect()}
    assert got == {"a": "yes", "b": "x=y"}
    q = inbox.watch(spark, str(src), str(tmp_path / "stream"), str(tmp_path / "log"), "tga", str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert (codecs.tga_decode((tmp_path / "stream" / "g.tga").read_bytes()) == gradient()).all()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_sniffers_know_their_formats(spark):
    from pyspark.sql import functions as F

    from bytefold.functions import disks
    from bytefold.operators import detection as D

    tree = [("a.txt", False, b"x" * 3000)]
    mesh = codecs.obj_decode(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    made = {
        "obj": codecs.obj_encode(mesh),
        "stl": codecs.stl_encode(mesh, False),
        "tar": codecs.tar_encode([codecs.Entry("a", b"b")]),
        "zip": codecs.zip_encode([codecs.Entry("a", b"b")]),
        "gzip": codecs.gzip_encode(b"x" * 99),
        "wav": codecs.wav_encode(codecs.Audio(samples=bytes(16))),
        "netpbm": codecs.netpbm_encode(gradient()),
        "fat32": disks.fat_encode(tree)[:4096],
    }
    df = spark.createDataFrame([(k, v) for k, v in made.items()], "kind string, b binary")
    got = df.select("kind", *[getattr(D, f"is_{k}")("b").alias(k) for k in made]).collect()
    for r in got:
        assert r[r["kind"]], r["kind"]
        assert not any(r[k] for k in made if k not in (r["kind"], "obj"))
    raw = bytes(4096)
    discs = {"iso": disks.iso_encode(tree), "vhd": disks.vhd_encode(raw), "chd": disks.chd_encode(raw), "cue": b'FILE "a.bin" BINARY\n TRACK 01 AUDIO\n', "bin": b"\0" + b"\xff" * 10 + b"\0" + bytes(2340)}
    df = spark.createDataFrame([(k, v) for k, v in discs.items()], "kind string, b binary")
    assert all(r["kind"] == r["f"] for r in df.select("kind", D.disc_format("b").alias("f")).collect())
    assert df.select(D.disc_name(F.col("kind")).alias("n")).where("n = 'Unknown'").count() == 0


def test_pixel_relation_equals_arrays(spark):
    from bytefold.operators import pixels
    from bytefold.plans import catalog

    for method in ("nearest", "bilinear", "bicubic"):
        df, w, h = pixels.convert(catalog.gradient(spark), 64, 64, flip_h=True, degrees=90, new_width=20, new_height=31, method=method)
        want = codecs.image_transform(gradient(), flip_h=True, degrees=90, width=20, height=31, method=method)
        assert want.shape[:2] == (h, w)
        got = {(r["y"], r["x"], r["c"]): r["v"] for r in df.collect()}
        worst = max(abs(got[y, x, c] - int(want[y, x, c])) for y in range(h) for x in range(w) for c in range(3))
        assert worst <= (1 if method == "bicubic" else 0)


def test_obj_as_relations(spark):
    from bytefold.operators import relations

    df = spark.createDataFrame([(1, "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2/5 3//1 -1\nf 0 9 1\n")], "id int, c string")
    points, faces = relations.obj_faces(df, "id", "c")
    assert points.count() == 4
    assert [(r["corner"], r["no"]) for r in faces.where("face = 4").orderBy("corner").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
