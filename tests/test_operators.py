"""Golden vectors and properties of the relational operators."""

import tarfile

from pyspark.sql import functions as F

from bytefold.operators import checks, pixels, relations


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_checksums(spark):
    nine = "cast('123456789' as binary)"
    r = one(spark, checks.crc32(nine), checks.crc16(nine), checks.lfn_checksum("cast('README  TXT' as binary)"), checks.lfn_checksum("cast(rpad('FOO', 11, ' ') as binary)"))
    assert tuple(r) == (3421780262, 0x4B37, 115, 136)
    head = tarfile.TarInfo("a/name").tobuf(tarfile.USTAR_FORMAT)[:512]
    df = spark.createDataFrame([(head,)], "h binary")
    assert df.select(checks.tar_checksum("h")).first()[0] == int(head[148:154], 8)


def test_numbers(spark):
    mib = 1 << 20
    sizes = spark.createDataFrame([(n * mib,) for n in (1, 100, 1024, 10240, 204800)], "s long")
    got = [tuple(r[0]) for r in sizes.select(checks.vhd_geometry("s")).collect()]
    assert got == [(30, 4, 17), (1003, 12, 17), (2080, 16, 63), (20805, 16, 63), (65535, 16, 255)]
    assert one(spark, checks.msf_frames(F.lit(2), F.lit(3), F.lit(4)))[0] == 9229
    assert tuple(one(spark, checks.safe_div("7", "0"), checks.next_power_of_2("0"), checks.next_power_of_2("5"), checks.next_power_of_2("8"), F.expr(checks.gcd("12", "18")), checks.lcm("4", "6"))) == (0, 1, 8, 8, 6, 12)
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (6,), (8,)], "v int").select(checks.is_power_of_2(F.col("v"))).collect()] == [False, True, False, True]
    names = spark.createDataFrame([("readme.txt", "README  TXT", "README.TXT"), ("long_filename", "LONG_FIL   ", "LONG_FIL"), ("..", "..         ", "..")], "n string, f string, d string")
    for r in names.select("*", checks.fat_name(F.col("n")).alias("a"), checks.fat_decoded(F.col("f")).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["f"], r["d"])
    assert tuple(one(spark, checks.iso_name(F.lit("long file name")), checks.iso_name(F.lit("a b.c")), checks.iso_decoded(F.lit("X.;1")))) == ("LONG_FIL;1", "A_B.C;1", "X")


def test_gray_and_boxes(spark):
    px = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 255, 255)], "r int, g int, b int")
    assert [r[0] for r in px.select(pixels.gray(*map(F.col, "rgb"))).collect()] == [76, 149, 29, 127, 255]
    boxes = [tuple(one(spark, pixels.fit_box(*map(str, b)))[0]) for b in ((64, 64, 32, 64), (100, 50, 30, 30), (3, 7, 10, 10))]
    assert boxes == [(32, 32), (30, 15), (4, 10)]


def test_turns_and_flips_are_groups(spark):
    df = spark.range(12).selectExpr("0 as image_id", "cast(id div 4 as int) as y", "cast(id % 4 as int) as x", "0 as c", "cast(id as int) as v")
    start = {tuple(r) for r in df.collect()}
    turned, w, h = df, 4, 3
    for _ in range(4):
        turned, w, h = pixels.convert(turned, w, h, degrees=90)
    assert (w, h) == (4, 3) and {tuple(r) for r in turned.collect()} == start
    twice = pixels.flip(pixels.flip(df, "4", "3"), "4", "3")
    assert {tuple(r) for r in twice.select("image_id", "y", "x", "c", "v").collect()} == start


def test_audio(spark):
    mono = spark.range(10).selectExpr("1 as audio_id", "id as frame", "0 as ch", "cast(id * 10 - 45 as int) as v")
    back = relations.to_mono(relations.to_stereo(mono))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mono.collect()))
    up = {r["frame"]: r["v"] for r in relations.resample(mono, 100, 200).collect()}
    assert len(up) == 20 and up[0] == -45 and up[1] == -40 and up[19] == up[18]
    odd = spark.createDataFrame([(1, 0, 0, -3), (1, 0, 1, -4)], "audio_id int, frame long, ch int, v int")
    assert relations.to_mono(odd).first()["v"] == -3


def test_chains_stop(spark):
    fat = spark.createDataFrame([(1, 2, 5), (1, 5, 9), (1, 9, 268435455), (2, 3, 4), (2, 4, 3), (3, 2, 2)], "image_id int, cluster long, next long")
    start = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 7)], "image_id int, cluster long")
    rows = relations.chain(fat, start).orderBy("image_id", "depth").collect()
    assert [(r["image_id"], r["depth"], r["cluster"]) for r in rows] == [(1, 0, 2), (1, 1, 5), (1, 2, 9), (2, 0, 3), (2, 1, 4), (2, 2, 3), (3, 0, 2), (3, 1, 2), (4, 0, 7)]
    assert relations.chain(fat, start, most=2).groupBy("image_id").count().agg({"count": "max"}).first()[0] == 2


def test_a_chain_of_100000_clusters(spark):
    n = 100_000
    fat = spark.range(n).selectExpr("0 as image_id", "2 + id * 7919 % 100003 as cluster", f"if(id = {n - 1}, 268435455, 2 + (id + 1) * 7919 % 100003) as next")
    got = relations.chain(fat, spark.sql("select 0 as image_id, 2L as cluster"))
    r = got.selectExpr("count(*) n", "max(depth) d", "count_if(cluster <> 2 + depth * 7919L % 100003) wrong").first()
    assert tuple(r) == (n, n - 1, 0)


def test_a_deep_tree(spark):
    deep = spark.range(500).selectExpr("id", "if(id = 0, null, id - 1) as parent", "concat('d', id) as name", "id < 499 as is_dir")
    odd = spark.createDataFrame([(1000, 1001, "a", True), (1001, 1000, "b", True), (1002, 1000, "c", False), (1003, 99999, "d", False)], "id long, parent long, name string, is_dir boolean")
    got = {r["id"]: r["path"] for r in relations.tree_paths(deep.unionByName(odd)).collect()}
    assert got == {i: "/".join(f"d{k}" for k in range(i + 1)) + "/" * (i < 499) for i in range(500)}


def test_bicubic_moves_each_pixel_once(spark):
    """Equal to the array form over several bands, twice the size and half of it; sums stay where the pixels were dealt to."""
    import numpy as np

    from bytefold.functions import codecs
    from bytefold.operators import pixels

    image = np.random.default_rng(1).integers(0, 256, (40, 9, 3), np.uint8)
    df = spark.createDataFrame([(1, y, x, c, int(image[y, x, c])) for y in range(40) for x in range(9) for c in range(3)], "image_id int, y int, x int, c int, v int")
    for w, h in ((18, 80), (4, 20), (9, 40)):
        out = pixels.bicubic(df, 9, 40, w, h)
        got, want = {(r["y"], r["x"], r["c"]): r["v"] for r in out.collect()}, codecs.image_transform(image, width=w, height=h, method="bicubic", keep_aspect=False)
        assert want.shape[:2] == (h, w) and len(got) == w * h * 3
        assert max(abs(v - int(want[k])) for k, v in got.items()) <= 1
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(image_id") == 1


def test_bicubic_without_the_only_pixel_that_counts(spark):
    """A target whose neighbours with weight are all missing has no row; the others stay, doubled and null pixels as any."""
    from bytefold.operators import pixels

    rows = [(1, 0, 1, 0, 10), (1, 1, 0, 0, 20), (1, 1, 1, 0, 30), (2, 0, 0, 0, 7), (2, 0, 0, 0, 9), (2, 0, 1, 0, None), (2, 1, 0, 0, 8), (2, 1, 1, 0, 8)]
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in pixels.bicubic(spark.createDataFrame(rows, "image_id int, y int, x int, c int, v int"), 2, 2, 2, 2).collect()}
    assert set(got) == {(i, y, x) for i in (1, 2) for y in (0, 1) for x in (0, 1)} - {(1, 0, 0)} and got[2, 0, 0] == 8
