"""Image transforms over the pixel relation (image_id, y, x, c, v).

Every transform is a projection of coordinates or an equi-join of the target grid with
the source pixels, keyed by image, so images spread over the cluster. Arithmetic that
truncates is kept in 32-bit floats step by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def f32(x: str) -> str:
    return f"cast({x} as float)"


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def fit_box(w: str, h: str, nw: str, nh: str) -> Column:
    """struct<w, h>: the target box with the source's aspect kept, 1 at least."""
    aspect, target = f32(f"{f32(w)} / {f32(h)}"), f32(f"{f32(nw)} / {f32(nh)}")
    wide = f"greatest(1, cast({f32(f'{f32(nh)} * {aspect}')} as int))"
    tall = f"greatest(1, cast({f32(f'{f32(nw)} / {aspect}')} as int))"
    return F.expr(f"if({target} > {aspect}, struct({wide} as w, cast({nh} as int) as h), struct(cast({nw} as int) as w, {tall} as h))")


def flip(df: DataFrame, width: str | None = None, height: str | None = None) -> DataFrame:
    """Horizontally if a width is given, vertically if a height is."""
    if width:
        df = df.withColumn("x", F.expr(f"{width} - 1 - x"))
    return df.withColumn("y", F.expr(f"{height} - 1 - y")) if height else df


def rotate(df: DataFrame, degrees: int, width: str, height: str) -> DataFrame:
    """Clockwise by a multiple of 90."""
    turn = degrees % 360
    if turn not in (0, 90, 180, 270):
        raise ValueError("rotation must be a multiple of 90 degrees")
    at = {0: ("x", "y"), 90: (f"{height} - 1 - y", "x"), 180: (f"{width} - 1 - x", f"{height} - 1 - y"), 270: ("y", f"{width} - 1 - x")}[turn]
    return df.withColumns({"x": F.expr(at[0]), "y": F.expr(at[1])})


def _grid(df: DataFrame, nw: int, nh: int) -> DataFrame:
    ids = df.select("image_id", "c").distinct()
    return ids.select("image_id", "c", F.explode(F.sequence(F.lit(0), F.lit(nh - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(nw - 1))).alias("x"))


def nearest(df: DataFrame, w: int, h: int, nw: int, nh: int) -> DataFrame:
    sx = f"least(cast({f32(f'{f32('x')} * {f32(f'{f32(str(w))} / {f32(str(nw))}')}')} as int), {w - 1})"
    sy = f"least(cast({f32(f'{f32('y')} * {f32(f'{f32(str(h))} / {f32(str(nh))}')}')} as int), {h - 1})"
    grid = _grid(df, nw, nh).selectExpr("image_id", "c", "y", "x", f"{sy} as sy", f"{sx} as sx")
    return grid.join(df.selectExpr("image_id", "c", "y as sy", "x as sx", "v"), ["image_id", "c", "sy", "sx"]).select("image_id", "y", "x", "c", "v")


def _source(df: DataFrame, w: int, h: int, nw: int, nh: int) -> DataFrame:
    fx = f32(f"{f32('x')} * {f32(f'{f32(str(w - 1))} / {f32(str(nw))}')}")
    fy = f32(f"{f32('y')} * {f32(f'{f32(str(h - 1))} / {f32(str(nh))}')}")
    return _grid(df, nw, nh).selectExpr("image_id", "c", "y", "x", f"{fx} as fx", f"{fy} as fy").selectExpr("*", "cast(fx as int) as x0", "cast(fy as int) as y0")


def bilinear(df: DataFrame, w: int, h: int, nw: int, nh: int) -> DataFrame:
    """Each target pixel meets its four neighbours in one join."""
    near = _source(df, w, h, nw, nh).selectExpr("*", "explode(array(struct(0 as i, 0 as j), struct(1 as i, 0 as j), struct(0 as i, 1 as j), struct(1 as i, 1 as j))) as o")
    near = near.selectExpr("image_id", "c", "y", "x", "fx", "fy", "x0", "y0", "o.i as i", "o.j as j", f"least(x0 + o.i, {w - 1}) as sx", f"least(y0 + o.j, {h - 1}) as sy")
    met = near.join(df.selectExpr("image_id", "c", "y as sy", "x as sx", "v"), ["image_id", "c", "sy", "sx"])
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).cast("float").alias(f"p{i}{j}")
    four = met.groupBy("image_id", "y", "x", "c", "fx", "fy", "x0", "y0").agg(*[at(i, j) for i in (0, 1) for j in (0, 1)])
    mixed = lambda a, b, t: f32(f"{a} + {f32(f'{f32(f"{b} - {a}")} * {t}')}")
    tx, ty = f32(f"fx - {f32('x0')}"), f32(f"fy - {f32('y0')}")
    top, low = mixed("p00", "p10", tx), mixed("p01", "p11", tx)
    return four.selectExpr("image_id", "y", "x", "c", f"greatest(0, least(255, cast({mixed(top, low, ty)} as int))) as v")


def _kernel(t: str) -> str:
    t = f"abs({t})"
    return f"case when {t} <= 1 then 1.5D * {t} * {t} * {t} - 2.5D * {t} * {t} + 1 when {t} < 2 then -0.5D * {t} * {t} * {t} + 2.5D * {t} * {t} - 4 * {t} + 2 else 0D end"


#: Target rows that are summed together; a source row goes to each band that it has weight in.
BAND = 16


def _taps(spark: SparkSession, size: int, new: int, at: str, source: str, weight: str) -> DataFrame:
    """(at, source, weight) along one side: where each target finds its four neighbours, clamped; those without weight are left out."""
    f = f32(f"{f32(at)} * {f32(f'{f32(str(size - 1))} / {f32(str(new))}')}")
    four = spark.range(0, new, 1, 1).selectExpr(f"cast(id as int) as {at}").selectExpr(at, f"{f} as f").selectExpr(at, "f", "cast(f as int) as f0", "explode(sequence(-1, 2)) as i")
    return four.selectExpr(at, f"greatest(0, least({size - 1}, f0 + i)) as {source}", f"{_kernel('cast(f - cast(f0 + i as float) as double)')} as {weight}").where(f"{weight} <> 0")


def bicubic(df: DataFrame, w: int, h: int, nw: int, nh: int) -> DataFrame:
    """Catmull-Rom over 4 x 4 neighbours with clamped edges; weights normalised; sums in doubles.

    Source pixels move once, to the bands of target rows that need them. Both sides' weights are
    broadcast, and each pixel is added to the targets where it lies, so the 16 terms of a target never move.
    """
    across, down = _taps(df.sparkSession, w, nw, "x", "sx", "kx"), _taps(df.sparkSession, h, nh, "y", "sy", "ky").withColumn("band", F.expr(f"y div {BAND}"))
    source = df.where("image_id is not null and c is not null").selectExpr("image_id", "c", "y as sy", "x as sx", "v")
    near = source.join(F.broadcast(down.select("band", "sy").distinct()), "sy").repartition("image_id", "c", "band")
    met = near.join(F.broadcast(across), "sx").join(F.broadcast(down), ["band", "sy"]).selectExpr("image_id", "c", "band", "y", "x", "v", "kx * ky as k")
    out = met.groupBy("image_id", "c", "band", "y", "x").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("s"))
    return out.selectExpr("image_id", "y", "x", "c", "greatest(0, least(255, cast(round(s, 6) as int))) as v")


def threshold_bits(df: DataFrame) -> DataFrame:
    """(image_id, y, byte_no, bits): black below 128, packed from the highest bit. df: image_id, y, x, gray."""
    bit = F.expr("if(gray < 128, shiftleft(1, 7 - x % 8), 0)")
    return df.withColumn("bit", bit).groupBy("image_id", "y", F.expr("x div 8").cast("int").alias("byte_no")).agg(F.bit_or("bit").alias("bits"))


def unfilter_up(df: DataFrame) -> DataFrame:
    line = Window.partitionBy("image_id", "x", "c").orderBy("y")
    return df.withColumn("v", (F.sum("v").over(line) % 256).cast("int"))


def unfilter_sub(df: DataFrame) -> DataFrame:
    line = Window.partitionBy("image_id", "y", "c").orderBy("x")
    return df.withColumn("v", (F.sum("v").over(line) % 256).cast("int"))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, first, n, value): gaps and islands within a key."""
    line = Window.partitionBy(key).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(line)) | (F.row_number().over(line) == 1)).cast("int")
    marked = df.select(key, order, value, new.alias("new")).withColumn("run", F.sum("new").over(line))
    return marked.groupBy(key, "run").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first(value).alias(value))


def convert(df: DataFrame, width: int, height: int, flip_h: bool = False, flip_v: bool = False, degrees: int = 0, new_width: int = 0, new_height: int = 0, method: str = "bilinear", keep_aspect: bool = True) -> tuple[DataFrame, int, int]:
    """Flips, then rotation, then resize; a missing side keeps the current one. The new frame's size comes along."""
    df = flip(df, str(width) if flip_h else None, str(height) if flip_v else None)
    df = rotate(df, degrees, str(width), str(height))
    if degrees % 180:
        width, height = height, width
    if new_width or new_height:
        nw, nh = new_width or width, new_height or height
        if keep_aspect:
            box = df.sparkSession.range(1).select(fit_box(str(width), str(height), str(nw), str(nh)).alias("b")).first()["b"]
            nw, nh = box["w"], box["h"]
        df = {"nearest": nearest, "bilinear": bilinear, "bicubic": bicubic}[method](df, width, height, nw, nh)
        width, height = nw, nh
    return df, width, height
