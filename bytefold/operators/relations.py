"""Audio samples, mesh triangles, layouts, blocks, chains and trees as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytefold.sources import workspace

# Audio: (audio_id, frame, ch, v)


def duration(frames: Column, rate: Column) -> Column:
    return F.when(rate > 0, frames / rate).otherwise(F.lit(0.0))


def resample(df: DataFrame, rate: int, new_rate: int) -> DataFrame:
    """Linear interpolation; the frame after the last is the last of the same channel."""
    ratio = new_rate / rate
    ends = df.groupBy("audio_id", "ch").agg(F.max("frame").alias("last"))
    out = ends.select("audio_id", "ch", "last", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") + 1) * F.lit(ratio)).cast("long") - 1)).alias("frame"))
    out = out.withColumn("pos", F.col("frame") / F.lit(ratio)).withColumn("a", F.floor("pos")).withColumn("b", F.least(F.col("a") + 1, "last"))
    first = df.select("audio_id", "ch", F.col("frame").alias("a"), F.col("v").alias("va"))
    second = df.select("audio_id", "ch", F.col("frame").alias("b"), F.col("v").alias("vb"))
    both = out.join(first, ["audio_id", "ch", "a"]).join(second, ["audio_id", "ch", "b"])
    return both.select("audio_id", "frame", "ch", F.expr("cast(va + (vb - va) * (pos - a) as int)").alias("v"))


def to_stereo(df: DataFrame) -> DataFrame:
    return df.select("audio_id", "frame", F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"), "v")


def to_mono(df: DataFrame) -> DataFrame:
    """Half the sum of both channels, cut toward zero."""
    return df.groupBy("audio_id", "frame").agg(F.expr("cast(sum(v) div 2 as int)").alias("v")).select("audio_id", "frame", F.lit(0).alias("ch"), "v")


# Meshes


def face_normal(a: str, b: str, c: str) -> Column:
    """struct<x, y, z> of three vertex structs; shorter than 1e-6: zero."""
    u, v = [[f"({p}.{k} - {a}.{k})" for k in "xyz"] for p in (b, c)]
    n = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    size = f"sqrt({' + '.join(f'{x} * {x}' for x in n)})"
    return F.expr("struct(" + ", ".join(f"if({size} < 1e-6D, 0D, {x} / {size}) as {k}" for x, k in zip(n, "xyz", strict=True)) + ")")


def fan(df: DataFrame, face: str, corners: str) -> DataFrame:
    """(face, tri, a, b, c): corners (an array) as triangles around the first."""
    some = df.where(F.size(corners) >= 3)
    out = some.select(face, F.col(corners).alias("x"), F.explode(F.sequence(F.lit(1), F.size(corners) - 2)).alias("tri"))
    return out.selectExpr(face, "tri", "x[0] as a", "x[tri] as b", "x[tri + 1] as c")


def obj_faces(df: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, no, x, y, z) and face corners (key, face, corner, no) of OBJ texts; negative indices count back, others out of range are dropped."""
    lines = df.select(key, F.posexplode(F.split(F.col(content), "\r?\n")).alias("line", "l")).withColumn("w", F.split(F.trim("l"), r"\s+"))
    order = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("seen", F.count(F.when(F.col("w")[0] == "v", 1)).over(order)).where(F.col("w")[0].isin("v", "f"))
    points = lines.where("w[0] = 'v' and size(w) >= 4").select(key, F.col("seen").alias("no"), *[F.col("w")[i].cast("float").alias(k) for i, k in enumerate("xyz", 1)])
    faces = lines.where("w[0] = 'f'").select(key, F.col("line").alias("face"), "seen", F.posexplode("w").alias("corner", "t")).where("corner > 0")
    index = F.substring_index("t", "/", 1).try_cast("int")
    at = F.when(index < 0, F.col("seen") + 1 + index).otherwise(index)
    return points, faces.select(key, "face", "corner", at.alias("no")).where("no >= 1")


def distinct_vertices(df: DataFrame, key: str, cell: float = 1e-5) -> DataFrame:
    """df (key, x, y, z) with `vertex`: equal within a rounded cell, numbered from 1."""
    at = [F.round(F.col(k) / cell).cast("long") for k in "xyz"]
    return df.withColumn("vertex", F.dense_rank().over(Window.partitionBy(key).orderBy(*at)))


# Layouts


def starts(size: Column, by: list[str], order: list[str], base: int = 0) -> Column:
    """Running offset of extents: base plus all sizes before."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.lit(base) + F.coalesce(F.sum(size).over(line), F.lit(0))


def track_sizes(df: DataFrame, key: str, track: str, offset: str, total: str) -> DataFrame:
    """df with `size`: up to the next track's offset, or the end."""
    line = Window.partitionBy(key).orderBy(track)
    return df.withColumn("size", F.coalesce(F.lead(offset).over(line), F.col(total)) - F.col(offset))


def sparse_blocks(df: DataFrame, key: str, block: str, zero: Column) -> DataFrame:
    """(key, block, slot): blocks that are not all zero, in order."""
    kept = df.where(~zero)
    return kept.select(key, block, (F.row_number().over(Window.partitionBy(key).orderBy(block)) - 1).alias("slot"))


def stored(raw: Column, packed: Column) -> Column:
    """The smaller of a block's raw and packed lengths."""
    return F.when(packed < raw, packed).otherwise(raw)


# Chains and trees, by pointer doubling: rounds grow as the log of the depth, each round's pointers are a written table


def chain(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id, depth, cluster) of each start's chain. edges: (image_id, cluster, next), starts: (image_id, cluster).

    A chain ends at 0, 1 and at marks from 0x0FFFFFF7. One that runs into a cycle ends when it is
    longer than its image has links, and any ends after `most` clusters if that is given.
    """
    links = edges.where("next between 2 and 268435446").select("image_id", "cluster", F.col("next").alias("to"))
    longest = F.coalesce("links", F.lit(0)) + 1
    longest = F.least(longest, F.lit(most)) if most else longest
    found = starts.join(links.groupBy("image_id").agg(F.count("*").alias("links")), "image_id", "left")
    parts = [workspace.keep(found.select("image_id", "cluster", F.lit(0).alias("depth"), longest.alias("longest")), "chain")]
    jump, step = workspace.keep(links, "jump"), 1
    while True:
        # parts hold depths below step; jump leads step clusters on
        near = reduce(DataFrame.unionByName, parts).where(F.col("depth") + step < F.col("longest"))
        more = near.join(jump, ["image_id", "cluster"]).select("image_id", F.col("to").alias("cluster"), (F.col("depth") + step).alias("depth"), "longest")
        parts.append(workspace.keep(more, "chain"))
        if not parts[-1].limit(1).count():
            break
        further = jump.withColumnRenamed("to", "via").join(jump.withColumnRenamed("cluster", "via"), ["image_id", "via"])
        was, jump = jump, workspace.keep(further.select("image_id", "cluster", "to"), "jump")
        workspace.drop(was)
        step *= 2
    workspace.drop(jump)
    return reduce(DataFrame.unionByName, parts).select("image_id", "depth", "cluster")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path) over (id, parent, name, is_dir); directories end with a slash. Nodes in or below a cycle, or below a missing parent, have no path."""
    up = workspace.keep(nodes.select("id", F.col("parent").alias("up")), "up")
    rounds, most = 0, up.count().bit_length() + 1
    while rounds < most and up.where("up is not null").limit(1).count():
        ahead = up.where("up is not null").join(up.toDF("up", "far"), "up").select("id", F.col("far").alias("up"))
        was, up = up, workspace.keep(up.where("up is null").unionByName(ahead), "up")
        workspace.drop(was)
        rounds += 1
    name = F.concat("name", F.when(F.col("is_dir"), "/").otherwise(""))
    line = nodes.join(up.where("up is null"), "id", "left_semi").select("id", F.col("parent").alias("up"), name.alias("path"))
    for _ in range(rounds):
        line = workspace.keep(line, "line")
        ahead = line.where("up is not null").join(line.toDF("up", "far", "front"), "up").select("id", F.col("far").alias("up"), F.concat("front", "path").alias("path"))
        line = line.where("up is null").unionByName(ahead)
    workspace.drop(up) if rounds else None
    return line.select("id", "path")


def indirect(block: str, per: int, direct: int = 12) -> Column:
    """The level (0 direct to 3 triple) that maps a file block."""
    one, two = direct + per, direct + per + per * per
    return F.expr(f"case when {block} < {direct} then 0 when {block} < {one} then 1 when {block} < {two} then 2 else 3 end")
