"""Shards of equal row counts that cut few links: balanced label propagation.

Documents of equal text are linked. As members of such a group are interchangeable, the
propagation runs on the table of (group, shard, count): each round, what a group has in
a shard wants to move to the shard where most of the group is, among those with room.
Wishes between two shards are granted up to quotas that keep every shard within its
capacity; the quotas come from a shards x shards matrix, which is all that a round
collects. Documents without a link then fill every shard to its exact count, so counts
are at most one apart.

A group of any size is a handful of counts, so a text that a third of the rows share
costs what any other does; it fills whole shards one after another. Ranks are dealt in
salted groups, and nothing else is ordered.

Nulls: a null text has size 8 and the checksum of no bytes, and null texts are equal to
each other and to empty ones; a null id keeps its row. Repeated rows are linked and
placed each. Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytefold.llm import workspace

SHARDS = 24
ROUNDS = 12
GROUP_ROWS = 256
SALTS = 16


def quotas(wish: np.ndarray, held: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest moves found (shard to shard) within the wishes that leave no shard above its room."""
    grant = wish.astype(np.int64).copy()
    np.fill_diagonal(grant, 0)
    while True:
        over = held + grant.sum(0) - grant.sum(1) - room
        over = np.minimum(np.where(grant.sum(0) > 0, over, 0), grant.sum(0))
        if (over <= 0).all():
            return grant
        t = int(over.argmax())
        left = grant[:, t].sum() - over[t]
        cut = np.floor(grant[:, t] * (left / grant[:, t].sum())).astype(np.int64)
        for s in np.argsort(-(grant[:, t] - cut), kind="stable")[: int(left - cut.sum())]:
            cut[s] += 1
        grant[:, t] = np.minimum(cut, grant[:, t])


def _shares(total: int, parts: list[int]) -> list[int]:
    """total, at most sum(parts), dealt over parts in proportion and within each."""
    whole = sum(parts)
    out = [total * p // whole for p in parts]
    left = total - sum(out)
    for i, p in enumerate(parts):
        more = min(left, p - out[i])
        out[i], left = out[i] + more, left - more
    return out


def propagate(cells: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """cells (k1, k2, shard, n: a written table) after the rounds; room: what each shard can hold."""
    spark, shards = cells.sparkSession, len(room)
    rooms = np.array(room)
    for _ in range(rounds):
        held = np.zeros(shards, np.int64)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            held[r["shard"]] = r["n"]
        free = [int(i) for i in np.flatnonzero(held < rooms)]
        # each group's shards, fullest first; a group larger than a shard settles in as many as it needs
        best = cells.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "shard"))).alias("line"), F.sum("n").alias("all"))
        best = best.withColumn("tops", F.slice("line", F.lit(1), F.ceil(F.col("all") / max(1, int(rooms.min()))).cast("int")))
        wide = cells.join(best, ["k1", "k2"]).withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int"))
        is_open = f"array_contains(array({', '.join(map(str, free))}), x.shard)" if free else "false"
        wide = wide.withColumn("home", F.expr("exists(tops, x -> x.shard = shard)")).withColumn("aims", F.expr(f"filter(tops, x -> {is_open})")).withColumn("more", F.expr(f"filter(line, x -> {is_open} and struct(x.m, x.shard) < struct(-n, shard))"))
        # else an open shard that has more of the group; else a swap into a full one, if others wish the other way round
        aim = F.expr("case when home then null when size(aims) > 0 then aims[pmod(hash(shard), size(aims))] when size(more) > 0 then more[0] else tops[0] end")
        wide = wide.withColumn("aim", aim)
        wishes = workspace.keep(wide.select("k1", "k2", "shard", "n", F.col("aim.shard").alias("to"), "salt", (-F.col("aim.m") - F.col("n")).alias("gain")), "wishes")
        asked: dict = {}
        for r in wishes.where("to is not null").groupBy("shard", "to", "salt").agg(F.sum("n").alias("n")).collect():  # shards^2 * SALTS rows at most
            asked.setdefault((r["shard"], r["to"]), {})[r["salt"]] = r["n"]
        wish = np.zeros((shards, shards), np.int64)
        for (s, t), by in asked.items():
            wish[s, t] = sum(by.values())
        grant = quotas(wish, held, np.maximum(rooms, held))
        if not grant.sum():
            workspace.drop(wishes)
            break
        rows = [(s, t, salt, q) for (s, t), by in asked.items() for salt, q in zip(by, _shares(int(grant[s, t]), list(by.values())), strict=True)]
        table = F.broadcast(spark.createDataFrame(rows, "shard int, to int, salt int, quota long"))
        line = Window.partitionBy("shard", "to", "salt").orderBy(F.desc("gain"), "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
        moved = wishes.where("to is not null").withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).join(table, ["shard", "to", "salt"])
        moved = moved.withColumn("go", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))))
        still = wishes.where("to is null").select("k1", "k2", "shard", "n")
        parts = still.unionByName(moved.select("k1", "k2", "shard", (F.col("n") - F.col("go")).alias("n"))).unionByName(moved.select("k1", "k2", F.col("to").alias("shard"), F.col("go").alias("n")))
        after = workspace.keep(parts.where("n > 0").groupBy("k1", "k2", "shard").agg(F.sum("n").alias("n")), "cells")
        workspace.drop(cells, wishes)
        cells = after
    return cells


def _bucket(n: int) -> Column:
    # another hash than the salts of a group's ranks, whose members would else crowd into a few buckets
    return F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n)).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document; counts of the shards differ by one at most."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    rows = workspace.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    buckets = max(64, total // 20_000)
    room = [total // shards + (i < total % shards) for i in range(shards)]

    first = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards)).cast("int").alias("shard")
    counts = rows.groupBy("k1", "k2", first).agg(F.count("*").alias("n"))
    groups = workspace.keep(counts.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1"), "groups")
    cells = workspace.keep(counts.join(groups.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "shard", "n"), "cells")
    tied = workspace.keep(rows.select("row", "k1", "k2").join(workspace.within(groups), ["k1", "k2"]), "tied")
    # a random start may overfill a shard by a few; the surplus moves to shards with room
    held = np.zeros(shards, np.int64)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        held[r["shard"]] = r["n"]
    if (held > np.array(room)).any():
        cells = _level(cells, held, room)
    cells = propagate(cells, room, rounds)

    # a group's members by rank: its counts are intervals of ranks
    ends = F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("shard"))
    lines = cells.withColumn("end", ends).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    lines = workspace.within(workspace.keep(lines, "lines"))
    salted = tied.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("all") / GROUP_ROWS).cast("long")))
    sums = salted.groupBy("k1", "k2", "salt").count()
    before = sums.withColumn("before", F.sum("count").over(Window.partitionBy("k1", "k2").orderBy("salt")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("k1", "k2", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("in", rank).join(before, ["k1", "k2", "salt"]).select("row", "k1", "k2", (F.col("in") + F.col("before")).alias("rank"))
    linked = ranked.join(lines, ["k1", "k2"]).select("row", F.expr("filter(ends, e -> e.end > rank)[0].shard").alias("shard"))

    alone = rows.select("row", "k1", "k2").join(groups.select("k1", "k2"), ["k1", "k2"], "left_anti").select("row")
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    need = np.array([room[i] - held.get(i, 0) for i in range(shards)])
    edges = np.cumsum(need)
    alone = _numbered(alone.withColumn("bucket", _bucket(buckets)), [], "at")
    pick = F.lit(shards - 1)
    for i in range(shards - 2, -1, -1):
        pick = F.when(F.col("at") < int(edges[i]), i).otherwise(pick)
    placed = linked.unionByName(alone.select("row", pick.alias("shard")))
    out = rows.drop("k1", "k2").join(placed, "row").withColumn("bucket", _bucket(buckets))
    out = _numbered(workspace.keep(out, "placed"), ["shard"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within `by`, in order of bucket and row, without one task that sees all rows of a group."""
    sums = df.groupBy(*by, "bucket").count()
    # one row for each bucket of a group
    ahead = sums.withColumn("ahead", F.sum("count").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("row")) - 1
    return df.withColumn("inside", inside).join(ahead, [*by, "bucket"]).withColumn(name, F.col("inside") + F.col("ahead")).drop("inside", "ahead")


def _level(cells: DataFrame, held: np.ndarray, room: list[int]) -> DataFrame:
    """Moves what is above a shard's room to shards below theirs, in order of hash."""
    spark = cells.sparkSession
    over = np.maximum(held - np.array(room), 0)
    gaps = np.maximum(np.array(room) - held, 0)
    flows, t = [], 0
    for s in np.flatnonzero(over):
        at, want = 0, int(over[s])
        while want:
            if not gaps[t]:
                t += 1
                continue
            n = min(want, int(gaps[t]))
            flows.append((int(s), t, at, at + n))
            at, want, gaps[t] = at + n, want - n, gaps[t] - n
    table = F.broadcast(spark.createDataFrame(flows, "shard int, to int, lo long, hi long"))
    line = Window.partitionBy("shard").orderBy(F.xxhash64("k1", "k2"), "k1", "k2")
    spot = cells.withColumn("end", F.sum("n").over(line)).withColumn("begin", F.col("end") - F.col("n"))
    gone = spot.join(table, "shard").withColumn("go", F.least("end", "hi") - F.greatest("begin", "lo")).where("go > 0")
    left = cells.unionByName(gone.select("k1", "k2", "shard", (-F.col("go")).alias("n"))).unionByName(gone.select("k1", "k2", F.col("to").alias("shard"), F.col("go").alias("n")))
    return workspace.keep(left.groupBy("k1", "k2", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
