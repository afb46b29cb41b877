import random
import zlib
from collections import Counter

import numpy as np

from bytefold.llm import sharding


def check(rows, got, shards):
    assert Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(shards))
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in by.values():
        assert sorted(s) == list(range(len(s)))


def cut_share(got):
    groups = {}
    for r in got:
        groups.setdefault(r["text_crc32"], []).append(r["shard"])
    split = sum(len(set(g)) > 1 for g in groups.values() if len(g) > 1)
    return split / max(1, sum(len(g) > 1 for g in groups.values()))


def test_groups_stay_together(spark):
    r = random.Random(1)
    rows = [(i, f"text {r.randrange(500)}" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, shard int, row int")
    got = sharding.assign(df, 7).collect()
    check(rows, got, 7)
    assert cut_share(got) < 0.05


def test_hot_group_nulls_and_copies(spark):
    rows = [(i, "the same text") for i in range(400)] + [(500 + i, f"é {i}") for i in range(300)] + [(900, None), (901, ""), (None, "x"), (5, "the same text"), (902, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, 24).collect()
    check(rows, got, 24)
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"the same text"))
    assert len(hot) <= 20


def test_only_copies_and_empty(spark):
    rows = [(i, "a") for i in range(50)]
    check(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect(), 24)
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a"), (2, "b")]
    check(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 24)


def test_quotas_keep_rooms():
    r = np.random.default_rng(1)
    for _ in range(200):
        held = r.integers(0, 50, 6)
        room = np.maximum(r.integers(0, 60, 6), held)
        wish = r.integers(0, 20, (6, 6))
        wish = np.minimum(wish, np.maximum(held // 5, 0)[:, None])
        g = sharding.quotas(wish, held, room)
        np.fill_diagonal(wish, 0)
        assert (g >= 0).all() and (g <= wish).all()
        assert (held + g.sum(0) - g.sum(1) <= room).all()
