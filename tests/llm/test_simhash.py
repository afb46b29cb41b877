import random
import re

import xxhash
from pyspark.sql import functions as F

from bytefold.llm import simhash


def brute(rows, width=4, distance=4):
    fps = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps.append(sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (fps[i], low[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1, n=150):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha Beta gamma DELTA été ßx omega pi rho".split()) + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 300))) for _ in range(40)]
    rows = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = "new%d" % rnd.randrange(5)
        rows.append((i * 3, rnd.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "one"), (10_005, "one"), (10_006, "x " * 20_000)]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(df, **more).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_crowded_cells_take_the_exact_second_path(spark):
    check(spark, corpus(2, 60), cell_rows=3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_cells_miss_no_pair():
    rnd = random.Random(5)
    low = 0x5555555555555555
    for blocks in (6, 7, 8):
        masks = [m % (1 << 64) for m in simhash.cell_masks(4, blocks)]
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for _ in range(4):
                b ^= 1 << rnd.randrange(64)
            v = [(x & low) + (x >> 1 & low) for x in (a, b)]
            assert any(v[0] & m == v[1] & m for m in masks)
