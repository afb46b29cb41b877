import random

import numpy as np

from bytefold.llm import neardup


def jaccard(a, b):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    rows, group, n = [], {}, 0
    for g in range(40):
        base = [word() for _ in range(r.randrange(80, 400))]
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, len(w) // 100 + 1)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            group[n] = g
            n += 1
    return rows, group


def test_one_of_each_group_stays(spark):
    rows, group = corpus()
    rows += [(900, "short text"), (901, "Short  text"), (902, None), (903, ""), (904, "another short"), (905, "z " * 40_000), (906, rows[0][1] + " " + " ".join("q%d" % i for i in range(500)))]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, node int, row string").repartition(4)
    got = neardup.distinct(df)
    assert got.columns == df.columns
    ids = sorted(r["doc_id"] for r in got.collect())
    assert len(ids) == len(set(ids))
    assert {900, 902, 904, 905, 906} <= set(ids) and not {901, 903} & set(ids)
    kept = {}
    for i in ids:
        if i in group:
            kept.setdefault(group[i], []).append(i)
    assert set(kept) == set(group.values())
    # whatever stays twice in a group is below the similarity
    text = dict(rows)
    for g in kept.values():
        assert all(jaccard(text[a], text[b]) < 0.8 for a in g for b in g if a < b)
    # whatever went was like something
    for i in set(group) - set(ids):
        assert any(jaccard(text[i], text[j]) >= 0.8 for j in group if j != i)


def test_crowded_bucket_and_repeated_rows(spark):
    r = random.Random(2)
    base = ["w%d" % r.randrange(9000) for _ in range(300)]
    rows = [(i, " ".join([*base[: 150 + i % 2], "v%d" % i, *base[150 + i % 2 :]])) for i in range(60)]
    rows += [(100, "own text that nobody else has here"), (100, "own text that nobody else has here"), (None, "lost id of this very text"), (None, "lost id of this very text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in neardup.distinct(df).collect())
    assert got == [(False, 0), (False, 100), (True, None)]
    assert neardup.distinct(df.limit(0)).collect() == []


def nodes_of(spark, rows):
    """Tables for links() from (node, fp, bands, changed minima, shingles)."""
    nodes, sets = [], []
    for node, fp, bands, changed, shingles in rows:
        m = np.zeros(neardup.BANDS * neardup.BAND, "<u4")
        m[changed] = 1
        nodes.append((node, fp, [bands, *range(node * 100, node * 100 + neardup.BANDS - 1)], bytearray(m.tobytes()), len(shingles)))
        sets.append((node, bytearray(np.array(shingles, "<u4").tobytes())))
    return spark.createDataFrame(nodes, "node long, fp long, bands array<long>, minima binary, n long"), spark.createDataFrame(sets, "node long, set binary")


NEAR, NEARER, OTHER = list(range(100)), list(range(99)), list(range(200, 300))


def linked(spark, rows):
    return {(r["a"], r["b"]) for r in neardup.links(*nodes_of(spark, rows)).collect()}


def test_a_partner_that_fails_hides_no_other(spark):
    rows = [(1, 0, 7, [], OTHER), (2, 2**32 - 1, 7, slice(0, 8), NEAR), (3, 2**62 - 2**31, 7, slice(72, 80), NEARER)]
    assert linked(spark, rows) == {(2, 3)}


def test_a_failed_forest_link_hides_no_other(spark):
    rows = [(1, 0, 17, [], OTHER), (2, 1, 27, [], NEAR), (3, 3, 37, [], NEARER)]
    # equal fingerprints with a hub that is like none of them
    rows += [(11, 2**40 - 1, 47, [], list(range(300, 400))), (12, 2**40 - 1, 57, [], list(range(500, 600))), (13, 2**40 - 1, 67, [], list(range(500, 599)))]
    assert linked(spark, rows) == {(2, 3), (12, 13)}


def test_a_bucket_of_several_blocks_forgets_nobody(spark):
    r = np.random.default_rng(5)
    fp = r.integers(0, 2**62, neardup.BLOCK + 20).tolist()
    rows = [(i, fp[i], 7, [], OTHER) for i in range(1, neardup.BLOCK + 10)]
    rows[1500] = (1501, fp[1501], 7, slice(0, 20), NEAR)
    rows.append((neardup.BLOCK + 15, fp[-1], 7, slice(0, 20), NEARER))
    assert (1501, neardup.BLOCK + 15) in linked(spark, rows)


def test_dense_families_in_parts_leave_no_pair(spark, monkeypatch):
    """12 families of 60 texts of 120 words with up to three words replaced; buckets are dealt in parts of 25."""
    monkeypatch.setattr(neardup, "BLOCK", 25)
    r = random.Random(7)
    rows = []
    for f in range(12):
        base = [f"f{f}w{r.randrange(4000)}" for _ in range(120)]
        for _ in range(60):
            w = list(base)
            for k in r.sample(range(120), r.randrange(4)):
                w[k] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    kept = [(x["doc_id"], x["text"]) for x in neardup.distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert not [(a, b) for i, (a, s) in enumerate(kept) for b, t in kept[:i] if a // 60 == b // 60 and jaccard(s, t) >= 0.8]
    # as many stay as there are classes of the links at 0.8
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, s in rows:
        for b, t in rows[a // 60 * 60 : a]:
            if jaccard(s, t) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(x for x, _ in kept) == sorted({find(x) for x in root})
