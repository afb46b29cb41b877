import numpy as np
from pyspark.sql import functions as F

from bytefold.llm import ann


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            s = sorted(((-float(np.dot(v, c)), i) for i, c in good.items() if i != q))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def close(a, b):
    return len(a) == len(b) and all(abs(x[1] - y[1]) < 1e-6 for x, y in zip(a, b))


def test_few_rows_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # ties beyond k
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [float("nan")] * 6), (2060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2080, []), (2100, [float("inf")] * 6), (2120, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1])]
    want = brute([x for x in rows if x[0] != 2120])
    got = run(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert close(got[q], want[q])
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] or len({round(s, 9) for _, s in want[q]}) == len(want[q])


def test_fewer_candidates_than_k(spark):
    got = run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.2])])
    assert got == {0: [(1, 0.5), (2, -1.0)]}
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}


def test_recall_on_structureless_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    want, got = brute(rows), run(spark, rows)
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert got.keys() == want.keys() and hit >= 0.9


def test_scan_keeps_what_reaches_the_bound():
    r = np.random.default_rng(3)
    c, q = r.normal(size=(3000, 48)), r.normal(size=(50, 48))
    space = ann.Space(48, np.linalg.norm(c, axis=1).max())
    score = q @ c.T
    bound = -np.sort(-score, axis=1)[:, 20]
    qi, ci = ann.scan(space, c, q, bound)
    kept = set(zip(qi.tolist(), ci.tolist()))
    want = set(zip(*(z.tolist() for z in np.nonzero(score >= bound[:, None]))))
    assert len(kept & want) >= 0.97 * len(want)
    assert len(kept) < 0.05 * score.size
