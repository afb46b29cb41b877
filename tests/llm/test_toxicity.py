import random

import numpy as np
from pyspark.sql import functions as F

from bytefold.llm import toxicity


def corpus(n=900, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["w%03d" % r.randrange(400) for _ in range(r.randrange(5, 60))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(["vile", "Nasty,", "qwertz" + r.choice("abcdef")])
        rows.append((i, " ".join(w), "xx"))
        if r.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i for i, t, _ in rows if any(x in t.lower() for x in ("vile", "nasty", "qwertz"))}


def test_held_out_rows(spark):
    rows, labels, bad = corpus()
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "w001 " * 30_000, "c"), (None, "vile", "d"), (3, rows[3][1], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (4, None, None)], "doc_id long, quality int, toxic int")
    learn = F.col("id") % 3 != 1
    model = toxicity.train(docs, marks, learn)
    got = [(r["doc_id"], r["score"]) for r in toxicity.scores(docs, model).collect()]
    assert len(got) == len(rows)
    assert all(0 <= s <= 1 for _, s in got)
    test = [(d in bad, s >= 0.7) for d, s in got if d is not None and d < 5000 and d % 3 == 1]
    hit = sum(y and p for y, p in test)
    assert hit >= 0.95 * sum(y for y, _ in test)
    assert sum(p and not y for y, p in test) <= 2
    by = dict(got)
    assert by[5000] == by[5001] < 0.7 and by[5002] < 0.7 <= by[None]


def test_without_confirmed_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.lit(True))
    assert {r["score"] < 0.7 for r in toxicity.scores(docs, model).collect()} == {True}
    assert toxicity.scores(docs.limit(0), model).collect() == []


def test_risk_that_falls_below_zero_is_turned_round():
    r = np.random.default_rng(1)
    n = 400
    positive = np.arange(n) < 100
    truth = positive | (r.random(n) < 0.3)
    x = (r.random((n, 3)) < np.where(truth[:, None], 0.8, 0.1)).astype(int)
    rows, cols = np.nonzero(x)
    w, b = toxicity.fit_nnpu(rows, cols, positive, 0.3, 3)
    assert (w > 0).all() and b < 0 and np.isfinite(w).all()
