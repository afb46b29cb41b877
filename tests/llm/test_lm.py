import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytefold.llm import lm, textkit


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows, entries):
    """Base scores, and scores from exact dictionaries with the filter's levels."""
    train = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(w for x in train for w in x)
    n, v = sum(one.values()), len(one)
    least = max(1, -(-n // entries))
    pad = [["^", "^", *x] for x in train]
    two = Counter((x[i - 1], x[i]) for x in pad for i in range(2, len(x)))
    three = Counter((x[i - 2], x[i - 1], x[i]) for x in pad for i in range(3, len(x)))
    q = lambda c: 0 if c < least else 1 + math.floor(math.log(c / least) / math.log(lm.LEVEL) + 1e-9)
    low = lambda k: math.ceil(least * lm.LEVEL ** (k - 1) - 1e-6) if k else 0
    out = []
    for d, t in rows:
        x = ["^", "^", *tokens(t)]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in x[2:])
        total = 0.0
        for i in range(2, len(x)):
            c1 = one[None] if x[i - 1] == "^" else one[x[i - 1]] * (one[x[i - 1]] >= least)
            w2 = c1 / (c1 + lm.PRIOR)
            p = (1 - w2) * (one[x[i]] + 1) / (n + v + 1) + (w2 * min(1, low(q(two[x[i - 1], x[i]])) / c1) if c1 else 0)
            k = q(two[x[i - 2], x[i - 1]]) if i > 2 else 0
            high = least * lm.LEVEL**k if k else 0
            w3 = high / (high + lm.PRIOR)
            p = (1 - w3) * p + (w3 * min(1, low(q(three[x[i - 2], x[i - 1], x[i]])) / high) if high else 0)
            total += math.log10(p)
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(x) - 2, sum(one[w] > 0 for w in x[2:]), n, base, total))
    return out


def corpus(n=150):
    r = random.Random(4)
    words = ["the", "The", "of", "été", "river", "stone"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(int(r.expovariate(0.15)), len(words) - 1)] for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (None, "the river"), (3, rows[3][1]), (502, "unseen words only zq")] + [(503, "the stone " * 9000)]


@pytest.mark.parametrize("entries", [10**6, 300])
def test_against_dictionaries(spark, entries):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, row int").repartition(3)
    got = lm.score(df, ~lm.held_out("doc_id", 7, 2), entries=entries).collect()
    want = brute(rows, entries)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r["doc_id"], not r["training"], *r[2:]) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=0.01)  # the filter errs on one side for a few n-grams


def test_rare_pairs_count_in_a_large_corpus(spark):
    rows = [*corpus(30), *((i, "the stone " * 20_000) for i in range(600, 665)), (700, "the"), (701, "quick amber fox"), (705, "quick amber fox quick amber fox")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, ~lm.held_out("doc_id", 7, 2)).where("doc_id >= 700").collect()}
    want = {r[0]: r[6] for r in brute(rows, 10**12) if r[0] is not None and r[0] >= 700}
    assert got == {d: pytest.approx(s, rel=1e-9) for d, s in want.items()}


def test_filter_levels():
    r = np.random.default_rng(1)
    keys, counts = r.integers(0, 2**32, 20_000).astype(np.uint64), r.integers(5, 10_000, 20_000)
    f = lm.LogBloom(5).fill(keys, counts)
    level = f.level_of(keys)
    assert (level >= f.levels(counts)).all() and (level == f.levels(counts)).mean() > 0.99
    low, high = f.lower(f.levels(counts)), f.upper(f.levels(counts))
    assert (low <= counts).all() and (counts <= high + 1e-6).all()
    assert (f.level_of(r.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.005
    assert not lm.LogBloom(1).fill(keys[:0], counts[:0]).level_of(keys).any()


@pytest.mark.parametrize("wide", [64, 32])
def test_keys_travel_whole(wide):
    r = np.random.default_rng(2)
    raw = r.integers(0, 2**wide, 5000, dtype=np.uint64)[r.integers(0, 5000, 9000)]
    keys, inverse = lm._unique(raw, wide)
    assert (np.diff(keys.astype(object)) > 0).all() and (keys[inverse] == raw).all()
    counts = r.integers(0, 2**32, len(keys)).astype(np.uint64)
    a, n = lm._asked_for(lm._ask(keys, counts, wide == 32), len(keys), wide == 32)
    assert (a == keys).all() and (n == counts).all()


def test_a_text_scores_alike_beside_a_corpus_twenty_times_as_large(spark):
    """The model's n-grams do not depend on the corpus size: once seen ones count beside many others too."""
    r = random.Random(8)
    seen = [(700, "amber fox quick amber stone"), (705, "quick amber fox"), (706, "nothing of it")]
    for n in (20, 400):
        rows = [(i, " ".join(f"v{r.randrange(300)}" for _ in range(200))) for i in range(n)] + seen
        got = {x["doc_id"]: x["score"] for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ~lm.held_out("doc_id", 7, 2)).collect()}
        want = {x[0]: x[6] for x in brute(rows, 10**12)}
        assert all(got[d] == pytest.approx(want[d], rel=1e-6 if d >= 700 else 0.02) for d in want)


def test_counts_table():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    table = textkit.Counts(keys, np.arange(len(keys)) + 1)
    assert (table.get(keys) == np.arange(len(keys)) + 1).all()
    assert not table.get(np.setdiff1d(keys + np.uint64(1), keys)).any()
    assert not textkit.Counts(keys[:0], keys[:0]).get(keys).any()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, F.lit(True)).collect() == []
