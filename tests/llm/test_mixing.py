import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytefold.llm import mixing, textkit

WORDS = {"a": "alpha ant apple", "b": "bear bird bee", "c": "cat cow crow"}


def corpus(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        d = r.choices("abc", (6, 3, 1))[0]
        rows.append((i, " ".join(r.choice(WORDS[d].split() + ["the", "of"]) for _ in range(r.randrange(5, 80))), d, "x"))
    return rows


def shares(rows):
    n = Counter()
    for _, t, d, _ in rows:
        n[d] += len((t or "").split())
    return {d: n[d] / sum(n.values()) for d in "abc"}


TARGETS = {"a": 0.4, "b": 0.35, "c": 0.25}


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_targets_are_met(spark, least):
    rows = [*corpus(), (900, None, "a", "x"), (901, "", "b", "x"), (None, "the cow", "c", "x"), (5, *corpus()[5][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, copies string").repartition(3)
    got = mixing.mixed(df, df.limit(500), TARGETS, least=least)
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    now = shares(got)
    assert all(abs(now[d] - TARGETS[d]) < 0.04 for d in TARGETS)
    if least:
        assert not Counter(rows) - Counter(got)
    else:
        assert abs(sum(len((t or "").split()) for _, t, _, _ in got) / sum(len((t or "").split()) for _, t, _, _ in rows) - 1) < 0.1


def plain_fit(p, n, want, least, rounds=4000):
    """Nonnegative rates by small projected steps on the weighted squares, all documents at once."""
    rate = np.full(len(p), max(1.0, least))
    weight = 1 / np.maximum((rate * n) @ p, mixing.SHORT * want)
    for _ in range(rounds):
        off = ((rate * n) @ p - want) * weight
        rate = np.maximum(least, rate - 0.5 * (p @ off + mixing.PULL * (rate - 1)))
    return rate


@pytest.mark.parametrize("targets, least, met", [(TARGETS, 0.0, True), (TARGETS, 1.0, True), ({"a": 0.1, "b": 0.1, "c": 0.8}, 0.0, True), ({"a": 0.05, "b": 0.05, "c": 0.9}, 1.0, False)])
def test_rates_against_a_plain_fit(spark, targets, least, met):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, e string")
    model = mixing.balance(df, mixing.train(df, targets), targets, least=least)
    out = mixing.with_rates(df, model).collect()
    p, n = mixing.posteriors(next(textkit.slices(pa.array([r["row"]["text"] for r in out]))), model)
    rate = np.array([r["rate"] for r in out])
    weight = np.array([targets[d] for d in model.domains])
    have = n @ p
    want = weight * (n.sum() if least < 1 else (have / weight).max())
    assert (rate >= least).all()
    # many rates give the same sums, so the sums and the squares are compared
    plain = plain_fit(p, n, want, least)
    reached, plainly = ((x * n) @ p / want for x in (rate, plain))
    assert np.abs(reached - plainly).max() < 0.005
    assert n @ np.abs(rate - plain) < 0.02 * (n @ plain)
    # where nothing may be thinned, what the rare domain's texts share with others can keep the best fit off its targets
    assert (np.abs(plainly - 1).max() < 0.01) == (np.abs(reached - 1).max() < 0.01) == met
    assert np.abs(reached - model.reached).max() < 1e-3
    assert (p.argmax(1) == [model.domains.index(r["row"]["domain"]) for r in out]).mean() > 0.97


def test_a_domain_far_below_its_target(spark):
    """A domain with a few hundredths of its target is filled, and few steps do."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS[d].split()) for _ in range(40)), d, "x") for i, d in enumerate("a" * 500 + "b" * 500 + "c" * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, e string")
    model = mixing.balance(df, mixing.train(df, {"a": 0.4, "b": 0.4, "c": 0.2}), {"a": 0.4, "b": 0.4, "c": 0.2})
    assert np.abs(model.reached - 1).max() < 0.02 and len(model.residuals) < mixing.STEPS


def test_very_long_and_repeated_rows(spark):
    rows = [(1, "alpha " * 300_000, "a", "x"), (2, "bird", "b", "x"), (2, "bird", "b", "x"), (3, "cow", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, tokens string")
    out = mixing.with_rates(df, mixing.balance(df, mixing.train(df, TARGETS), TARGETS, least=1.0)).collect()
    assert sorted(r["tokens"] for r in out) == [1, 1, 1, 300_000]
    assert all(np.isfinite(r["rate"]) and r["rate"] >= 1 for r in out)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "alpha", "a", "e")], "doc_id long, text string, domain string, e string")
    assert mixing.mixed(df.limit(0), df, TARGETS).collect() == []
    assert mixing.mixed(df, df.limit(0), TARGETS, least=1.0).where(F.col("doc_id") == 1).count() >= 1
