import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytefold.llm import packing


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    fixed, left = packing.reduce_instance(dict(Counter(sizes)), 20)
    assert all(sum(p) <= 20 for _, p in fixed)
    assert Counter(s for n, p in fixed for s in p * n) + Counter(left) == Counter(sizes)
    assert sum(n for n, _ in fixed) + fewest(list(Counter(left).elements()), 20) == fewest(sizes, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_patterns_hold_every_piece_once(sizes):
    patterns = packing.solve(dict(Counter(sizes)), 64)
    assert all(sum(p) <= 64 and n > 0 for n, p in patterns)
    assert sum((Counter({s: n * k for s, k in Counter(p).items()}) for n, p in patterns), Counter()) == Counter(sizes)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["", "plain words", "été ßx 日本 \U0001f600", " \n\n  tabs\t\t", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n", "<|endoftext", "a" * 3000, "'s 've 12345 !!??", "\x00\x1f", "x y z"])
def test_ids_are_those_of_an_untouched_tokenizer(text):
    assert packing._encoder("byte_bpe_50k.json")(text).tolist() == untouched().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab '\n\t1é日!", max_size=60))
def test_ids_of_any_text(text):
    global _whole
    _whole = globals().get("_whole") or untouched()
    assert packing._encoder("byte_bpe_50k.json")(text).tolist() == _whole.encode(text, add_special_tokens=False).ids


def test_whole_round_trip(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("the of stone river été light".split()) for _ in range(rnd.choice([1, 5, 40, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one <|endoftext|> two"), (7, rows[7][1]), (None, "lost id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, offset int")
    got = packing.pack(df, capacity=256, with_ids=True).collect()
    encode = untouched()
    ids = Counter((d, tuple([*encode.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"] <= 256
        whole.setdefault(r["doc_id"], []).append(r)
    for (d, want), n in ids.items():
        seen = [x for r in whole[d] for x in r["ids"]]
        assert Counter(seen) == Counter(list(want) * n)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 256) * 1.1 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
