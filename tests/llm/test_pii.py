import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bytefold.llm import pii, textkit

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.train(steps=60)


def texts(seed, n=300):
    r = random.Random(seed)
    bits = ["a@b.co", "x@y@z.org.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (578) 555-6437", "4918187128635271", "+", "@", "é.x@ü.de", "..", "12", "word", "the", "(555)", "-", " ", "\n", "0" * 25, "+12345678901", "a.b-c_d%e+f@q-r.s-t.u", "token", "###"]
    return ["".join(r.choice(bits) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def test_base_patterns_against_re():
    for t in texts(1, 1500):
        assert pii.base_spans(t) == plain(t), t


def test_base_patterns_stay_linear():
    for t in ("9" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 200_000, "+1" + " " * 300_000):
        pii.base_spans(t)


def test_cut_chains_decode_as_whole_chains(model):
    for t in texts(2):
        s = next(textkit.slices(pa.array([t])))
        w = textkit.words(s)
        if not len(w.start):
            continue
        own = pii.shapes(s.data, w.start, w.end)
        pad = np.zeros((1, pii.N_SHAPE), np.float32)
        x = pii.observed(own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad]))
        y = pii.viterbi(x @ model.weights, np.array([0, len(own)]), model.transitions)
        want = []
        i = 0
        while i < len(y):
            j = i + 1
            if y[i] % 2 == 1:
                while j < len(y) and y[j] == y[i] + 1:
                    j += 1
                want.append((int(y[i]) // 2, int(w.start[i])))
            i = j
        got = pii.decode(s, model)
        assert len(got) == len(want)
        assert [k for _, k, _, _ in got] == [k for k, _ in want]


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    ny = len(pii.LABELS)
    e, t = r.normal(size=(3, ny)), r.normal(size=(ny, ny))
    best = max(np.ndindex(ny, ny, ny), key=lambda y: t[0, y[0]] + e[0, y[0]] + t[y[0], y[1]] + e[1, y[1]] + t[y[1], y[2]] + e[2, y[2]] + t[y[2], 0])
    assert tuple(pii.viterbi(e, np.array([0, 3]), t)) == best


def test_held_out_sentences(model):
    rows, hit, gold = pii.labelled_table(150, seed=77), 0, 0
    by = {}
    for s, _, w, y in rows:
        by.setdefault(s, []).append((w, y))
    column = pa.array([" ".join(w for w, _ in v) for v in by.values()])
    for v, found in zip(by.values(), pii._batch(column, model), strict=True):
        at = 0
        for w, y in v:
            if y[0] == "B":
                gold += 1
                hit += any(pii.KINDS[k] == y[2:] and abs(s - at) <= 1 for k, s, _, _ in found)
            at += len(w) + 1
    assert hit >= 0.95 * gold


def test_query_shape(spark, model):
    rows = [(1, "mail é kfs.1@mail0.example.com or +1 (578) 555-6437 4918187128635271 now"), (2, None), (3, ""), (4, "x " * 50_000), (1, "ip 1.2.3.4"), (None, "ip 1.2.3.4")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.find(df, model=model).collect()]
    assert got[1:4] == [(2, []), (3, []), (4, [])]
    assert got[4][1] == got[5][1] == [("ip", 3, 10, True)]
    assert ("email", 7, 30, True) in got[0][1]
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(df.limit(1), model=model).collect()}
    assert "@" not in hidden[1] and "<EMAIL>" in hidden[1]
    assert pii.find(df.limit(0), model=model).collect() == []
