"""Personal data: exact patterns plus a linear-chain conditional random field.

Patterns give the base spans. The CRF labels blank-separated words from word-shape
features of each word and its neighbours, is trained on the driver from a small labelled
table, and is decoded by Viterbi in numpy batches. Its spans are added where no base span
lies; base spans always stay.

A word is surely outside if its score for O beats every other label by more than any
transition can give back. Such words cut the chain without changing the best path, so
Viterbi runs on short segments around words that hold digits or marks, many segments at
once, although every word of every text is part of the decoded chain.

Nulls: a null text is an empty one and has no spans; a null id keeps its row. Repeated
rows and extra columns do no harm. A pass over the texts; no shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm import textkit

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TABLE_ROWS = 20_000  # the most labelled words that are fitted

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; every pattern is scanned in time linear in the text."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# Features of a word from its bytes.

_GROUPS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "@", ".", "-", "+", "()", "[]{}<>=/\\\"'`_#$%&*|~^:;?!,")
_GROUP = np.zeros((256, len(_GROUPS)), np.int32)
for _k, _chars in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _chars], _k] = 1
#: bytes that make a word more than plain; words without any have one and the same shape
_SPECIAL = np.zeros(256, dtype=bool)
_SPECIAL[[ord(c) for c in "0123456789@+(["]] = True
N_SHAPE = 31
PLAIN = 30


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word-shape features (n, N_SHAPE) of words given by byte spans; each word's trailing comma or stop is ignored."""
    whole = np.zeros((len(start), N_SHAPE), np.float32)
    run = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_SPECIAL[data], out=run[1:])
    rich = np.flatnonzero(run[end] > run[start])
    whole[:, PLAIN] = 1
    whole[rich] = _rich(data, start[rich], end[rich])
    return whole


def _rich(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(start)
    out = np.zeros((n, N_SHAPE), np.float32)
    if not n:
        return out
    end = end.copy()
    for _ in range(2):
        tail = np.isin(data[end - 1], (0x2C, 0x2E, 0x3B, 0x3A, 0x21, 0x3F)) & (end - start > 1)
        end[tail] -= 1
    size = end - start
    owner = np.repeat(np.arange(n), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    counts = np.zeros((n, len(_GROUPS)), np.int64)
    for k in range(len(_GROUPS)):
        counts[:, k] = np.bincount(owner, _GROUP[data[at], k], n)
    d, a, mail, dots, dash, plus, paren, sign = counts.T
    for i, (lo, hi) in enumerate(((1, 1), (2, 2), (3, 3), (4, 4), (5, 7), (8, 12), (13, 19), (20, 10**9))):
        out[:, i] = (d >= lo) & (d <= hi)
    out[:, 8] = d == 0
    out[:, 9] = a == 0
    out[:, 10] = (a > 0) & (d > 0)
    out[:, 11] = (mail == 1) & (size > 4)
    out[:, 12] = mail > 1
    out[:, 13] = (dots == 3) & (d >= 4) & (d + dots == size)
    out[:, 14] = (dots > 0) & (dots != 3)
    out[:, 15] = (dots > 0) & (a > 2) & (d + a + dots + dash == size)
    out[:, 16] = dash == 1
    out[:, 17] = dash > 1
    out[:, 18] = data[start] == 0x2B
    out[:, 19] = paren == 2
    out[:, 20] = paren == 1
    out[:, 21] = sign > 0
    out[:, 22] = d == size
    out[:, 23] = (d + dash == size) & (dash > 0)
    out[:, 24] = (d + dash + dots + paren + plus == size) & (d > 0)
    out[:, 25] = size == 1
    out[:, 26] = size > 24
    out[:, 27] = plus > 1
    word = [bytes(data[s:e]).lower() if e - s <= 5 else b"" for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    out[:, 28] = [w in (b"(at)", b"[at]", b"(dot)", b"[dot]") for w in word]
    out[:, 29] = (d == 8) & (size == 10) & (data[np.minimum(start + 4, len(data) - 1)] == 0x2D)
    return out


def observed(own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A word's features with those of both neighbours (zeros beyond an end)."""
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)


@dataclass
class Model:
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (labels, labels)


def labelled_table(n: int = 450, seed: int = 11) -> list[tuple[int, int, str, str]]:
    """The small labelled table: (sentence, position, word, label) rows made by rule."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(str(int(r.integers(10))) for _ in range(k))
    word = lambda: "".join(pick("etaoinshrdlucm") for _ in range(int(r.integers(1, 9))))
    tail = lambda: pick(["", "", "", ".", ","])

    def card() -> str:
        d = pick("3456") + num(pick([14, 14, 14, 13, 15, 17]))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def email() -> list[str]:
        a, b = pick([word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}+{word()}", f"{word()}-{num(1)}"]), f"{word()}.{pick(['com', 'org', 'net', 'example.com', 'co.uk'])}"
        return pick([[f"{a}@{b}"], [f"{a}@{b}"], [f"{a}@{b}"], [f"<{a}@{b}>"], [a, "(at)", b], [a, "[at]", b.split(".")[0], "[dot]", b.split(".")[-1]]])

    def phone() -> list[str]:
        return pick([["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"], ["+" + num(2), num(3), num(3), num(4)], [f"+{num(11)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"+{num(2)}-{num(3)}-{num(6)}"], [f"+{num(1)}.{num(3)}.{num(3)}.{num(4)}"]])

    def number() -> list[str]:
        c = card()
        return pick([[c], [c], [c], [c[:4], c[4:8], c[8:12], c[12:16]] if len(c) == 16 else [c], [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"]])

    def ip() -> list[str]:
        return [".".join(str(int(r.integers(256))) for _ in range(4))]

    def plain() -> list[str]:
        return pick([[f"20{num(2)}-{num(2)}-{num(2)}"], [f"{num(1)}.{num(1)}"], [f"{num(1)}.{num(1)}.{num(2)}"], [f"${num(2)}.{num(2)}"], [num(int(r.integers(1, 9)))], [f"#{num(5)}"], [f"{num(2)}:{num(2)}"], ["token", "=", f'"{"".join(pick("0123456789abcdef") for _ in range(40))}"'], [f"password={''.join(pick('0123456789abcdef') for _ in range(18))}"], [f"v{num(1)}.{num(1)}.{num(1)}.{num(1)}"], ["|"], [f"{word()}@"], [f"@{word()}"], [f"({num(4)})"], [f"{word()}###"], [f"1.{num(2)}.{num(1)}.{num(3)}.{num(1)}"], [f"{num(2)}-{num(2)}"], [num(24)], [f"{word()}.{word()}"], [f"({word()})"], [f"{word()}***"], [f"{word()}{num(1)}"], [f"{word()}_{word()}[{num(1)}]"], ["[link]"], [f"+{num(2)}"], [f"{num(3)}-{num(4)}"], [num(4), num(4)]])

    rows = []
    for s in range(n):
        words: list[tuple[str, str]] = []
        for _ in range(int(r.integers(1, 4))):
            words += [(word() + tail(), "O") for _ in range(int(r.integers(1, 5)))]
            k = int(r.integers(7))
            span = (email, ip, number, phone, plain, plain, plain)[k]()
            span[-1] += tail()
            words += [(w, f"{'B' if i == 0 else 'I'}-{KINDS[k]}" if k < 4 else "O") for i, w in enumerate(span)]
        words += [(word() + tail(), "O") for _ in range(int(r.integers(0, 4)))]
        rows += [(s, i, w, y) for i, (w, y) in enumerate(words)]
    return rows


def _encode(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() or b"?" for w in words]
    end = np.cumsum([len(w) for w in raw])
    return shapes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, end[:-1]), end)


def train(rows: Sequence[tuple[int, int, str, str]] | None = None, steps: int = 120, penalty: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam; rows: (sentence, position, word, label), TABLE_ROWS of them at most."""
    rows = sorted(labelled_table() if rows is None else rows, key=lambda x: x[:2])
    if len(rows) > TABLE_ROWS:
        raise ValueError(f"the labelled table has {len(rows)} rows; {TABLE_ROWS} at most are fitted")
    sent = np.unique([x[0] for x in rows], return_inverse=True)[1]
    pos = np.arange(len(rows)) - np.searchsorted(sent, sent)
    n, most, ny = sent.max() + 1, pos.max() + 1, len(LABELS)
    own = _encode([x[2] for x in rows])
    pad = np.zeros((n, most + 2, N_SHAPE), np.float32)
    pad[sent, pos + 1] = own
    x = observed(own, pad[sent, pos], pad[sent, pos + 2])
    y = np.array([LABELS.index(r[3]) for r in rows])
    w, t = np.zeros((x.shape[1], ny)), np.zeros((ny, ny))
    live = np.zeros((n, most), dtype=bool)
    live[sent, pos] = True
    follow = np.flatnonzero(pos[1:] > 0)
    gold_w = x.T.astype(float) @ np.eye(ny)[y]
    gold_t = np.zeros((ny, ny))
    np.add.at(gold_t, (y[follow], y[follow + 1]), 1)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        e = np.zeros((n, most, ny))
        e[sent, pos] = x @ w
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for i in range(1, most):
            z = fwd[:, i - 1, :, None] + t
            top = z.max(1)
            nxt = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[:, i]
            fwd[:, i] = np.where(live[:, i, None], nxt, fwd[:, i - 1])
        last = fwd[:, -1]
        norm = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
        pair = np.zeros((ny, ny))
        for i in range(most - 1, 0, -1):
            z = t + (e[:, i] + bwd[:, i])[:, None, :]
            on = live[:, i]
            pair += np.exp(fwd[on, i - 1, :, None] + z[on] - norm[on, None, None]).sum(0)
            top = z.max(2)
            bwd[:, i - 1] = np.where(on[:, None], top + np.log(np.exp(z - top[..., None]).sum(2)), 0)
        # a padded tail keeps the forward scores of its sentence's last word, whose backward scores are zero
        p = np.exp(fwd + bwd - norm[:, None, None])[sent, pos]
        for k, (par, g) in enumerate(((w, (gold_w - x.T @ p) / n - penalty * w), (t, (gold_t - pair) / n - penalty * t))):
            m, v = moment[2 * k], moment[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            par += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w, t)


@functools.cache
def default_model() -> Model:
    """The model of the default table, fitted once in a process."""
    return train()


def viterbi(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best labels of segments: e (words, labels), first: each segment's first row, and the end. Outside of a segment is O."""
    out = np.zeros(len(e), np.int8)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    if not len(size):
        return out
    score = e[begin] + t[0]
    back = []
    for i in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -i))  # segments longer than i
        z = score[:n, :, None] + t
        back.append(z.argmax(1).astype(np.int8))
        score[:n] = z.max(1) + e[begin[:n] + i]
    label = (score + t[:, 0]).argmax(1).astype(np.int8)
    for i in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -i))
        out[begin[:n] + i] = label[:n]
        if i:
            m = len(back[i - 1])
            label[:m] = back[i - 1][np.arange(m), label[:m]]
    return out


def decode(t: textkit.Texts, model: Model) -> list[tuple[int, int, int, int]]:
    """(document, kind, start byte, end byte) of the CRF's spans in a slice of texts."""
    w = textkit.words(t)
    n = len(w.start)
    if not n:
        return []
    trans = model.transitions
    # the most that the transitions around a word can favour each label over O
    swing = (trans[:, 1:] - trans[:, :1]).max(0) + (trans[1:, :] - trans[:1, :]).max(1)
    plain = np.zeros((1, N_SHAPE), np.float32)
    plain[0, PLAIN] = 1
    quiet = observed(plain, plain, plain) @ model.weights
    run = np.zeros(len(t.data) + 1, np.int32)
    np.cumsum(_SPECIAL[t.data], out=run[1:])
    marked = run[w.end] > run[w.start]
    if (quiet[0, 0] - quiet[0, 1:] <= swing).any():
        marked[:] = True  # then every word is scored
    near = marked.copy()
    for _ in range(2):
        wide = near.copy()
        wide[1:] |= near[:-1] & (w.doc[1:] == w.doc[:-1])
        wide[:-1] |= near[1:] & (w.doc[1:] == w.doc[:-1])
        near = wide
    at = np.flatnonzero(near)
    if not len(at):
        return []
    own = shapes(t.data, w.start[at], w.end[at])
    joined = np.append(False, (np.diff(at) == 1) & (w.doc[at[1:]] == w.doc[at[:-1]]))
    zero = np.zeros((1, N_SHAPE), np.float32)
    before, after = np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero])
    same_before = (at > 0) & (w.doc[at] == w.doc[np.maximum(at - 1, 0)])
    same_after = (at + 1 < n) & (w.doc[at] == w.doc[np.minimum(at + 1, n - 1)])
    before[~joined] = np.where(same_before[~joined, None], plain, zero)
    end_joined = np.append(joined[1:], False)
    after[~end_joined] = np.where(same_after[~end_joined, None], plain, zero)
    e = observed(own, before, after) @ model.weights
    sure = (e[:, :1] - e[:, 1:] > swing).all(1)
    keep = np.flatnonzero(~sure)
    if not len(keep):
        return []
    linked = np.append(False, (np.diff(keep) == 1) & joined[keep[1:]])
    first = np.append(np.flatnonzero(~linked), len(keep))
    y = viterbi(e[keep], first, trans)
    words = at[keep]
    out = []
    for i in np.flatnonzero(y % 2 == 1):
        j = i + 1
        while j < len(y) and linked[j] and y[j] == y[i] + 1:
            j += 1
        s, z = int(w.start[words[i]]), int(w.end[words[j - 1]])
        while z - s > 1 and chr(t.data[z - 1]) in ".,;:!?\"'>":
            z -= 1
        while z - s > 1 and chr(t.data[s]) in "\"'<":
            s += 1
        out.append((int(w.doc[words[i]]), int(y[i]) // 2, s, z))
    return out


def _batch(column: pa.Array, model: Model) -> list[list[tuple]]:
    """For each text its (kind name, start, end, base) spans in code points, by kind, then start."""
    out: list[list[tuple]] = []
    for t in textkit.slices(column):
        digits = np.zeros(len(t.data) + 1, np.int32)
        np.cumsum((t.data >= 48) & (t.data <= 57), out=digits[1:])
        sign = np.zeros(len(t.data) + 1, np.int32)
        np.cumsum(t.data == 0x40, out=sign[1:])
        maybe = (np.diff(digits[t.offsets]) >= 4) | (np.diff(sign[t.offsets]) > 0)
        found: list[list[tuple]] = [[] for _ in range(t.n)]
        for i in np.flatnonzero(maybe):
            found[i] = [(*x, True) for x in base_spans(t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace"))]
        added = decode(t, model)
        if added:
            point = np.zeros(len(t.data) + 1, np.int64)
            np.cumsum((t.data & 0xC0) != 0x80, out=point[1:])
            for d, k, s, z in added:
                zero = point[t.offsets[d]]
                s, z = int(point[s] - zero), int(point[z] - zero)
                if not any(b and s < y and x < z for _, x, y, b in found[d]):
                    found[d].append((k, s, z, False))
        out += [sorted(x) for x in found]
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) for every document; offsets in code points, end exclusive."""
    model = default_model() if model is None else model
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": y} for k, s, e, y in x] for x in _batch(b.column(1), model)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>").withColumnRenamed("id", id_col)


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(id, text) with each span replaced by <KIND>; overlapping spans give way to the earlier one."""
    model = default_model() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, spans in zip(b.column(1).to_pylist(), _batch(b.column(1), model), strict=True):
                parts, at = [], 0
                for k, s, e, _ in sorted(spans, key=lambda y: (y[1], -y[2])):
                    if s >= at:
                        parts += [x[at:s], f"<{KINDS[k].upper()}>"]
                        at = e
                out.append(None if x is None else "".join(parts) + x[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, text string").toDF(id_col, text)
