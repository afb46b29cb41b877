"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is fitted to
confirmed toxic texts and to unlabelled ones. The risk of the negative class is that of
the unlabelled texts less the share that the class prior says is toxic; where this
estimate falls below zero, its gradient is turned round instead of being followed
(Kiryo et al., 2017).

The fit takes a bounded sample (POSITIVES and UNLABELLED texts, those of smallest id
hash); its features are counted by Spark and the FEATURES best are collected. Scoring is
one pass over all texts. The sample ids that are broadcast are bounded likewise.

Nulls: a null text is an empty one, a null id is never sampled, and a null label is no
confirmation. Repeated rows are scored each. Only the text is read for a score, so other
columns have no say in it. Without a confirmed text every score is the prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytefold.llm import textkit, workspace
from bytefold.llm.textkit import Counts

POSITIVES = 2000
UNLABELLED = 6000
FEATURES = 4096
LEAST_DOCS = 4
LIFT = 4.0
DEVIATIONS = 4.0
BEGINNINGS = (4, 5, 6, 8)

_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in ".,;:!?\"')*#$%&|"]] = True


def _features(t: textkit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and word beginnings, with its document; not yet distinct."""
    w = textkit.words(t)
    end = w.end.copy()
    for _ in range(3):
        cut = (end - w.start > 1) & _TAIL[t.data[end - 1]] if len(end) else np.zeros(0, bool)
        end[cut] -= 1
    spans = [(w.start, end, w.doc)]
    for n in BEGINNINGS:
        long = end - w.start > n
        spans.append((w.start[long], w.start[long] + n, w.doc[long]))
    start, stop, doc = (np.concatenate(x) for x in zip(*spans, strict=True))
    mark = np.concatenate([np.full(len(s[0]), k, np.uint64) for k, s in enumerate(spans)])
    return textkit.span_hashes(t, start, stop) ^ (mark * np.uint64(0xC2B2AE3D27D4EB4F)), doc


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float, n_features: int, steps: int = 400, rate: float = 0.05, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk with logistic loss; rows, cols: where the 0/1 matrix has ones."""
    w, b = np.zeros(n_features), -2.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n = len(positive)
    share_p, share_u = positive / max(positive.sum(), 1), ~positive / max((~positive).sum(), 1)
    for step in range(1, steps + 1):
        g = np.bincount(rows, w[cols], n) + b
        down = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # slope of the loss of calling it negative
        soft = np.logaddexp(0, g)
        negative = (share_u * soft).sum() - prior * (share_p * soft).sum()
        d_negative = share_u * down - prior * share_p * down
        d_positive = prior * share_p * (down - 1)
        d = d_positive + d_negative if negative >= 0 else -d_negative
        grad = np.append(np.bincount(cols, d[rows], n_features) + decay * prior * w, d.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


@dataclass
class Model:
    index: Counts  # feature -> position + 1
    weights: np.ndarray
    bias: float


def _by_hash(ids: DataFrame, n: int) -> DataFrame:
    return ids.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(n)


def _shingle_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, p) with two minima over each text's 5-word shingles; near copies mostly share one."""
    for b in batches:
        low = [np.zeros((0, 2), np.uint64)]
        for t in textkit.slices(b.column("text")):
            w = textkit.words(t)
            h = textkit.word_hashes(t, w)
            a, z, doc = textkit.spans_of(w, 5)
            s = np.zeros(len(a), np.uint64)
            for k in range(5):
                s = textkit.mix(s * np.uint64(3) + h[np.minimum(a + k, z)])
            m = np.zeros((t.n, 2), np.uint64)
            m[:, :] = (t.first + np.arange(t.n))[:, None]  # a text without words is its own
            if len(a):
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                m[doc[first], 0] = np.minimum.reduceat(s, first)
                m[doc[first], 1] = np.minimum.reduceat(textkit.mix(s + np.uint64(0x9E3779B97F4A7C15)), first)
            low.append(m)
        m = np.concatenate(low).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("p"), b.column("text"), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["id", "p", "text", "k0", "k1"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """learn: a boolean column over `id`; other rows give neither labels nor texts."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where(learn)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(learn)
    share = marks.agg(F.avg((F.col("y") == 1).cast("double")).alias("p")).first()["p"]
    prior = min(max(share or 0.01, 1e-4), 0.9)
    sure = marks.where("y = 1").select("id").distinct()
    chosen = _by_hash(sure, positives).withColumn("p", F.lit(1)).unionByName(_by_hash(ids.distinct(), unlabelled).withColumn("p", F.lit(0)))
    chosen = workspace.keep(chosen.coalesce(1), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # at most positives + unlabelled ids
    kept = texts.mapInArrow(_shingle_minima, "id long, p int, text string, k0 long, k1 long")
    for k in ("k0", "k1"):  # copies of one text would make all its words look like signs
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("p", k).orderBy("id", "text"))).where("r = 1")
    sample = workspace.keep(kept.select("p", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            for t in textkit.slices(b.column(1)):
                h, doc = _distinct(*_features(t))
                y = p[t.first + doc] == 1
                keys, inverse = np.unique(h, return_inverse=True)
                n = [np.bincount(inverse, w, len(keys)).astype(np.int64) for w in (y, ~y)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, n)], names=["h", "p", "u"])

    size = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return Model(Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(0), math.log(prior / (1 - prior)))
    rate_p, rate_u = F.col("p") / n_p, (F.col("u") + 0.5) / n_u
    best = sample.mapInArrow(count, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    best = best.where((F.col("p") >= min(LEAST_DOCS, max(1, n_p // 20))) & (rate_p >= LIFT * rate_u) & (F.col("p") - n_p * rate_u >= DEVIATIONS * F.sqrt(n_p * rate_u))).orderBy((rate_p - rate_u).desc(), "h").limit(FEATURES).toArrow()
    keys = best.column("h").to_numpy().view(np.uint64)
    index = Counts(keys, np.arange(1, len(keys) + 1))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textkit.slices(b.column(1)):
                h, doc = _distinct(*_features(t))
                at = index.get(h)
                doc, at = doc[at > 0], at[at > 0]
                first = np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), pa.ListArray.from_arrays(pa.array(first), pa.array(at.astype(np.int32)))], names=["p", "f"])

    got = sample.mapInArrow(look, "p int, f array<int>").toArrow()
    lists = got.column("f").combine_chunks()
    cols = lists.flatten().to_numpy() - 1
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    weights, bias = fit_nnpu(rows, cols.astype(np.int64), got.column("p").to_numpy() == 1, prior, len(keys))
    return Model(index, weights, bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [np.zeros(0)]
            for t in textkit.slices(b.column(1)):
                h, doc = _features(t)
                at = m.index.get(h)
                doc, at = doc[at > 0], at[at > 0]
                key = np.unique(doc * np.int64(FEATURES + 1) + at)
                doc, at = key // (FEATURES + 1), key % (FEATURES + 1)
                g = np.bincount(doc, m.weights[at - 1], t.n) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(g, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
