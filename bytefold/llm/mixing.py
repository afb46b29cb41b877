"""Mixing sources to target weights by soft membership.

A softmax classifier over hashed words is fitted on the driver to a labelled table
(LABELLED rows at most, those of smallest hash) and gives every document posteriors over
the target domains. Nonnegative document rates are then fitted by projected-gradient
least squares so that the expected domain tokens, sum of rate * tokens * posterior, meet
the targets. The gradient of a document depends on the rest of the corpus only through
one residual for each domain, so a step is one distributed sum of as many numbers, and a
rate is a function of the document and the list of residuals: nothing else is moved.

The squares are weighted by 1 / the tokens a domain starts with (SHORT of its target at
least), which bounds the curvature by one: a step of one never overshoots, and a domain far
below its target nears it as fast as the others. Steps end when no domain is off its target
by CLOSE of it, or none moves by that any more. Model.reached tells the expected tokens as
parts of the targets; a domain that stays short is seen there.

`least` bounds the rates from below. At 0, domains in excess are thinned; at 1 no
document is lost, and the total is as large as the targets then need.

Nulls: a null text has no tokens and the prior's posteriors; null ids and labels are not
learned from. Repeated rows count each. Extra columns pass through. Domains without a
labelled row or a token cannot be filled and keep their residual. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm import textkit, workspace

LABELLED = 4000
BUCKETS = 1 << 14
STEPS = 100
CLOSE = 1e-4
SHORT = 0.05
PULL = 1e-3


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray  # (BUCKETS, domains)
    bias: np.ndarray
    least: float = 0.0
    residuals: list[np.ndarray] = field(default_factory=list)
    reached: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _bags(t: textkit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and share of its words, for each bucket of each document; and word counts."""
    w = textkit.words(t)
    bucket = (textkit.word_hashes(t, w) % np.uint64(BUCKETS)).astype(np.int64)
    key, n = np.unique(w.doc * BUCKETS + bucket, return_counts=True)
    doc = key // BUCKETS
    return doc, key % BUCKETS, n / np.maximum(w.count, 1)[doc], w.count


def fit(doc: np.ndarray, bucket: np.ndarray, share: np.ndarray, y: np.ndarray, k: int, steps: int = 200, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax classifier, by Adam on all rows."""
    w, b = np.zeros((k, BUCKETS)), np.zeros(k)
    gold = np.eye(k)[y].T
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        g = np.stack([np.bincount(doc, w[c, bucket] * share, len(y)) + b[c] for c in range(k)])
        p = np.exp(g - g.max(0))
        e = (p / p.sum(0) - gold) / len(y)
        gw = decay * w + np.stack([np.bincount(bucket, e[c, doc] * share, BUCKETS) for c in range(k)])
        for x, m, v, grad in ((w, mw, vw, gw), (b, mb, vb, e.sum(1))):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return np.ascontiguousarray(w.T), b


def posteriors(t: textkit.Texts, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(documents, domains) posteriors, and word counts."""
    doc, bucket, share, count = _bags(t)
    g = np.tile(m.bias, (t.n, 1))
    if len(doc):
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        g[doc[starts]] += np.add.reduceat(m.weights[bucket] * share[:, None], starts)
    p = np.exp(g - g.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), count


def rates(p: np.ndarray, m: Model) -> np.ndarray:
    """The documents' rates after all residuals so far."""
    r = np.full(len(p), max(1.0, m.least))
    for rho in m.residuals:
        r = np.maximum(m.least, r - p @ rho - PULL * (r - 1))
    return r


def train(labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text: str = "text", domain: str = "domain", most: int = LABELLED, known: DataFrame | None = None) -> Model:
    """labelled: rows with an id, a text and a domain. known: a table of ids; only those rows are learned from."""
    domains = sorted(targets)
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(domain).alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull())
    # a small look-up of ids first, so that texts outside the sample are not sorted
    ids = rows.select("id").distinct()
    if known is not None:
        ids = ids.join(known.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = rows.join(F.broadcast(workspace.keep(ids.coalesce(1), "labelled")), "id")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textkit.slices(b.column(1)):
                doc, bucket, share, _ = _bags(t)
                off = pa.array(np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(2).slice(t.first, t.n), pa.ListArray.from_arrays(off, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(share.astype(np.float32)))], names=["domain", "bucket", "share"])

    got = rows.select("id", "text", "domain").mapInArrow(bag, "domain string, bucket array<int>, share array<float>").toArrow()
    if not got.num_rows:
        return Model(domains, np.zeros((BUCKETS, len(domains))), np.zeros(len(domains)))
    bucket, share = got.column("bucket").combine_chunks(), got.column("share").combine_chunks()
    doc = np.repeat(np.arange(len(bucket)), np.diff(bucket.offsets.to_numpy()))
    y = np.array([domains.index(d) for d in got.column("domain").to_pylist()])
    w, b = fit(doc, bucket.flatten().to_numpy().astype(np.int64), share.flatten().to_numpy().astype(float), y, len(domains))
    return Model(domains, w, b)


def balance(docs: DataFrame, model: Model, targets: Mapping[str, float], text: str = "text", least: float = 0.0, total: float | None = None, steps: int = STEPS) -> Model:
    """The model with the residuals of a projected-gradient fit. total: tokens wanted; None: as many as there are, or as `least` needs."""
    spark, k = docs.sparkSession, len(model.domains)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textkit.slices(b.column(0)):
                p, n = posteriors(t, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(p.astype(np.float32).ravel()), k).cast(pa.list_(pa.float32()))], names=["n", "p"])

    table = workspace.keep(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(score, "n long, p array<float>"), "posteriors")

    def sums(m: Model) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for b in batches:
                p = b.column(1).flatten().to_numpy().reshape(-1, k).astype(float)
                out += (rates(p, m) * b.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(out)], names=["d", "s"])

        got = table.mapInArrow(add, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k)
        for r in got:
            out[r["d"]] = r["s"]
        return out

    weight = np.array([float(targets[d]) for d in model.domains])
    weight = weight / weight.sum()
    light = Model(model.domains, np.zeros((0, k)), model.bias, least)
    have = sums(light)
    if not have.sum():
        workspace.drop(table)
        return Model(model.domains, model.weights, model.bias, least, reached=np.zeros(k))
    if total is None:
        total = have.sum() if least < 1 else float((have[weight > 0] / weight[weight > 0]).max())
    want = np.maximum(weight * total, 1e-9 * total)
    now, was = have, np.full(k, np.inf)
    for _ in range(steps):
        if np.abs(now / want - 1).max() < CLOSE or np.abs((now - was) / want).max() < CLOSE:
            break
        rho = (now - want) / np.maximum(have, SHORT * want)
        rho[(have <= 0) & (rho < 0)] = 0
        light.residuals = [*light.residuals, rho]
        now, was = sums(light), now
    workspace.drop(table)
    return Model(model.domains, model.weights, model.bias, least, light.residuals, now / want)


def with_rates(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row: struct of all columns of docs, tokens, domain, rate, copies); copies: the rate rounded up or down by a hash of the text and row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.domains)
        for b in batches:
            p, n = [np.zeros((0, len(names)))], [np.zeros(0, np.int64)]
            for t in textkit.slices(b.column(1)):
                x, y = posteriors(t, m)
                p.append(x)
                n.append(y)
            p, n = np.concatenate(p), np.concatenate(n)
            r = rates(p.astype(np.float32).astype(float), m)
            spin = textkit.mix(b.column(2).to_numpy().view(np.uint64)) / 2.0**64
            copies = np.floor(r) + (spin < r - np.floor(r))
            cols = [b.column(0), pa.array(n), pa.array(names[p.argmax(1)] if len(p) else [], pa.string()), pa.array(r), pa.array(copies.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "tokens", "domain", "rate", "copies"])

    from pyspark.sql import types as T

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    src = docs.select(row, F.col(text).cast("string").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not dict(docs.dtypes)[c].startswith("map")]).alias("spin"))
    schema = T.StructType([src.schema["row"], *[T.StructField(n, t) for n, t in (("tokens", T.LongType()), ("domain", T.StringType()), ("rate", T.DoubleType()), ("copies", T.IntegerType()))]])
    return src.mapInArrow(run, schema)


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text: str = "text", domain: str = "domain", least: float = 0.0, known: DataFrame | None = None) -> DataFrame:
    """docs with each row as often as its copies say."""
    model = balance(docs, train(labelled, targets, id_col, text, domain, known=known), targets, text, least)
    out = with_rates(docs, model, text).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
