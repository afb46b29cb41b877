"""SimHash near-duplicates.

Fingerprints are made in one pass over Arrow batches. Links among the distinct
fingerprints come from a segment-popcount embedding: a fingerprint becomes 32 counts of
set bits in its 2-bit segments, packed in one long. The Manhattan distance of two
embeddings is a lower bound of the Hamming distance, so if it must be at most 4, then
of `blocks` disjoint blocks of dimensions at most 4 can differ: two fingerprints that
link agree on blocks - 4 whole blocks. Each choice of those blocks is a grid cell to
join on. Cells are range-scanned by total popcount (the Manhattan bound in one
dimension) and each candidate is verified on the bits. A cell emits the stars of its
own link forest, never its pairs.

A cell too large for a task's memory (cells are counted first) does not take that path: its
fingerprints meet in the middle, through all values within two bit flips of each (two fingerprints at
distance 4 or less share one, and all that share one lie within distance 4), which is
exact and linear however dense the group is.

Nulls: a null text counts as empty and has fingerprint zero; a null id keeps its row.
Repeated rows and ids stay as they are. Only the id and text columns are read, so other
columns cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm import graph, textkit, workspace

SEED = 42
SEGMENTS = 32
CELL_ROWS = 60_000


def fingerprint_column(column: pa.Array, width: int) -> np.ndarray:
    """Unsigned fingerprints of a batch's texts: XXH64 of lower-cased, blank-joined shingles."""
    digest = xxhash.xxh64_intdigest
    out = [np.zeros(0, np.uint64)]
    for t in textkit.slices(column):
        w = textkit.words(t)
        if not len(w.start):
            out.append(np.zeros(t.n, np.uint64))
            continue
        body, start, end = textkit.normalised(t, w)
        a, z, doc = textkit.spans_of(w, width)
        h = np.fromiter((digest(body[x:y], SEED) for x, y in zip(start[a].tolist(), end[z].tolist(), strict=True)), np.uint64, len(a))
        out.append(textkit.majority(textkit.bit_counts(h, doc, t.n), np.bincount(doc, minlength=t.n)))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): a pass over the texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_column(b.column(1), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def cell_masks(distance: int, blocks: int) -> list[int]:
    """One mask of embedding dimensions for each choice of blocks that may all agree."""
    parts = np.array_split(np.arange(SEGMENTS), blocks)
    masks = [sum(3 << (2 * int(k)) for k in p) for p in parts]
    out = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _cells(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(c, k, pop, fp): each fingerprint in each of its grid cells."""
    low = 0x5555555555555555
    a, b = f"(fp & {low}L)", f"(shiftrightunsigned(fp, 1) & {low}L)"
    v = f"(({a} ^ {b}) | shiftleft({a} & {b}, 1))"  # their sum in each 2-bit lane
    cells = ", ".join(f"struct(cast({i} as tinyint) as c, v & {m}L as k)".replace("& -9223372036854775808L", "& (-9223372036854775807L - 1L)") for i, m in enumerate(cell_masks(distance, blocks)))
    return fps.selectExpr("fp", f"{v} as v", "cast(bit_count(fp) as smallint) as pop").selectExpr("fp", "pop", f"explode(array({cells})) as x").selectExpr("x.c as c", "x.k as k", "pop", "fp")


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of all pairs (i, j); parents are the smallest positions."""
    while len(i):
        a, b = parent[i], parent[j]
        while True:
            up = parent[a]
            if (up == a).all():
                break
            a = up
        while True:
            up = parent[b]
            if (up == b).all():
                break
            b = up
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def cell_forest(cell_end: np.ndarray, pop: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, root fp) of rows sorted by cell, then popcount; cell_end: where each row's cell ends."""
    n = len(fp)
    parent = np.arange(n)
    live, step = np.arange(n), 1
    while len(live):
        live = live[live + step < cell_end[live]]
        live = live[pop[live + step] - pop[live] <= distance]
        near = np.bitwise_count(fp[live] ^ fp[live + step]) <= distance
        _unite(parent, live[near], live[near] + step)
        step += 1
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    linked = np.flatnonzero(parent != np.arange(n))
    return fp[linked], fp[parent[linked]]


def _scan(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Sorted cell rows in, links out."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)), np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(3)).view(np.uint64)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        c, k, pop, fp = cols
        if not len(c):
            continue
        new = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            ends = np.append(new[:-1], last)
            starts = np.append(0, ends[:-1])
            yield out(*cell_forest(np.repeat(ends, ends - starts), pop[:last], fp[:last], distance))
        rest = [c[last:], k[last:], pop[last:], fp[last:]]
    if rest is not None and len(rest[0]):
        yield out(*cell_forest(np.full(len(rest[0]), len(rest[0])), rest[2], rest[3], distance))


def _flips(fps: DataFrame) -> DataFrame:
    """Links among fingerprints through the values within two bit flips of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        flips = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for at in range(0, len(fp), 200):
                some = fp[at : at + 200]
                near = (some[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["near", "fp"])

    near = fps.mapInArrow(run, "near long, fp long")
    hub = near.groupBy("near").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("near", "hub")
    return near.join(hub, "near").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) star links whose components are those of all pairs within `distance` (4 at most) bits.

    fps: one column fp, without repeats, as a written table. blocks: more blocks make cells smaller
    and more of them; None chooses by the number of fingerprints, which changes no result.
    """
    if not 0 < distance <= 4:
        raise ValueError("distance must be 1 to 4")
    if blocks is None:
        n = fps.count()
        blocks = distance + (2 if n < 1 << 25 else 3 if n < 1 << 30 else 4)
    cells = _cells(fps.select("fp"), distance, blocks)
    # a cell has at least cell_rows rows to be listed here, so the list is short
    dense = workspace.keep(cells.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("c", "k"), "dense")
    crowded = dense.count() > 0
    few = cells.join(workspace.within(dense), ["c", "k"], "left_anti") if crowded else cells
    few = few.select("c", "k", "pop", "fp").repartition("c", "k").sortWithinPartitions("c", "k", "pop", "fp")
    pairs = few.mapInArrow(lambda b: _scan(b, distance), "a long, b long")
    if crowded:
        pairs = pairs.unionByName(_flips(cells.join(workspace.within(dense), ["c", "k"], "left_semi").select("fp").distinct()))
    return workspace.keep(pairs.distinct(), "cells")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, fp long, component long) for every document; component: the smallest id reachable over links."""
    marks = workspace.keep(fingerprints(docs, id_col, text, width), "fingerprints")
    classes = workspace.keep(marks.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = graph.components(links(classes.select("fp"), distance, cell_rows=cell_rows))
    of = workspace.keep(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    low = of.where("root <> fp").groupBy("root").agg(F.min("first").alias("low"))
    merged = of.join(low, "root", "left").select("fp", F.least("first", "low").alias("own"), "root", F.col("low").alias("low"))
    # the root itself is a member, and is not in `low`
    head = of.where("root = fp").select(F.col("fp").alias("root"), F.col("first").alias("head"))
    named = merged.join(head, "root", "left").select("fp", F.least("own", "low", "head").alias("component"))
    return marks.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")
