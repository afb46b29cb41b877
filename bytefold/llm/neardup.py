"""One document of each group of near copies: five-word shingles, similarity 0.8 or more.

SimHash fingerprints at 4 bits or fewer reach only the closest of such copies (about a
twentieth of the pairs at Jaccard 0.8 on the test corpus), so candidates come from two
sides: links of fingerprints on the popcount grid, and bands of shingle minima, which
miss a pair at 0.8 about once in 38,000 and closer ones less. Every candidate is verified by the exact Jaccard
similarity of the two shingle sets. Equal texts (after lower-casing, by word) are one
node from the start, so a copied text costs what any other does.

Within a band's bucket, a member is paired with its most alike earlier member and its
most alike member of all, judged by the shares of equal minima, if these allow 0.8 at
all. So a bucket emits at most two pairs a member and never its pairs. A large bucket is
dealt to several tasks in parts, and one member of each group of a part goes on to a
second round, read in blocks. These pairs only join most of a group cheaply. Once they are verified, each bucket whose members are still in
several groups proposes all its pairs across groups that the shares allow, so that every
such pair is either within one verified group or verified itself; a bucket's largest
group is dealt out in parts again, with the members outside it sent to each. The cells of the
popcount grid do the same with fingerprints at 4 bits or fewer.

Nulls: a null text has no words, and all texts without words are equal. A null id sorts
last among a group's rows. Of rows repeated with one id and text one stays. All columns
stay as they came. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm import graph, simhash, textkit, workspace

WIDTH = 5
SIMILARITY = 0.8
BANDS = 20
BAND = 4
ALLOW = 0.55  # estimates from 80 minima err by 0.045 at 0.8, so one in some 10**8 falls below
BLOCK = 2000

_rng = np.random.default_rng(99)
_TURN = _rng.integers(0, 2**64, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * BAND, dtype=np.uint64)


def _shingles(t: textkit.Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes with their documents, and a hash of each document's whole word sequence."""
    w = textkit.words(t)
    h = textkit.word_hashes(t, w)
    a, z, doc = textkit.spans_of(w, width)
    s = np.zeros(len(a), np.uint64)
    for k in range(width):
        s = textkit.mix(s * np.uint64(3) + h[np.minimum(a + k, z)])
    whole = w.count.astype(np.uint64)
    at = np.arange(len(h)) - w.first[w.doc]
    term = textkit.mix(h + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero(w.count)
    if len(some):
        whole[some] += np.add.reduceat(term, w.first[:-1][some])
    return s, doc, textkit.mix(whole)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, node, fp, bands array<long>, minima binary, n, set binary) for every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textkit.slices(b.column(1), 500_000):
                s, doc, node = _shingles(t, width)
                key = np.unique(doc.astype(np.uint64) << np.uint64(32) | s >> np.uint64(32))
                owner = (key >> np.uint64(32)).astype(np.int64)
                first = np.searchsorted(owner, np.arange(t.n + 1))
                small = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                fp = textkit.majority(textkit.bit_counts(textkit.mix(small.astype(np.uint64)), owner, t.n), np.diff(first))
                bands = np.zeros((t.n, BANDS), np.uint64)
                minima = np.zeros((t.n, BANDS * BAND), "<u4")
                if len(s):
                    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    for k in range(BANDS):
                        band = np.full(len(cuts), k, np.uint64)
                        for j in range(k * BAND, (k + 1) * BAND):
                            low = np.minimum.reduceat(s * _TURN[j] + _ADD[j], cuts)
                            minima[doc[cuts], j] = textkit.mix(low) >> np.uint64(32)
                            band = textkit.mix(band * np.uint64(5) + low)
                        bands[doc[cuts], k] = band
                off = pa.py_buffer((first * 4).astype(np.int32))
                sets = pa.BinaryArray.from_buffers(pa.binary(), t.n, [None, off, pa.py_buffer(small)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), lists, pa.array([m.tobytes() for m in minima], pa.binary()), pa.array(np.diff(first)), sets], names=["id", "node", "fp", "bands", "minima", "n", "set"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, node long, fp long, bands array<long>, minima binary, n long, set binary")


def _verify(pairs: DataFrame, size: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. Sizes that rule it out are not joined on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            like = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                like.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(like, pa.bool_())], names=["a", "b", "like"])

    pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    far = F.least("na", "nb") < similarity * F.greatest("na", "nb")
    pairs = workspace.keep(pairs.select("a", "b", far.alias("far")), "pairs")
    # only the sets that are needed go through the pair joins
    near = pairs.where("not far")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = workspace.within(workspace.keep(wanted, "wanted"))
    sets = workspace.keep(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("set").alias("set")), "sets")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    seen = workspace.keep(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, like boolean"), "verified")
    workspace.drop(pairs, sets)
    return seen.where("like").select("a", "b")


def _best_pairs(m: np.ndarray, allow: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its most alike earlier row and its most alike row of all: (i, j), and a root of each row's group."""
    n = len(m)
    ahead, any_, up, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for at in range(0, n, 64):
        same = (m[at : at + 64, None, :] == m[None, :, :]).mean(2)
        rows = np.arange(len(same))
        same[rows, rows + at] = -1
        any_[at : at + 64], top[at : at + 64] = same.argmax(1), same.max(1)
        same[np.arange(n)[None, :] > (rows + at)[:, None]] = -1
        ahead[at : at + 64], up[at : at + 64] = same.argmax(1), same.max(1)
    root = np.where(up >= allow, ahead, np.arange(n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    i = np.concatenate([np.flatnonzero(up >= allow), np.flatnonzero(top >= allow)])
    j = np.concatenate([ahead[up >= allow], any_[top >= allow]])
    return i, j, root


def _pairs_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, value, salt, salts, node, minima) sorted by bucket in; pairs out, and of a bucket in parts a member of each group, without a partner."""

    def solve(node: np.ndarray, m: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        i, j, root = _best_pairs(m, ALLOW)
        return out(np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), np.unique(root)

    def out(a: np.ndarray, b: np.ndarray | None, key: tuple = (0, 0)) -> pa.RecordBatch:
        cols = [np.full(len(a), key[0]), np.full(len(a), key[1]), a]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["band", "value", "a", "b"])

    def end(key: tuple, node: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(node) > 1:
            found, roots = solve(node, m)
            yield found
            node = node[roots]
        if key[3] > 1:
            yield out(node, None, key)

    key, node, m = None, np.zeros(0, np.int64), np.zeros((0, BANDS * BAND), np.uint32)
    for x in batches:
        keys = np.stack([np.asarray(x.column(k)).astype(np.int64) for k in range(4)], axis=1)
        nodes = np.asarray(x.column(4)).astype(np.int64)
        rows = np.frombuffer(b"".join(x.column(5).to_pylist()), "<u4").reshape(-1, BANDS * BAND)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(nodes)], strict=True):
            if a == z:
                continue
            if key is not None and tuple(keys[a]) != key:
                yield from end(key, node, m)
                node, m = node[:0], m[:0]
            key = tuple(keys[a])
            for at in range(a, z, BLOCK):
                node, m = np.append(node, nodes[at : min(z, at + BLOCK)]), np.concatenate([m, rows[at : min(z, at + BLOCK)]])
                if len(node) >= BLOCK:
                    found, roots = solve(node, m)
                    yield found
                    node, m = node[roots], m[roots]
    if key is not None:
        yield from end(key, node, m)


def _in_buckets(live: DataFrame) -> DataFrame:
    return live.repartition("band", "value", "salt").sortWithinPartitions("band", "value", "salt", "node").mapInArrow(_pairs_of_buckets, "band long, value long, a long, b long")


def _banded(rows: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of the buckets `shared` (band, value, m rows); a bucket beyond BLOCK rows is solved in parts first."""
    minima = nodes.select("node", "minima")
    salted = rows.join(shared, ["band", "value"]).withColumn("salts", F.ceil(F.col("m") / BLOCK))
    salted = salted.select("band", "value", F.expr("pmod(xxhash64(node), salts)").alias("salt"), "salts", "node").join(minima, "node")
    found = workspace.keep(_in_buckets(salted.select("band", "value", "salt", "salts", "node", "minima")), "parts")
    heads = found.where("b is null").select("band", "value", F.col("a").alias("node"))
    pairs = found.where("b is not null").select("a", "b")
    if not heads.limit(1).count():
        return pairs
    again = heads.select("band", "value", F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("salts"), "node").join(minima, "node")
    return pairs.unionByName(_in_buckets(again.select("band", "value", "salt", "salts", "node", "minima")).where("b is not null").select("a", "b"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, key, salt, asks, node, root, main, fp) sorted by the first four in; pairs out of a row that asks and one that answers, of different roots and with fingerprints at 4 bits or fewer."""

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All buckets in cols are whole; rows that answer come before those that ask."""
        keys, asks, node, root, main, last = cols
        new = np.append(True, (keys[1:] != keys[:-1]).any(1))
        first = np.flatnonzero(new)
        bucket = np.cumsum(new) - 1
        answers = np.add.reduceat(~asks, first).astype(np.int64)
        i = np.flatnonzero(asks)
        each = answers[bucket[i]]
        # askers in runs that have at most some 100,000 pairs
        run = np.cumsum(each) // 100_000
        for part in np.split(i, np.flatnonzero(np.diff(run)) + 1):
            n = answers[bucket[part]]
            for step in range(0, int(n.max(initial=0)), 100_000):
                m = np.clip(n - step, 0, 100_000)
                p = np.repeat(part, m)
                q = first[bucket[p]] + step + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
                # two rows outside the largest group both ask: one of them is enough
                ok = (root[p] != root[q]) & ((main[p] == root[q]) | (node[p] < node[q]))
                p, q = p[ok], q[ok]
                ok = np.bitwise_count(last[p] ^ last[q]) <= 4
                p, q = node[p[ok]], node[q[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for x in batches:
        if not x.num_rows:
            continue
        cols = [
            np.stack([np.asarray(x.column(k)).astype(np.int64) for k in range(3)], axis=1),
            x.column(3).to_numpy(zero_copy_only=False).astype(bool),
            *(np.asarray(x.column(k)).astype(np.int64) for k in (4, 5, 6)),
            np.asarray(x.column(7)).view(np.uint64),
        ]
        if rest is not None:
            cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
        keys = cols[0]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        whole = int(cuts[-1]) if len(cuts) else 0
        if whole:
            yield from solve([c[:whole] for c in cols])
        rest = [c[whole:] for c in cols]
    if rest is not None:
        yield from solve(rest)


def _joining(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, key, salt, asks, node, root, main, minima, set) sorted by the first four in; verified links that join two groups out."""

    def solve(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        asks, node, root, main = (np.concatenate([np.asarray(x.column(k).to_numpy(zero_copy_only=False)) for x in part]).astype(np.int64) for k in (3, 4, 5, 6))
        minima = np.frombuffer(b"".join(v for x in part for v in x.column(7).to_pylist()), "<u4").reshape(-1, BANDS * BAND)
        sets = [np.frombuffer(v.as_buffer(), "<u4") for x in part for v in x.column(8)]
        n = int((asks == 0).sum())
        size = np.array([len(v) for v in sets])
        ends = np.cumsum(size[:n])
        starts = ends - size[:n]
        names, own = np.unique(np.concatenate([np.zeros(0, "<u4"), *sets[:n]]), return_inverse=True)
        mark, group = np.zeros(len(names) + 1, dtype=bool), root.copy()
        out: list[tuple[int, int]] = []
        for i in range(n, len(node)):
            # two rows outside the largest group both ask: one of them is enough
            ok = (group[:n] != group[i]) & ((root[:n] == main[0]) | (node[i] < node[:n]))
            ok &= np.minimum(size[:n], size[i]) >= similarity * np.maximum(size[:n], size[i]) - 1e-9
            j = np.flatnonzero(ok)
            j = j[(minima[j] == minima[i]).mean(1) >= ALLOW] if len(j) else j
            if not len(j):
                continue
            at = np.minimum(np.searchsorted(names, sets[i]), len(names) - 1)
            mine = at[names[at] == sets[i]]
            mark[mine] = True
            if len(j) * 8 < n:
                both = np.array([mark[own[starts[k] : ends[k]]].sum() for k in j])
            else:
                run = np.append(0, np.cumsum(mark[own]))
                both = run[ends[j]] - run[starts[j]]
            mark[mine] = False
            for k in j[both >= similarity * (size[j] + size[i] - both) - 1e-9]:
                if group[k] != group[i]:
                    out.append((min(node[i], node[k]), max(node[i], node[k])))
                    group[group == group[i]] = group[k]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    key, part = None, []
    for x in batches:
        keys = np.stack([np.asarray(x.column(k)).astype(np.int64) for k in range(3)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == z:
                continue
            if part and tuple(keys[a]) != key:
                yield solve(part)
                part = []
            key = tuple(keys[a])
            part.append(x.slice(a, z - a))
    if part:
        yield solve(part)


def _mixed(rows: DataFrame, keys: list[str], last: DataFrame, run: Callable) -> DataFrame:
    """Buckets of rows (keys, node, root) in several groups, handed to run with the columns of last (node, ...).

    The rows outside a bucket's largest group ask all rows of the bucket, which are dealt in parts.
    """
    sizes = rows.groupBy(*keys, "root").agg(F.count("*").alias("n")).groupBy(*keys)
    several = sizes.agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("m"), F.count("*").alias("groups")).where("groups > 1")
    several = several.select(*keys, "main", F.ceil(F.col("m") / BLOCK).alias("salts"))
    some = workspace.keep(rows.join(workspace.within(workspace.keep(several, "several")), keys), "mixed")
    if "set" in last.columns:
        wanted = workspace.keep(some.select("node").distinct(), "wanted")
        last = last.join(workspace.within(wanted), "node", "left_semi").groupBy("node").agg(*[F.min(c).alias(c) for c in last.columns if c != "node"])
    # dealt out after the join, in which a row that asks many parts is one row
    own = "struct(pmod(xxhash64(node), salts) as salt, false as asks)"
    parts = F.explode(F.expr(f"if(root <> main, concat(array({own}), transform(sequence(0L, salts - 1), s -> struct(s as salt, true as asks))), array({own}))"))
    both = some.join(last, "node").withColumn("part", parts).select(*keys, "part.salt", "part.asks", "node", "root", "main", *last.columns[1:])
    return both.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", "asks", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) verified links among nodes (a written table: node, fp, bands, minima, n; one row a node). sets: (node, set), perhaps repeated."""
    fps = workspace.keep(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fps")
    near = simhash.links(fps.select("fp"))
    hub = lambda c: fps.toDF(c, f"hub_{c}")
    pairs = near.join(hub("a"), "a").join(hub("b"), "b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    pairs = pairs.unionByName(nodes.join(fps, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("m")).where("m > 1")
    banded = _banded(rows, shared, nodes)
    every = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(banded).distinct()
    every = workspace.keep(every, "tried")
    first = workspace.keep(_verify(every, nodes.select("node", "n"), sets, similarity), "first")
    groups = graph.components(first)
    rooted = lambda x: x.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    crowded = rooted(rows.join(shared.select("band", "value"), ["band", "value"]))
    joined = workspace.keep(_mixed(crowded, ["band", "value"], nodes.select("node", "minima").join(sets, "node"), lambda b: _joining(b, similarity)), "joined")
    # the forest of fingerprints loses pairs when its own links fail: all of a cell's pairs across groups, equal fingerprints included
    groups = graph.components(first.unionByName(joined))
    rooted = lambda x: x.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dims = simhash._cells(nodes.select("fp").distinct(), 4, 6).select("c", "k", "fp")
    cells = rooted(nodes.select("node", "fp")).join(dims, "fp").select("c", "k", "node", "root")
    across = _mixed(cells, ["c", "k"], nodes.select("node", "fp"), _across)
    more = workspace.keep(across.distinct().join(every, ["a", "b"], "left_anti"), "more")
    return first.unionByName(joined).unionByName(_verify(more, nodes.select("node", "n"), sets, similarity))


def surplus(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (id, node, n) of rows that are not the one to stay of their group, and of ids that have several such rows to thin to one."""
    marks = workspace.keep(sketches(docs, id_col, text, width), "sketches")
    nodes = workspace.keep(marks.groupBy("node").agg(F.min_by(F.struct("fp", "bands", "minima", "n"), "fp").alias("x")).select("node", "x.*"), "nodes")
    roots = graph.components(links(nodes, marks.select("node", "set"), similarity))
    last = F.coalesce(F.col("id"), F.lit(2**63 - 1))
    rows = marks.select("id", "node").join(roots, "node", "left").select("id", "node", last.alias("last"), F.coalesce("root", "node").alias("root"))
    # of one id with several texts in a group, the text of smallest node stays; joined by row, not by group
    heads = rows.groupBy("root").agg(F.min(F.struct("last", "node")).alias("head")).select("head.last", "head.node")
    gone = rows.join(heads, ["last", "node"], "left_anti").select("id", "node").distinct()
    twice = rows.groupBy("id", "node").agg(F.count("*").alias("m")).where("m > 1")
    out = workspace.keep(gone, "gone"), workspace.keep(twice, "twice")
    workspace.drop(marks, nodes)
    return out


def distinct(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """docs without all but one row of each group."""
    gone, twice = surplus(docs, id_col, text, similarity, width)
    from pyspark.sql import types as T

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = [np.zeros(0, np.uint64), *(_shingles(t, width)[2] for t in textkit.slices(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(node).view(np.int64))], names=["row", "id", "node"])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("id", T.LongType()), T.StructField("node", T.LongType())]))
    same = lambda other: rows["id"].eqNullSafe(other["id"]) & (rows["node"] == other["node"])
    kept = rows.join(workspace.within(gone), same(gone), "left_anti")
    if twice.limit(1).count():
        # rows repeated with one id and text: all but one go
        rows = kept
        few = rows.join(twice, same(twice), "left_semi").groupBy("id", "node").agg(F.first("row").alias("row"))
        kept = rows.join(twice, same(twice), "left_anti").select("row").unionByName(few.select("row"))
    return kept.select("row.*")
