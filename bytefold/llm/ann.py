"""Approximate nearest neighbours by inner product: an adaptive dimension scan.

Equal vectors are one class that keeps its k + 1 smallest ids, which is all that any
query can use of it. A vector gets one more dimension, sqrt(M^2 - |x|^2) with M the
largest norm, so that the largest inner product is the smallest distance; then a random
rotation makes any leading columns a fair sample of it. Classes lie in the lists of a
coarse k-means; a query probes its nearest lists. In a probed list, columns are read
block by block: after each block a hypothesis test on the partial distance abandons the
candidates that are, almost surely, farther than the query's bound. Survivors get their
exact inner product in double precision on the original vectors.

The bound of a query is a score that k + 1 and a few more of the fitted sample reach. The
number of probed lists is the smallest that reaches RECALL on that sample, so clustered
vectors need few lists and structureless ones many. The sample has SAMPLE classes at
most (those of smallest hash); every vector is indexed.

A query that so found fewer than k while there are more asks every list without a bound,
so each gets min(k, candidates) rows.

Lists are dealt in blocks of candidates and of queries, both of bounded size, so one
common vector, list or query never meets in one task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the most common one. A row repeated with the same id and
vector counts once; null ids take no part; a query has no partner of its own id. Only
the id and vector columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytefold.llm import workspace

SAMPLE = 16_384
LIST_ROWS = 1024
MOST_LISTS = 1024
BLOCK = 4096
RECALL = 0.97
EPSILON = 2.1
COLUMNS = 16


class Space:
    """Augments and rotates vectors."""

    def __init__(self, dims: int, norm: float, seed: int = 7):
        self.dims, self.norm2 = dims, norm * norm * (1 + 1e-6)
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims + 1, dims + 1)))
        self.turn = (q * np.sign(np.diag(r))).astype(np.float32)

    def stored(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return np.concatenate([x, last[:, None]], axis=1).astype(np.float32) @ self.turn

    def asked(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.turn[:-1]

    def distance2(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The squared distance at which a stored vector has this inner product with x."""
        return (x * x).sum(1) + self.norm2 - 2 * score


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def kmeans(x: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    centre = x[r.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[r.choice(len(x), n)])
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_far(x[i : i + 4096], centre).argmin(1) for i in range(0, len(x), 4096))])


def spreads(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Each list's mean squared distance of members to their centre."""
    own = _nearest(x, centre)
    total = np.bincount(own, ((x - centre[own]) ** 2).sum(1), len(centre))
    return total / np.maximum(np.bincount(own, minlength=len(centre)), 1)


def promise(far: np.ndarray, spread: np.ndarray, dims: int) -> np.ndarray:
    """The squared distance that a list's nearest members may have: a tight list far off can hold nearer ones than a wide list close by."""
    return far + spread - 6 * np.sqrt(np.maximum(far, 0) * spread / dims)


def _calibrate(space: Space, raw: np.ndarray, centre: np.ndarray, spread: np.ndarray, k: int, recall: float) -> int:
    """How many lists must be probed for the recall, on the sample against brute force."""
    own = _nearest(space.stored(raw), centre)
    some = raw[:: max(1, len(raw) // 256)]
    score = some @ raw.T
    score[np.arange(len(some)), np.arange(0, len(raw), max(1, len(raw) // 256))[: len(some)]] = -np.inf
    top = np.argpartition(-score, min(k, len(raw) - 1), axis=1)[:, :k]
    rank = np.argsort(np.argsort(promise(_far(space.asked(some), centre), spread, space.dims), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel())
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1


def scan(space: Space, cand: np.ndarray, asked: np.ndarray, bound: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that no test abandons. bound: each query's score to reach, -inf for none."""
    c = space.stored(cand)
    q = space.asked(asked)
    limit = np.maximum(space.distance2(asked, np.where(np.isfinite(bound), bound, 0)), 0)
    limit = np.where(np.isfinite(bound), limit * (1 + 1e-5) + 1e-5 * space.norm2, np.inf)
    d = c.shape[1]
    cuts = [0, *range(columns, d - columns // 2, columns), d]
    out = []
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        part = _far(q[rows, : cuts[1]], c[:, : cuts[1]])
        qi, ci = np.nonzero(part * (d / cuts[1]) <= (limit[rows] * (1 + epsilon / math.sqrt(cuts[1])) ** 2)[:, None])
        left, qi = part[qi, ci], qi + at
        for a, b in zip(cuts[1:], cuts[2:], strict=False):
            step = q[qi, a:b] - c[ci, a:b]
            left = left + np.einsum("ij,ij->i", step, step)
            slack = (1 + epsilon / math.sqrt(b)) ** 2 if b < d else 1.0
            keep = left * (d / b) <= limit[qi] * slack
            qi, ci, left = qi[keep], ci[keep], left[keep]
        out.append((qi, ci))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of each query's `most` first rows by score, then id."""
    order = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < most]


def usable(vec: str) -> Column:
    return F.expr(f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vec}, x -> x <> 0)")


def search(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `query` (over id) holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable("vec") & F.col("id").isNotNull())
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return empty
    dims = sizes["d"]
    space = Space(dims, sizes["norm"])
    rows = rows.where(F.size("vec") == dims).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.reverse("vec"), F.lit(1))})
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(f"r <= {k + 1}")
    classes = workspace.keep(few.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec")), "classes")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("k1"), "k1", "k2").limit(SAMPLE).select("vec").toArrow()
    raw = _matrix(sample.column("vec"), dims)
    lists = int(min(max(total // LIST_ROWS, 1), MOST_LISTS, max(len(raw) // 16, 1)))
    centre = kmeans(space.stored(raw), lists)
    spread = spreads(space.stored(raw), centre)
    probes = _calibrate(space, raw, centre, spread, k, recall) if len(raw) > k + 1 else lists
    # an eighth more than the sample asked for, as the tests lose a few
    probes = min(lists, probes + probes // 8 + 1)
    shared = spark.sparkContext.broadcast((space, centre, spread, raw))  # bounded by MOST_LISTS and SAMPLE
    margin = k + 1 + max(8, k // 2)  # a test may lose some that reach the bound

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c, _, _ = shared.value
        for b in batches:
            own = _nearest(s.stored(_matrix(b.column(3), dims)), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["k1", "k2", "ids", "vec", "list"])

    placed = workspace.keep(classes.mapInArrow(place, "k1 long, k2 long, ids array<long>, vec array<double>, list int"), "placed")
    size = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # `lists` rows at most
    rows_of = np.array([size.get(i, 0) for i in range(lists)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c, wide, near = shared.value
        for b in batches:
            x = _matrix(b.column(2), dims)
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                score = part @ near.T
                bound = np.full(len(part), -np.inf)
                if len(near) > margin:
                    bound = -np.partition(-score, margin, axis=1)[:, margin] - 1e-9
                order = np.argsort(promise(_far(s.asked(part), c), wide, s.dims), axis=1)
                enough = (np.cumsum(rows_of[order], axis=1) < 4 * k).sum(1) + 1  # short lists: more of them
                many = np.minimum(np.maximum(probes, enough), lists)
                who = np.repeat(np.arange(len(part)), many)
                take = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                cols = [b.column(0).slice(at, len(part)).take(pa.array(who)), b.column(1).slice(at, len(part)).take(pa.array(who)), pa.array(order[who, take].astype(np.int32)), pa.array(bound[who])]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "list", "bound"])

    asking = rows.where(query).select("id", "k1", "k2").distinct()
    asked = classes.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vec")
    probing = workspace.keep(asked.mapInArrow(ask, "k1 long, k2 long, list int, bound double"), "probing")

    def meeting(probing: DataFrame) -> DataFrame:
        """(k1, k2, score, id): at most k + 1 of each class of queries and block of candidates."""
        load = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
        parts = spark.createDataFrame([(i, max(1, -(-size.get(i, 0) // BLOCK)), max(1, -(-load.get(i, 0) // BLOCK))) for i in range(lists)], "list int, cn int, qn int")
        parts = F.broadcast(parts)  # MOST_LISTS rows
        cand = placed.join(parts, "list").select("list", F.pmod("k1", "cn").cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), "ids", "vec")
        asks = probing.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("cn") - 1)).alias("cb"), F.pmod("k2", "qn").cast("int").alias("qb"), "k1", "k2", "bound")
        asks = asks.join(asked, ["k1", "k2"]).select("list", "cb", "qb", "k1", "k2", "bound", "vec")
        on = ("list", "cb", "qb")
        return cand.groupBy(*on).cogroup(asks.groupBy(*on)).applyInArrow(meet, "k1 long, k2 long, score double, id long")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = shared.value[0]
        c, x = _matrix(left.column("vec"), dims), _matrix(right.column("vec"), dims)
        names = ["k1", "k2", "score", "id"]
        if not len(c) or not len(x):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=names)
        qi, ci = scan(s, c, x, right.column("bound").to_numpy())
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[qi[i : i + 65536]], c[ci[i : i + 65536]]) for i in range(0, len(qi), 65536))])
        ids = left.column("ids").combine_chunks()
        flat, off = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        many = np.diff(off)[ci]
        who = np.repeat(np.arange(len(ci)), many)
        own = flat[np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + off[ci][who]]
        keep = _best(qi[who], score[who], own, k + 1)
        q = qi[who][keep]
        return pa.table([pa.array(right.column("k1").to_numpy()[q]), pa.array(right.column("k2").to_numpy()[q]), pa.array(score[who][keep]), pa.array(own[keep])], names=names)

    order = [F.desc("score"), F.asc("vec_id")]

    def first(found: DataFrame) -> DataFrame:
        ranked = found.withColumnRenamed("id", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order)))
        return ranked.where(f"r <= {k + 1}").drop("r")

    best = workspace.keep(first(meeting(probing)), "best")
    # whoever found fewer than there are asks every list, without a bound
    there = min(k + 1, classes.agg(F.sum(F.size("ids"))).first()[0] or 0)
    full = best.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= there)
    short = workspace.keep(asked.select("k1", "k2").join(full, ["k1", "k2"], "left_anti"), "short")
    if short.limit(1).count():
        every = short.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), F.lit(-math.inf).alias("bound"))
        again = first(meeting(workspace.keep(every, "again")))
        best = best.join(short, ["k1", "k2"], "left_anti").unionByName(again)
    out = best.join(asking, ["k1", "k2"]).where("id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("id", "k1", "k2").orderBy(*order)))
    return out.where(f"rank <= {k}").select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
