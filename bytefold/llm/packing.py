"""Best-fit packing of token pieces into sequences of a fixed capacity.

A length is one of `capacity` values, so the whole instance is a histogram of at most
`capacity` rows however large the corpus is. The driver solves that histogram: first
Martello-Toth dominance reduction, which fixes sets of one to three pieces that provably
dominate every other set holding their largest piece; then best-fit decreasing on what
is left. Both work with multiplicities, so the solution is a list of (pattern, count)
and its interval table depends on the capacity, not on the rows.

Pieces then find their place by rank among the pieces of their length. Ranks are dealt
in salted groups, of SALT_ROWS rows or of the square root of a length's pieces if that is
more, so a length that a third of the pieces share is many groups.

Nulls: a null text is an empty one (its only id is the separator); a null id keeps its
row. Repeated rows are packed each. Extra columns are not read. No rows: no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytefold.llm import workspace

CAPACITY = 2048
SALT_ROWS = 500
_encoders: dict = {}


def _encoder(name: str):
    """The byte-level BPE of a public vocabulary file, as a function from texts to id arrays.

    A .json file is read by `tokenizers`, as it is. Where a .tiktoken file holds the same merges, texts
    without any of the vocabulary's added tokens go through that, which is about four times as fast; the
    tests hold both to equal ids.
    """
    if name not in _encoders:
        import public_tokenizers as P

        if name.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(P.path(name))
            added = [x.content for x in t.get_added_tokens_decoder().values()]
            exact = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            twin = name.removesuffix(".json") + ".tiktoken"
            fast = _encoder(twin) if os.path.exists(P.path(twin)) else exact
            _encoders[name] = lambda text: exact(text) if any(x in text for x in added) else fast(text)
        else:
            import base64

            import tiktoken

            with open(P.path(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _encoders[name] = lambda text: e.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
    return _encoders[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document, in one pass without a shuffle."""
    kind = "id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cols: tuple = ([], [], [], [], [], [])
                for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.append(encode(t.as_py() or ""), np.uint32(end_id))
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        part = ids[s : s + n].astype("<u4")
                        for c, v in zip(cols, (d, k, s, n, zlib.crc32(part), part.view(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))[: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=[f.split()[0] for f in kind.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind)


Pattern = tuple[int, tuple[int, ...]]


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Dominance reduction of a histogram: fixed patterns and what is left.

    For a largest piece j, a set is fixed if every feasible set holding j can be exchanged for it:
    nothing else fits; the largest fitting k fills up exactly, or no two others fit, or no three
    others fit and k is no smaller than any fitting pair; or the pair (k, b) is best, and no two
    pieces larger than b other than k fit together.
    """
    left = {s: n for s, n in count.items() if n > 0}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                found = _dominant(left, j, capacity)
                if found is None:
                    break
                times = min(left[s] // found.count(s) for s in set(found))
                fixed.append((times, found))
                for s in found:
                    left[s] -= times
                changed = True
            if not left[j]:
                del left[j]
        left = {s: n for s, n in left.items() if n}
    return fixed, left


def _dominant(left: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    sizes = sorted(s for s, n in left.items() if n - (s == j) > 0 and s <= room)
    if not sizes:
        return (j,)
    k = sizes[-1]
    if k == room:
        return (j, k)
    own = {s: left[s] - (s == j) for s in sizes}

    def smallest(n: int, above: int = 0, without: int = 0) -> int | None:
        """Sum of the n smallest pieces larger than `above`, one of size `without` put aside."""
        total = 0
        for s in sizes[bisect_right(sizes, above) :]:
            m = min(own[s] - (s == without), n)
            total, n = total + m * s, n - m
            if not n:
                return total
        return None

    def fits(n: int, **more: int) -> bool:
        low = smallest(n, **more)
        return low is not None and low <= room

    if not fits(2):
        return (j, k)
    if fits(3):
        return None
    best, pair = 0, None
    for a in sizes:
        i = bisect_right(sizes, min(a, room - a)) - 1
        if i >= 0 and sizes[i] == a and own[a] < 2:
            i -= 1
        if i >= 0 and a + sizes[i] >= best:
            best, pair = a + sizes[i], (a, sizes[i])
    if k >= best:
        return (j, k)
    a, b = pair
    if a == k and not fits(2, above=b, without=k):
        return (j, a, b)
    return None


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: bins alike are one group."""
    groups: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for s in sorted(count, reverse=True):
        n = count[s]
        r = s
        while n and r <= capacity:
            while n and groups[r]:
                m, pattern = groups[r].pop()
                each = r // s
                full = min(m, n // each)
                if full:
                    groups[r - each * s].append((full, pattern + (s,) * each))
                    n, m = n - full * each, m - full
                if m and n:  # fewer than one bin's share are left
                    groups[r - n * s].append((1, pattern + (s,) * n))
                    n, m = 0, m - 1
                if m:
                    groups[r].append((m, pattern))
            r += 1
        each = capacity // s
        if n // each:
            groups[capacity - each * s].append((n // each, (s,) * each))
        if n % each:
            groups[capacity - n % each * s].append((1, (s,) * (n % each)))
    return [g for r in groups for g in r]


def solve(count: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_instance(count, capacity)
    return fixed + best_fit(left, capacity)


def intervals(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset) by length and rank."""
    rows, used, base = [], {}, 0
    for times, pattern in patterns:
        at = 0
        for s in pattern:
            rows.append((s, used.get(s, 0), base, at))
            used[s] = used.get(s, 0) + times
            at += s
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (a written table with id, piece, length, ...) with sequence_id and offset."""
    spark = found.sparkSession
    rows = found.groupBy("length").count().collect()  # at most `capacity` rows
    table = spark.sparkContext.broadcast(intervals(solve({r["length"]: r["count"] for r in rows}, capacity)))
    salts = {r["length"]: -(-r["count"] // max(SALT_ROWS, isqrt(r["count"]))) for r in rows}
    each = F.array(*[F.lit(salts.get(n, 1)) for n in range(capacity + 1)])  # by length
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.element_at(each, F.col("length").cast("int") + 1)).cast("int"))
    sums = salted.groupBy("length", "_salt").count()
    before = sums.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*[f"`{c}`" for c in found.columns], "_rank")
    n, names = ranked.columns.index("length"), found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            at = np.asarray(b.column(n)).astype(np.int64) << 44 | np.asarray(b.column(len(names)))
            i = np.searchsorted(key, at, side="right") - 1
            sequence = t[i, 2] + np.asarray(b.column(len(names))) - t[i, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sequence), pa.array(t[i, 3])], names=[*names, "sequence_id", "offset"])

    kind = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return ranked.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, its ids."""
    found = workspace.keep(pieces(docs, id_col, text, capacity, tokenizer, end_id, with_ids), "pieces")
    out = place(found, capacity)
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c != "id"])
