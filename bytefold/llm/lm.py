"""N-gram language-model scores from log-frequency Bloom filters of all n-grams, dealt by hash.

Filters. Texts are cut into slices. A slice sends its distinct words, bigrams and trigrams
(hashes, with their counts in training texts) to shards, a shard being a range of
hashes. A shard adds up the training counts, puts every n-gram with its quantised count
into a Bloom filter of (n-gram, level) pairs sized for what it holds, and answers every
slice that asked by repeated membership probes, in the order of its keys; the slice then
scores its texts. So every n-gram that occurs in training at least `least` times (1 by
default: all of them) is in the model at every corpus size. A filter of all n-grams grows
with the corpus and has no bound to broadcast it under, so the probes go to its shards
instead; shards grow in number with the tokens and the driver gets three numbers.
Unigram counts are answered exactly, since the base score needs them exact.

Sizes. Within a shard a bigram or trigram is 32 bits, so of up to SHARD_TOKENS distinct
ones at most one in 4,000 shares its hash with another, at every corpus size; words have
64 bits. A slice's sorted keys travel as differences by byte, compressed: some three
bytes a key. A key that all slices share costs a shard one entry a slice of SLICE bytes.

Levels. A bigram's or trigram's count c enters as its level 1+floor(log_b(c/least)): the
lower edge of a level serves as the count, the upper edge as the denominator, so the
interpolated probabilities never sum above one but by a filter's false positives (one
probe in 65,000).

Nulls: a null text is empty (one end token); a null id is a training row. Repeated rows
count and are scored each. Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.llm import textkit, workspace

LEAST = 1
SLICE = 4_000_000
SHARD_TOKENS = 1_000_000
LEVEL = 1.5
PROBES = 16
ORDER = 3
PRIOR = 20.0
END = np.uint64(0xE1D0E1D0E1D0E1D1)
START = np.uint64(0x57A2757A2757A271)
_STEP = 0x9E3779B97F4A7C15


class LogBloom:
    """A Bloom filter of (n-gram, level) pairs."""

    def __init__(self, least: int, level: float = LEVEL, probes: int = PROBES):
        self.least, self.level, self.probes = least, level, probes
        self.size, self.bits = np.uint64(64), np.zeros(8, np.uint8)

    def _where(self, keys: np.ndarray, k: int) -> np.ndarray:
        step = np.uint64(_STEP * k % 2**64) * (keys & np.uint64(0xFFFFFFFF) | np.uint64(1))
        return (keys + step >> np.uint64(32)) * self.size >> np.uint64(32)

    def _at(self, keys: np.ndarray, level: int) -> np.ndarray:
        return textkit.mix(keys + np.uint64(_STEP * level % 2**64))

    def levels(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(counts / self.least) / math.log(self.level) + 1e-9).astype(np.int64)

    def fill(self, keys: np.ndarray, counts: np.ndarray) -> LogBloom:
        """Holds these n-grams, each at its level and all below, and is sized for them."""
        q = self.levels(counts)
        size = max(64, int(int(q.sum()) * self.probes / math.log(2)) + 1)
        if size >> 32:
            raise ValueError("too many n-grams for one filter: use more shards")
        self.size = np.uint64(size)
        set_ = np.zeros(size, dtype=bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            at = self._at(keys[q >= level], level)
            for k in range(self.probes):
                set_[self._where(at, k)] = True
        self.bits = np.packbits(set_, bitorder="little")
        return self

    def level_of(self, keys: np.ndarray) -> np.ndarray:
        """The highest level found of each key; 0 if it is no member."""
        out = np.zeros(len(keys), np.int64)
        live, level = np.arange(len(keys)), 1
        while len(live):
            at = self._at(keys[live], level)
            for k in range(self.probes):
                i = self._where(at, k)
                hit = (self.bits[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                live, at = live[hit], at[hit]
                if not len(live):
                    break
            out[live] = level
            level += 1
        return out

    def lower(self, level: np.ndarray) -> np.ndarray:
        """Lower edge of the counts of a level; 0 for level 0."""
        return np.where(level > 0, np.ceil(self.least * self.level ** (level - 1.0) - 1e-6), 0.0)

    def upper(self, level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, self.least * self.level**level, 0.0)


def _tokens(t: textkit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens, an end after each document's words, and each document's first token (n + 1)."""
    w = textkit.words(t)
    h = textkit.word_hashes(t, w)
    first = w.first + np.arange(t.n + 1)
    out = np.full(len(h) + t.n, END, np.uint64)
    out[np.arange(len(h)) + w.doc] = h
    return out, first


def _back(x: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The token n places before each; the start mark before a document's first."""
    out = np.full(len(x), START, np.uint64)
    out[n:] = x[: len(x) - n]
    for k in range(n):
        at = first[:-1] + k
        out[at[at < first[1:]]] = START
    return out


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return textkit.mix(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _grams(x: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order (3 at most) the keys of the n-grams and the tokens they end at; a trigram has two words at least."""
    one = _back(x, first, 1)
    out = [(x, np.arange(len(x))), (_pair(one, x), np.arange(len(x)))]
    at = np.flatnonzero(one != START)
    out.append((_pair(_pair(_back(x, first, 2)[at], one[at]), x[at]), at))
    return out[:order]


def _unique(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of `wide` bits, sorted, and each key's place among them."""
    n = len(keys)
    low = max(1, n.bit_length())
    if not n or wide + low > 64:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << np.uint64(low) | np.arange(n, dtype=np.uint64))
    key, at = both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)
    new = np.append(True, key[1:] != key[:-1])
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return key[new], inverse


def _distinct(g: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams of k + 1 words: the shard of each distinct key, the rest of the key, and each n-gram's place. Sorted by both."""
    wide = 32 + bits if k else 64
    keys, inverse = _unique(g >> np.uint64(64 - wide), wide)
    return (keys >> np.uint64(wide - bits)).astype(np.int64), keys & np.uint64((1 << (wide - bits)) - 1), inverse


def _planes(x: np.ndarray, wide: int) -> np.ndarray:
    """Numbers by byte, highest first: what they share compresses."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - wide :].T


def _numbers(by: np.ndarray) -> np.ndarray:
    out = np.zeros((by.shape[1], 8), np.uint8)
    out[:, 8 - len(by) :] = by.T
    return out.view(">u8").ravel().astype(np.uint64)


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _large(blob: pa.Buffer | bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size, codec="zstd"), np.uint8)


def _ask(keys: np.ndarray, counts: np.ndarray, k: int) -> bytes:
    """Sorted keys of one shard with their counts."""
    return _small(np.concatenate([_planes(np.diff(keys, prepend=np.uint64(0)), 4 if k else 8), _planes(counts, 4)]))


def _asked_for(blob: pa.Buffer | bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = _large(blob, n * (8 if k else 12)).reshape(-1, n)
    return np.cumsum(_numbers(by[:-4]), dtype=np.uint64), _numbers(by[-4:])


def _slices(src: DataFrame) -> DataFrame:
    """(slice, ids, training, sizes, texts, tokens, learned): the rows of src in slices, texts as their compressed bytes; learned: tokens of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for t in textkit.slices(b.column(1), SLICE):
                count = textkit.words(t).count + 1
                train = b.column(2).slice(t.first, t.n)
                learned = count[train.fill_null(False).to_numpy(zero_copy_only=False)].sum()
                lists = [pa.ListArray.from_arrays(pa.array([0, t.n], pa.int32()), x) for x in (b.column(0).slice(t.first, t.n), train, pa.array(np.diff(t.offsets)))]
                yield pa.RecordBatch.from_arrays([pa.array([name]), *lists, pa.array([_small(t.data)], pa.binary()), pa.array([int(count.sum())]), pa.array([int(learned)])], names=["slice", "ids", "training", "sizes", "texts", "tokens", "learned"])
                name += 1

    return src.select("id", "text", "training").mapInArrow(run, "slice long, ids array<long>, training array<boolean>, sizes array<long>, texts binary, tokens long, learned long")


def _texts(sizes: pa.Array, blob: pa.Buffer) -> textkit.Texts:
    offsets = np.append(np.int64(0), np.cumsum(sizes.to_numpy(zero_copy_only=False)))
    return textkit.Texts(0, _large(blob, int(offsets[-1])) if offsets[-1] else np.zeros(0, np.uint8), offsets)


def _only(lists: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """The values of each list of a column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    for k in range(len(lists)):
        yield lists.slice(k, 1).flatten()


def _asked(slices: DataFrame, order: int, bits: int) -> DataFrame:
    """(shard, slice, n, keys): what each slice asks of each shard; a shard is an order and the leading bits of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, train, sizes, blob in zip(b.column(0).to_pylist(), _only(b.column(1)), _only(b.column(2)), b.column(3), strict=True):
                x, first = _tokens(_texts(sizes, blob.as_buffer()))
                weight = np.repeat(train.fill_null(False).to_numpy(zero_copy_only=False), np.diff(first))
                for k, (g, at) in enumerate(_grams(x, first, order)):
                    shard, keys, inverse = _distinct(g, k, bits)
                    n = np.bincount(inverse, weight[at], len(keys)).astype(np.uint64)
                    cuts = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
                    spans = list(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False))
                    blobs = pa.array([_ask(keys[i:j], n[i:j], k) for i, j in spans], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts - 1] + (k << bits)), pa.array(np.full(len(cuts), name)), pa.array([j - i for i, j in spans], pa.int64()), blobs], names=["shard", "slice", "n", "keys"])

    return slices.select("slice", "training", "sizes", "texts").mapInArrow(run, "shard long, slice long, n long, keys binary")


def _answered(asked: DataFrame, bits: int, least: int) -> DataFrame:
    """(shard, slice, n, values, distinct): the keys' training counts (of words, 8 bytes) or levels (1 byte); a row without a slice has the number of a shard's keys in training."""

    def solve(shard: int, slices: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, inverse = _unique(np.concatenate([k for k, _ in parts]), 32 if shard >> bits else 64)
        n = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
        if shard >> bits:
            member = n >= least
            model = LogBloom(least).fill(keys[member], n[member])
            values = model.level_of(keys).astype(np.uint8)[inverse]
        else:
            values = n[inverse]
        sizes = [len(k) for k, _ in parts]
        cuts = np.cumsum([0, *sizes])
        blobs = [_small(_planes(values[a:z], 8) if values.itemsize > 1 else values[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        m = len(parts)
        return pa.RecordBatch.from_arrays([pa.array([shard] * (m + 1)), pa.array([*slices, None], pa.int64()), pa.array([*sizes, None], pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([*[None] * m, int((n > 0).sum())], pa.int64())], names=["shard", "slice", "n", "values", "distinct"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slices, parts = None, [], []
        for b in batches:
            for s, name, n, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if s != shard and parts:
                    yield solve(shard, slices, parts)
                    slices, parts = [], []
                shard = s
                slices.append(name)
                parts.append(_asked_for(keys.as_buffer(), n, s >> bits))
        if parts:
            yield solve(shard, slices, parts)

    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, slice long, n long, values binary, distinct long")


def _score(x: np.ndarray, first: np.ndarray, counts: np.ndarray, levels: list[np.ndarray], docs: int, norm: float, least: int) -> np.ndarray:
    """For each token the log10 of its probability. levels: of the bigrams and trigrams that end at each token."""
    scale = LogBloom(least)
    one = _back(x, first, 1)
    start = one == START
    c1 = np.append(np.int64(0), counts[:-1])
    c1 = np.where(start, docs, np.where(c1 >= least, c1, 0)).astype(float)
    p = (counts + 1.0) / 10.0**norm
    if levels:
        w2, top2 = c1 / (c1 + PRIOR), np.zeros(len(x))
        np.divide(scale.lower(levels[0]), c1, out=top2, where=c1 > 0)
        p = w2 * np.minimum(top2, 1) + (1 - w2) * p
    if len(levels) > 1:
        # the level of the bigram that ends at the word before; none across a start
        was = np.where(start, 0, np.append(np.int64(0), levels[0][:-1]))
        high = scale.upper(was)
        w3, three = high / (high + PRIOR), np.zeros(len(x))
        np.divide(scale.lower(levels[1]), high, out=three, where=high > 0)
        p = w3 * np.minimum(three, 1) + (1 - w3) * p
    return np.log10(p)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", entries: int | None = None, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) for every document.

    training: a boolean column of docs; its true rows are learned from. least: the lowest count of an
    n-gram in the model, at any corpus size; entries: if given, least is the training tokens / entries.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), training.alias("training"))
    slices = workspace.keep(_slices(src), "slices")
    size = slices.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.coalesce(F.sum(F.expr("size(filter(training, x -> x))")), F.lit(0)).alias("docs")).first()
    tokens, n_docs = int(size["learned"]), int(size["docs"])
    if entries is not None:
        least = max(1, -(-tokens // entries))
    bits = max(5, (int(size["n"]) // SHARD_TOKENS).bit_length())
    answers = workspace.keep(_answered(_asked(slices, order, bits), bits, least), "answers")
    workspace.release(docs.sparkSession)
    # the words of training: one number a shard
    distinct = answers.where(F.col("slice").isNull() & (F.col("shard") < 1 << bits)).agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()["v"]
    norm = math.log10(tokens + int(distinct) + 1)
    kind = "id long, training boolean, n_tokens long, known long, base double, model double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in kind.split(", ")]
        ids, train, sizes = (next(_only(left.column(c))) for c in ("ids", "training", "sizes"))
        t = _texts(sizes, left.column("texts")[0].as_buffer())
        x, first = _tokens(t)
        shard, n, blobs = right.column("shard").to_numpy(), right.column("n").to_numpy(), right.column("values")
        rows, found = np.argsort(shard), []
        for k, (g, at) in enumerate(_grams(x, first, order)):
            # shards are ranges of keys, so their answers in order are those of the sorted keys
            mine = [_large(blobs[i].as_buffer(), int(n[i]) * (1 if k else 8)) for i in rows.tolist() if shard[i] >> bits == k]
            values = [(v if k else _numbers(v.reshape(8, -1))).astype(np.int64) for v in mine]
            of = np.zeros(len(x), np.int64)
            if len(g):
                of[at] = np.concatenate(values)[_distinct(g, k, bits)[2]]
            found.append(of)
        lp = _score(x, first, found[0], found[1:], n_docs, norm, least)
        doc = np.repeat(np.arange(t.n), np.diff(first))
        total = lambda v: np.bincount(doc, v, t.n)
        cols = [ids, train, pa.array(np.diff(first)), pa.array(total(found[0] > 0).astype(np.int64)), pa.array(total(np.log10(found[0] + 1.0))), pa.array(total(lp))]
        return pa.Table.from_arrays(cols, names=names)

    own = slices.select("slice", "ids", "training", "sizes", "texts").groupBy("slice")
    scored = own.cogroup(answers.where("slice is not null").select("slice", "shard", "n", "values").groupBy("slice")).applyInArrow(run, kind)
    return scored.select(
        F.col("id").alias(id_col),
        "training",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        F.col("model").alias("score"),
    )
