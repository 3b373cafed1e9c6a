"""Language-model scores by context-tree weighting over bytes.

A text is its bytes with A-Z lower-cased, then an end symbol. Every byte is eight binary
choices, and each choice has a context tree over the preceding DEPTH bytes. At a node the
Krichevsky-Trofimov estimate is mixed, half and half, with the product of the nodes one
byte deeper; after training the counts are frozen, so a text's probability is the
product of the mixtures along its paths (a proper distribution over texts).

How it is spread: texts are dealt into blocks of about BLOCK_BYTES by a hash of key and
text. A block lists each different word and each different (context, byte) once, with its
count in training texts. Counts are summed by key. Keys that share SPLIT context bytes are
one group; a task takes groups from a sorted stream, a few at a time, and hands on the
nodes of SPLIT bytes. What is above goes up a level by combined sums, and only the nodes
of one and of no context byte (65,280 at most) are finished on the driver. Each group is
told the nodes of its last two bytes, as a line in the probability from below. A group's
counts are held while the blocks that ask for them stream by. Values go back to those
blocks, and meet their texts there: no vocabulary or model is broadcast, and all of what
is gathered grows with the corpus.

Defined results: null is empty: one token, the end; rows are documents, so repeated rows
each get a row and count each; without training texts every count is 0; an empty table
gives an empty result; words are compared by 64-bit hashes; no other column is read; null
and repeated keys are dealt by their texts; a long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE_LOWER, NOT_SPACE, Scratch, chunks, partitions, prefix_hash, span_hash, text_buffer, words

DEPTH = 5  # context bytes; a key packs them and the byte itself in a long, so 7 is the most
SPLIT = 3  # context bytes that a group shares
#: Keys that a task works on at once, if no group has more.
GROUP_KEYS = 100_000
BLOCK_BYTES = 24 << 20
#: Blocks that a task has at most on average.
BLOCKS_OF_TASK = 4
#: Stands for the end among the words' hashes.
_END_WORD = 0
SMOOTH = 0.1
_END, _START = 0xFF, 0xFE  # neither occurs in UTF-8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HALF = np.log(0.5)


def keys_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((context, byte) packed for each byte and end, offsets of n+1 texts in it)."""
    n = len(off) - 1
    at = off + (DEPTH + 1) * np.arange(n + 1)
    a = np.full(at[-1], _START, np.int64)
    doc = np.repeat(np.arange(n), np.diff(off))
    a[np.arange(len(buf)) + (DEPTH + 1) * doc + DEPTH] = _LOWER[buf]
    a[at[1:] - 1] = _END
    key = a.copy()
    for d in range(1, DEPTH + 1):
        key[DEPTH:] |= a[DEPTH - d : len(a) - d] << (8 * d)
    real = np.ones(len(a), bool)
    for d in range(DEPTH):
        real[at[:-1] + d] = False
    return key[real], off + np.arange(n + 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series seven places up."""
    y = x + 7.0
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
    below = np.zeros_like(y)
    for i in range(7):
        below += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - below


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: code is context << 8 | bits so far (with a leading one)."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.code, inverse = np.unique(code, return_inverse=True)
        total = lambda v: np.bincount(inverse, weights=v, minlength=len(self.code))
        self.zeros, self.ones = total(zeros), total(ones)
        own = log_kt(self.zeros, self.ones) if len(self.code) else np.zeros(0)
        self.log_pw = own if below is None else np.logaddexp(_HALF + own, _HALF + total(below))
        self.weight = np.ones(len(self.code)) if below is None else np.exp(_HALF + own - self.log_pw)

    def mix(self, code: np.ndarray, bit: np.ndarray, deeper: np.ndarray | float) -> np.ndarray:
        """Probability of the bit at these nodes; a node that was never seen is even."""
        if not len(self.code):
            return np.full(len(code), 0.5)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        seen = self.code[at] == code
        count = np.where(bit, self.ones[at], self.zeros[at])
        kt = (count + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        w = self.weight[at]
        return np.where(seen, w * kt + (1 - w) * deeper, 0.5)


def _choices(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits so far, bit) of the eight choices of each byte: bytes x 8."""
    level = np.arange(8)
    return (1 << level) | (byte[:, None] >> (8 - level)), (byte[:, None] >> (7 - level)) & 1


class Trees:
    """The levels from DEPTH down to SPLIT bytes of context, of whole groups of keys."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        key, n = key[n > 0], n[n > 0].astype(float)
        sofar, bit = _choices(key & 0xFF)
        code = (((key >> 8)[:, None] << 8) | sofar).ravel()
        w, bit = np.repeat(n, 8), bit.ravel()
        zeros, ones, below = w * (1 - bit), w * bit, None
        self.levels = []
        for d in range(DEPTH, SPLIT - 1, -1):
            level = Level(code, zeros, ones, below)
            self.levels.append(level)
            code = (((level.code >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8) | (level.code & 0xFF)
            zeros, ones, below = level.zeros, level.ones, level.log_pw

    def probability(self, key: np.ndarray, above: Above) -> np.ndarray:
        """log10 of the mixed probability of each key's byte."""
        sofar, bit = _choices(key & 0xFF)
        sofar, bit = sofar.ravel(), bit.ravel().astype(bool)
        context = np.repeat(key >> 8, 8)
        p: np.ndarray | float = 0.5
        for d, level in zip(range(DEPTH, SPLIT - 1, -1), self.levels, strict=True):
            p = level.mix(_at(context, d) | sofar, bit, p)
        return np.log10(above.mix(context, sofar, bit, p)).reshape(-1, 8).sum(1)


def _at(context: np.ndarray, d: int) -> np.ndarray:
    """The code of a node of d context bytes, without the bits so far."""
    return (context & ((1 << (8 * d)) - 1)) << 8


class Upper:
    """The levels of one and of no context byte, from at most 256 * 255 summed rows."""

    def __init__(self, rows: list):
        code, zeros, ones, below = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, float, float, float)))
        one = Level(code, zeros, ones, below)
        self.levels = [one, Level(one.code & 0xFF, one.zeros, one.ones, one.log_pw)]

    def mix(self, context: np.ndarray, sofar: np.ndarray, bit: np.ndarray, p: np.ndarray | float) -> np.ndarray:
        for d, level in zip((1, 0), self.levels, strict=True):
            p = level.mix(_at(context, d) | sofar, bit, p)
        return p


class Above:
    """The levels of two bytes and less as seen from nodes of two bytes: for each bit a line, base + slope * (probability from below)."""

    def __init__(self, code: np.ndarray, base0: np.ndarray, base1: np.ndarray, slope: np.ndarray, upper: Upper):
        self.code, at = np.unique(code, return_index=True)
        self.base, self.slope, self.upper = np.stack([base0[at], base1[at]]), slope[at], upper

    def mix(self, context: np.ndarray, sofar: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        code = _at(context, 2) | sofar
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1) if len(self.code) else np.zeros(len(code), np.int64)
        seen = self.code[at] == code if len(self.code) else np.zeros(len(code), bool)
        out = np.empty(len(code))
        out[seen] = self.base[bit[seen].astype(int), at[seen]] + self.slope[at[seen]] * p[seen]
        new = np.flatnonzero(~seen)
        out[new] = self.upper.mix(context[new], sofar[new], bit[new], 0.5)
        return out


def _lines(upper: Upper):
    """(code, base0, base1, slope) of nodes of two bytes from their sums (code, zeros, ones, below); the numbers as the longs of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, zeros, ones, below = (batch.column(i).to_numpy() for i in range(4))
            level = Level(code, zeros, ones, below)
            context, sofar = level.code >> 8, level.code & 0xFF
            # the upper levels are linear in what comes from below, so two points give the line
            point = [[upper.mix(context, sofar, np.full(len(sofar), bool(b)), level.mix(level.code, np.full(len(sofar), bool(b)), x)) for x in (0.0, 1.0)] for b in (0, 1)]
            numbers = (point[0][0], point[1][0], point[0][1] - point[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(level.code), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in numbers)], names=["code", "base0", "base1", "slope"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of two bytes with log_pw in place of the sum from below."""
    for batch in batches:
        if batch.num_rows:
            level = Level(*(batch.column(i).to_numpy() for i in range(4)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (level.code, level.zeros, level.ones, level.log_pw)], names=["code", "zeros", "ones", "below"])


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of at least `most` rows that end where the column g changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column("g").to_numpy()
            other = np.flatnonzero(g != g[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, size = t.to_batches(), t.num_rows
            most = max(most, 2 * size) if not cut else most
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _with_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, word, k, n) as they are, and for each group of keys its nodes of SPLIT bytes."""
    for t in _whole_groups(batches, GROUP_KEYS):
        word, k, n = t.column("word").to_numpy(zero_copy_only=False), t.column("k").to_numpy(), t.column("n").to_numpy()
        top = Trees(k[~word], n[~word]).levels[-1]
        m, x = len(k), len(top.code)
        first = lambda a, kind: pa.array(np.concatenate([a, np.zeros(x, a.dtype)]), kind, mask=np.arange(m + x) >= m)
        last = lambda a: pa.array(np.concatenate([np.zeros(m), a]), mask=np.arange(m + x) < m)
        yield pa.RecordBatch.from_arrays([first(t.column("g").to_numpy(), pa.int64()), first(word, pa.bool_()), pa.array(np.concatenate([k, top.code])), first(n, pa.int64()), last(top.zeros), last(top.ones), last(top.log_pw)], names=["g", "word", "k", "n", "zeros", "ones", "below"])


#: Kinds of rows in the stream of values, in the order in which a group has them: the three numbers of a line above, a key's count, a block that asks for a key.
_BASE0, _BASE1, _SLOPE, _COUNT, _ASKED = range(5)


class _Known:
    """Values of words and keys, from whole groups of rows of every kind but the last."""

    def __init__(self, g: np.ndarray, kind: np.ndarray, k: np.ndarray, x: np.ndarray, upper: Upper):
        line = kind == _SLOPE
        # the numbers of one line stand at the same place among their kinds
        numbers = {}
        for c in (_BASE0, _BASE1, _SLOPE):
            mine = np.flatnonzero(kind == c)
            mine = mine[np.lexsort((k[mine], g[mine]))]
            numbers[c] = k[mine], x[mine].view(np.float64)
        above = Above(numbers[_SLOPE][0], numbers[_BASE0][1], numbers[_BASE1][1], numbers[_SLOPE][1], upper) if line.any() else Above(*(np.zeros(0, t) for t in (np.int64, float, float, float)), upper)
        count = kind == _COUNT
        self.parts = []
        for word in (False, True):
            mine = np.flatnonzero(count & ((g < 0) == word))
            mine = mine[np.argsort(k[mine])]
            v = x[mine].astype(float) if word else Trees(k[mine], x[mine]).probability(k[mine], above)
            self.parts.append((k[mine], v))

    def of(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.empty(len(k))
        for w, (known, v) in enumerate(self.parts):
            mine = word == bool(w)
            out[mine] = v[np.searchsorted(known, k[mine])]
        return out


def _told(upper: Upper):
    """(block, word, k, v) for each block that asks, from a stream of (g, kind, k, x) sorted by g and kind.

    Counts of a group are held while it lasts, what asks for them streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, open_ = 0, None  # open_: (group, its values) if they are known and the group goes on

        def answer(g, kind, k, x, known: _Known) -> pa.RecordBatch:
            asks = kind == _ASKED
            word = g[asks] < 0
            return pa.RecordBatch.from_arrays([pa.array(x[asks].astype(np.int32)), pa.array(word), pa.array(k[asks]), pa.array(known.of(word, k[asks]))], names=["block", "word", "k", "v"])

        def closed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole groups, but that the first may have begun before."""
            g = rows[0]
            if open_ is not None and len(g) and g[0] == open_[0]:
                n = int(np.searchsorted(g, g[0], "right"))
                yield answer(*(c[:n] for c in rows), open_[1])
                rows = [c[n:] for c in rows]
            if len(rows[0]):
                yield answer(*rows, _Known(*rows, upper))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            size += batch.num_rows
            if size < GROUP_KEYS:
                continue
            rows = [np.concatenate([h[i] for h in held]) for i in range(4)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from closed([c[:cut] for c in rows])
                open_, rows = None, [c[cut:] for c in rows]
            if len(rows[0]) >= GROUP_KEYS and rows[1][-1] == _ASKED:  # one group, all of its counts are here
                if open_ is None:
                    open_ = int(rows[0][0]), _Known(*rows, upper)
                yield answer(*rows, open_[1])
                rows = [c[:0] for c in rows]
            held, size = [rows], len(rows[0])
        if size:
            yield from closed([np.concatenate([h[i] for h in held]) for i in range(4)])

    return run


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text number)."""
    s, e, of = words(buf, off, NOT_SPACE)
    return span_hash(prefix_hash(buf, BYTE_VALUE_LOWER), s, e).view(np.int64), of


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different values and their summed weights."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, kinds = pd.factorize(np.concatenate([k for k, _ in parts]))
    return kinds, np.bincount(code, weights=np.concatenate([n for _, n in parts]), minlength=len(kinds)).astype(np.int64)


def _sorted(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    return k[order], n[order]


def _squeeze(a: np.ndarray) -> bytes:
    """Eight-byte numbers by planes of their bytes, compressed; longs as differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.int64 else a
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def _unsqueezed(b: bytes, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(b, 8 * n, asbytes=True), np.uint8)
    a = np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()
    return np.cumsum(a) if kind == np.int64 else a


def _ask(table: pa.Table) -> pa.Table:
    """A block's different words and keys, with their counts in its training texts."""
    block = table.column("block")[0].as_py()
    buf, off, _ = text_buffer(table.column("t"))
    train = table.column("train").to_numpy().astype(bool)
    seen: tuple[list, list] = ([(np.array([_END_WORD]), np.array([float(train.sum())]))], [])
    for i, j in chunks(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        word, of = _words(b, o)
        key, at = keys_of(b, o)
        for held, value, w in ((seen[0], word, train[i:j][of]), (seen[1], key, np.repeat(train[i:j], np.diff(at)))):
            code, kinds = pd.factorize(value)
            held.append((kinds, np.bincount(code, weights=w, minlength=len(kinds))))
    (word, n_word), (key, n_key) = _sorted(*_count(seen[0])), _sorted(*_count(seen[1]))
    return pa.table({
        "block": np.full(len(word) + len(key), block, np.int32), "k": np.concatenate([word, key]),
        "word": np.arange(len(word) + len(key)) < len(word), "n": np.concatenate([n_word, n_key]),
    })


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values on their way back as a few long rows for each block: keys, and doubles (words: counts; bytes: logarithms), both compressed."""
    held: list[list[np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        block, word, k, v = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.lexsort((k, word, block))
        block, word, k, v = block[order], word[order], k[order], v[order]
        at = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (word[1:] != word[:-1])))
        cut = list(zip(at.tolist(), np.append(at[1:], len(k)).tolist(), strict=True))
        ks, vs = [_squeeze(k[a:b]) for a, b in cut], [_squeeze(v[a:b]) for a, b in cut]
        return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(word[at]), pa.array([b - a for a, b in cut], pa.int32()), pa.array(ks, pa.binary()), pa.array(vs, pa.binary())], names=["block", "word", "m", "k", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += batch.num_rows
        if size >= 400_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _unpack(table: pa.Table, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, values) of one kind."""
    rows = table.filter(pa.array(table.column("word").to_numpy().astype(bool) == word))
    many = rows.column("m").to_pylist()
    k = np.concatenate([_unsqueezed(x, m, np.int64) for x, m in zip(rows.column("k").to_pylist(), many, strict=True)] or [np.zeros(0, np.int64)])
    v = np.concatenate([_unsqueezed(x, m, np.float64) for x, m in zip(rows.column("v").to_pylist(), many, strict=True)] or [np.zeros(0)])
    order = np.argsort(k, kind="stable")
    return k[order], v[order]


def _look_up(known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    code, kinds = pd.factorize(asked)
    return values[np.searchsorted(known, kinds)][code]


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), body.alias("t"))
    size = docs.agg(F.sum(F.octet_length(body)).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-((size.b or 0) + 64 * size.n) // block_bytes))
    parts = partitions(spark)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col("key"), F.xxhash64("t"), F.lit("block")), F.lit(blocks)).cast("int"))

    few = max(parts, blocks // BLOCKS_OF_TASK)  # what a task reads is bounded, whatever the number of blocks
    rows = rows.repartition(few, "block")

    # ordered longs are small as differences
    thin = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
    asked = scratch.save(rows.groupBy("block").applyInArrow(_ask, "block int, k long, word boolean, n long"), **thin)
    group = F.when(F.col("word"), -1 - F.pmod(F.col("k"), F.lit(1 << 16))).otherwise(F.shiftright("k", 8).bitwiseAND(F.lit((1 << (8 * SPLIT)) - 1)))
    dealt = asked.select(group.alias("g"), "word", "k", "n").repartition(parts, "g").groupBy("g", "word", "k").agg(F.sum("n").alias("n"))
    summed = scratch.save(dealt.sortWithinPartitions("g").mapInArrow(_with_tops, "g long, word boolean, k long, n long, zeros double, ones double, below double"), **thin)
    known = summed.where("word")
    total = known.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, denominator = int(total.n), total.n + SMOOTH * (total.v + 1)

    def up(nodes: DataFrame, d: int) -> DataFrame:
        """Sums of the children of the nodes of d bytes."""
        parent = F.shiftleft(F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)), 8).bitwiseOR(F.col("code").bitwiseAND(F.lit(0xFF)))
        return nodes.groupBy(parent.alias("parent")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).withColumnRenamed("parent", "code")

    node = "code long, zeros double, ones double, below double"
    two = scratch.save(up(summed.where("g is null").select(F.col("k").alias("code"), "zeros", "ones", "below"), 2))
    one = up(two.mapInArrow(_sums, node), 1)  # at most 256 * 255 rows
    upper = spark.sparkContext.broadcast(Upper([tuple(r) for r in one.orderBy("code").collect()]))

    lines = two.mapInArrow(lambda it: _lines(upper.value)(it), "code long, base0 long, base1 long, slope long")
    each = F.explode(F.array(*[F.struct(F.lit(kind).cast("byte").alias("kind"), F.col(c).alias("x")) for kind, c in ((_BASE0, "base0"), (_BASE1, "base1"), (_SLOPE, "slope"))])).alias("e")
    lines = lines.select("code", each).select(F.shiftright("code", 8).alias("c"), F.col("code").alias("k"), "e.kind", "e.x")
    counts = summed.where("g is not null")
    above = counts.where("g >= 0").select("g").distinct().withColumn("c", F.col("g").bitwiseAND(F.lit(0xFFFF))).join(lines, "c").select("g", "kind", "k", "x")
    stream = above.union(counts.select("g", F.lit(_COUNT).cast("byte"), "k", "n")).union(asked.select(group, F.lit(_ASKED).cast("byte"), "k", F.col("block").cast("long")))
    stream = stream.repartition(parts, "g").sortWithinPartitions("g", "kind")
    told = scratch.save(stream.mapInArrow(lambda it: _pack(_told(upper.value)(it)), "block int, word boolean, m int, k binary, v binary"))
    for t in (asked, summed, two):
        scratch.drop(t)

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        (word, count), (k, log_p) = _unpack(right, True), _unpack(right, False)
        log_base, known = np.log10((count + SMOOTH) / denominator), (count > 0).astype(float)
        end = int(np.searchsorted(word, _END_WORD))
        buf, off, _ = text_buffer(left.column("t"))
        n = len(off) - 1
        n_tokens, n_known, base_sum, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for i, j in chunks(off):
            b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            asked_word, of = _words(b, o)
            n_tokens[i:j] = np.bincount(of, minlength=j - i) + 1
            at = _look_up(word, np.arange(len(word)), asked_word)
            n_known[i:j] = np.bincount(of, weights=known[at], minlength=j - i) + known[end]
            base_sum[i:j] = np.bincount(of, weights=log_base[at], minlength=j - i) + log_base[end]
            key, to = keys_of(b, o)
            total[i:j] = np.add.reduceat(_look_up(k, log_p, key), to[:-1])
        return pa.table({
            "key": left.column("key"), "train": left.column("train"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, n_train),
            "base_score": base_sum, "score": total, "n_bytes": np.diff(off),
        })

    schema = f"key {dict(rows.dtypes)['key']}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return rows.groupBy("block").cogroup(told.repartition(few, "block").groupBy("block")).applyInArrow(answer, schema).withColumnRenamed("key", key)
