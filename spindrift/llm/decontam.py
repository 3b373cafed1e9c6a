"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task lays the words of about two megabytes of documents out as numbers, sorts the
suffixes that can match (a word suffix array of the shard) and binary-searches every
different benchmark window in it; `matches` searches every benchmark suffix. The benchmark is a stated query set: it goes out in blocks of
bounded size, and each shard is searched block after block, so nothing broadcast grows
with either table and no document is shuffled.

Words are compared by 64-bit hashes of their bytes. Defined results: null or wordless
text has no words, no hits and is not contaminated; every row of the documents gets a
row, repeated rows too; benchmark rows of one item_id are one item, a null item_id is
the item "null"; an item without words occurs nowhere; empty tables give empty results
or no hits; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_VALUE_LOWER, chunks, prefix_hash, span_hash, text_buffer, words

WINDOW = 13
SHARD_BYTES = 2 << 20
#: Limits of a block of the benchmark: bytes of text, and words so that a word's number fits 16 bits; an item of more is a block of its own, with wider slots if need be.
BLOCK_BYTES, BLOCK_WORDS = 2 << 20, 60_000
_WORDS = 16  # words in an order, by sort keys of 64 bits, if no window has more
_PAIR_BITS = 22


@dataclass
class Block:
    vocabulary: np.ndarray  # sorted word hashes; number of a word is its place plus 1
    ids: np.ndarray  # numbers of all words, item after item
    left: np.ndarray  # words from each on to its item's end
    item: np.ndarray  # index into names for each word
    names: list[str]
    windows: np.ndarray  # word position of one occurrence of each different window
    width: np.ndarray  # its words
    owners: np.ndarray  # items of window u: owners[owner_at[u]:owner_at[u + 1]]
    owner_at: np.ndarray
    pairs: np.ndarray | None  # which hashed word pairs occur; None if a window has one word
    bits: int  # of a word's number in a sort key
    depth: int  # words in an order

    @classmethod
    def build(cls, names: list[str], texts: list[str | None], window: int) -> Block:
        buf, off, _ = text_buffer(pa.array(texts, pa.string()))
        s, e, of = words(buf, off, ALNUM)
        h = span_hash(prefix_hash(buf, BYTE_VALUE_LOWER), s, e)
        vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        count = np.bincount(of, minlength=len(texts))
        left = (np.cumsum(count) - 0)[of] - np.arange(len(of))
        wide = np.minimum(count, window)[of]
        at = np.flatnonzero(left >= wide)
        bits, depth = 16 if len(vocabulary) < 1 << 16 else 32, max(_WORDS, window)
        keys = key_levels(ids, left, at, np.minimum(wide, left)[at], bits, depth)
        order = np.lexsort((wide[at], *keys[::-1]))
        rows = np.stack([*(k[order] for k in keys), wide[at][order].astype(np.uint64)])
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        unique_of = np.cumsum(new) - 1
        name_no = {n: i for i, n in enumerate(dict.fromkeys(names))}
        own_name = np.array([name_no[n] for n in names], np.int64)
        owner = np.unique(np.stack([unique_of, own_name[of[at[order]]]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        starts = np.searchsorted(owner[0], np.arange(int(new.sum()) + 1))
        pairs = None
        width = wide[at[order[new]]]
        if len(width) and width.min() > 1:
            pairs = np.zeros(1 << _PAIR_BITS, bool)
            two = np.flatnonzero(left > 1)
            pairs[pair_no(ids[two], ids[two + 1])] = True
        return cls(vocabulary, ids, left, own_name[of], list(name_no), at[order[new]], width, owner[1], starts, pairs, bits, depth)


def pair_no(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a.astype(np.uint64) * np.uint64(65_537) + b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def key_levels(ids: np.ndarray, left: np.ndarray, at: np.ndarray, most: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """For the suffixes at `at`, cut to `most` words, `depth` words of so many bits as sort keys; 0 stands past the end."""
    out = []
    for level in range(0, depth, 64 // bits):
        key = np.zeros(len(at), np.uint64)
        for k in range(level, level + 64 // bits):
            word = np.where(k < most, ids[np.minimum(at + k, len(ids) - 1)] if len(ids) else 0, 0)
            key = (key << np.uint64(bits)) | word.astype(np.uint64)
        out.append(key)
    return out


class Shard:
    """The suffix array of a run of documents, as far as a block's words can match."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, n_docs: int, block: Block):
        v = block.vocabulary
        if len(v):
            near = np.minimum(np.searchsorted(v, hashes), len(v) - 1)
            self.ids = np.where(v[near] == hashes, near + 1, 0)
        else:
            self.ids = np.zeros(len(hashes), np.int64)
        ends = np.cumsum(np.bincount(of, minlength=n_docs))
        self.left = ends[of] - np.arange(len(of))
        can = self.ids > 0
        if block.pairs is not None and len(can):
            two = can.copy()
            two[-1] = False
            two[:-1] &= can[1:] & (self.left[:-1] > 1)
            i = np.flatnonzero(two)
            can = np.zeros(len(can), bool)
            can[i[block.pairs[pair_no(self.ids[i], self.ids[i + 1])]]] = True
        at = np.flatnonzero(can)
        keys = key_levels(self.ids, self.left, at, self.left[at], block.bits, block.depth)
        order = np.lexsort(keys[::-1])
        self.suffixes = at[order]
        self.keys = [k[order] for k in keys]

    def _bound(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, shift: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            k = keys[np.minimum(mid, len(keys) - 1)] >> shift
            below = open_ & ((k <= want) if right else (k < want))
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo

    def find(self, block: Block, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with the first `width` (block.depth at most) words at `at`."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        want, each = key_levels(block.ids, block.left, at, width, block.bits, block.depth), 64 // block.bits
        for level, keys in enumerate(self.keys):
            here = np.clip(width - level * each, 0, each)
            if not (here > 0).any() or not len(keys):
                break
            shift = (block.bits * (each - here)).astype(np.uint64)
            all_of = here == 0
            shift[all_of] = 0
            w = want[level] >> shift
            lo2, hi2 = self._bound(keys, lo, hi, w, shift, False), self._bound(keys, lo, hi, w, shift, True)
            lo, hi = np.where(all_of, lo, lo2), np.where(all_of, hi, hi2)
        return lo, hi

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window number, word position) of each occurrence of each window."""
        lo, hi = self.find(block, block.windows, block.width)
        n = hi - lo
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return of, self.suffixes[place]

    def longest(self, block: Block, least: int) -> list[tuple[int, int, int]]:
        """(word of the benchmark, word of the shard, words) of the longest verbatim matches of each benchmark suffix, at all their places, not inside a longer one's."""
        at = np.arange(len(block.ids))
        best, lo, hi = (np.zeros(len(at), np.int64) for _ in range(3))
        for k in range(1, block.depth + 1):
            live = np.flatnonzero((best == k - 1) & (block.left >= k))
            if not len(live):
                break
            a, b = self.find(block, live, np.full(len(live), k))
            got = live[b > a]
            best[got], lo[got], hi[got] = k, a[b > a], b[b > a]
        where = {}
        for i in np.flatnonzero(best > 0).tolist():
            where[i] = self.suffixes[lo[i] : hi[i]].tolist()
            if best[i] == block.depth:
                length = []
                for p in where[i]:
                    n = block.depth
                    while n < block.left[i] and n < self.left[p] and block.ids[i + n] == self.ids[p + n]:
                        n += 1
                    length.append(n)
                best[i] = max(length)
                where[i] = [p for p, n in zip(where[i], length, strict=True) if n == best[i]]

        def longer(i: int, p: int) -> bool:
            return i > 0 and p > 0 and block.left[i - 1] > 1 and self.left[p - 1] > 1 and block.ids[i - 1] == self.ids[p - 1]

        return [(i, p, int(best[i])) for i, places in where.items() if best[i] >= least for p in sorted(places) if not longer(i, p)]


class _Blocks:
    """The broadcast blocks one after the other; only one is held by a task."""

    def __init__(self, spark, benchmark: DataFrame, window: int, item: str, text: str):
        self.parts = []
        names: list[str] = []
        texts: list[str | None] = []
        size = n = 0
        for r in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).toLocalIterator(prefetchPartitions=False):
            buf, off, _ = text_buffer(pa.array([r.t], pa.string()))
            more, w = len(buf), len(words(buf, off, ALNUM)[0])
            if names and (size + more > BLOCK_BYTES or n + w > BLOCK_WORDS):
                self.parts.append(spark.sparkContext.broadcast(Block.build(names, texts, window)))
                names, texts, size, n = [], [], 0, 0
            names.append(r.i)
            texts.append(r.t)
            size, n = size + more, n + w
        if names:
            self.parts.append(spark.sparkContext.broadcast(Block.build(names, texts, window)))

    def __iter__(self) -> Iterator[Block]:
        for b in self.parts:
            yield b.value
            if len(self.parts) > 1:
                b.__dict__.pop("_value", None)


def judge(col: pa.Array, blocks) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """(words, hit words, sorted names of items) of each text of a batch."""
    buf, off, _ = text_buffer(col)
    n = len(off) - 1
    n_words, n_hit, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
    for i, j in chunks(off, SHARD_BYTES):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, of = words(b, o, ALNUM)
        h = span_hash(prefix_hash(b, BYTE_VALUE_LOWER), s, e)
        cover = np.zeros(len(s) + 1, np.int64)
        n_words[i:j] = np.bincount(of, minlength=j - i)
        for block in blocks if len(h) else ():
            if not len(block.windows):
                continue
            window, at = Shard(h, of, j - i, block).occurrences(block)
            if not len(at):
                continue
            np.add.at(cover, at, 1)
            np.add.at(cover, at + block.width[window], -1)
            pair = np.unique(np.stack([of[at], window]), axis=1)
            for d, u in pair.T.tolist():
                items[i + d].extend(block.names[x] for x in block.owners[block.owner_at[u] : block.owner_at[u + 1]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        n_hit[i:j] = np.bincount(of[hit], minlength=j - i)
    return n_words, n_hit, [sorted(set(x)) if x else x for x in items]


def contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: its words, hit words, items and verdict."""
    blocks = _Blocks(docs.sparkSession, benchmark, window, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n_words, n_hit, items = judge(batch.column(1), blocks)
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else none for x in items]
            cols = [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(contaminated(n_words, n_hit))]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, {DIGEST}").withColumnRenamed("k", key)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = _Blocks(docs.sparkSession, benchmark, window, item, item_text)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, _ = judge(batch.column(place), blocks)
            yield batch.filter(pa.array(~contaminated(n_words, n_hit)))

    return docs.mapInArrow(run, docs.schema)


def matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Longest verbatim matches of benchmark suffixes in each document, with both places in words."""
    blocks = _Blocks(docs.sparkSession, benchmark, WINDOW, item, item_text)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = text_buffer(batch.column(1))
            keys, out = batch.column(0).to_pylist(), []
            for d in range(len(off) - 1):
                b, o = buf[off[d] : off[d + 1]], np.array([0, off[d + 1] - off[d]])
                s, e, of = words(b, o, ALNUM)
                h = span_hash(prefix_hash(b, BYTE_VALUE_LOWER), s, e)
                for block in blocks:
                    starts = np.concatenate([[0], np.flatnonzero(block.left[:-1] == 1) + 1]) if len(block.left) else np.zeros(1, np.int64)
                    for i, p, n in Shard(h, of, 1, block).longest(block, least) if len(h) else ():
                        out.append((keys[d], block.names[block.item[i]], p, int(i - starts[np.searchsorted(starts, i, "right") - 1]), n))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "item_id", "doc_word", "item_word", "n_words"])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, item_id string, doc_word long, item_word long, n_words long").withColumnRenamed("k", key)
