"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A tree's slots hold a few pre-tokens each (their lengths and token counts); two heaps
hold the subtree sums of characters and tokens. An edit descends by character sums to
the pre-tokens it touches, cuts the text anew from just before them until a cut falls on
an old one behind the edit, encodes only what is new, and updates the sums on the way to
the root. The count of a document is the root's, before and after.

Pre-tokens are cut from left to right and a cut depends only on what is right of it, at
most LOOK_AHEAD characters behind its end: hence the context that is cut again.

Defined results: null is empty and has no tokens; edits outside the text are clipped to
it; null edits are none; repeated rows each get a row; an empty table gives an empty
result; other columns are not touched. Trees are rows (text, sizes, chars, tokens, the
two heaps) that can be written and read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import read_vocabulary

SLOT, MOST_IN_SLOT, LOOK_AHEAD = 8, 64, 3
CACHE_WORDS = 200_000


class Counter:
    """Token counts of pre-tokens under a file of ranks, kept for those met."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            self.encoded += 1
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        return [known[p] if p in known else self.count(p) for p in pieces]


class Tree:
    def __init__(self, text: str, chars: list[list[int]], tokens: list[list[int]], heaps: tuple[list[int], list[int]] | None = None):
        self.text, self.chars, self.tokens = text, chars, tokens
        if heaps:
            self.char_sum, self.token_sum = heaps
            self.base = len(self.char_sum) // 2
        else:
            self._sum_all()
        self.encoded = 0

    @classmethod
    def build(cls, text: str, counter: Counter) -> Tree:
        pieces = counter.pattern.findall(text)
        chars, tokens = list(map(len, pieces)), counter.counts(pieces)
        cut = range(0, max(1, len(pieces)), SLOT)
        return cls(text, [chars[i : i + SLOT] for i in cut], [tokens[i : i + SLOT] for i in cut])

    def _sum_all(self) -> None:
        self.base = 1
        while self.base < len(self.chars):
            self.base *= 2
        pad = [0] * (self.base - len(self.chars))
        self.char_sum = [0] * self.base + [sum(x) for x in self.chars] + pad
        self.token_sum = [0] * self.base + [sum(x) for x in self.tokens] + pad
        for heap in (self.char_sum, self.token_sum):
            for i in range(self.base - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]

    def _sum_path(self, slot: int) -> None:
        i = self.base + slot
        self.char_sum[i], self.token_sum[i] = sum(self.chars[slot]), sum(self.tokens[slot])
        while i > 1:
            i //= 2
            self.char_sum[i] = self.char_sum[2 * i] + self.char_sum[2 * i + 1]
            self.token_sum[i] = self.token_sum[2 * i] + self.token_sum[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.token_sum[1] if self.base > 1 or len(self.token_sum) > 1 else 0

    def _find(self, at: int) -> tuple[int, int, int]:
        """(slot, place in it, first character) of the pre-token that holds character `at`, or the place behind all."""
        if at >= self.char_sum[1]:
            last = len(self.chars) - 1
            return last, len(self.chars[last]), self.char_sum[1]
        i, left = 1, at
        while i < self.base:
            i *= 2
            if left >= self.char_sum[i]:
                left -= self.char_sum[i]
                i += 1
        slot, begin = i - self.base, at - left
        for k, n in enumerate(self.chars[slot]):
            if left < n:
                return slot, k, begin
            left -= n
            begin += n
        raise AssertionError("sums and slots differ")

    def edit(self, at: int, deleted: int, inserted: str, counter: Counter) -> None:
        """Replaces `deleted` characters from `at` by `inserted`."""
        at = max(0, min(at, len(self.text)))
        deleted = max(0, min(deleted, len(self.text) - at))
        if not deleted and not inserted:
            return
        slot, k, begin = self._find(max(0, at - LOOK_AHEAD))
        text = self.text[:at] + inserted + self.text[at + deleted :]
        behind, shift = at + len(inserted), len(inserted) - deleted
        # walk the old cuts alongside the new ones until both fall together behind the edit
        s, j, old = slot, k, begin
        pieces: list[str] = []
        pos = begin
        while pos < len(text):
            m = counter.pattern.match(text, pos)
            if m is None or m.end() == pos:  # a character that no alternative takes
                break
            pieces.append(m.group())
            pos = m.end()
            while old + shift < pos and s < len(self.chars):
                if j < len(self.chars[s]):
                    old += self.chars[s][j]
                    j += 1
                else:
                    s, j = s + 1, 0
            if pos >= behind and old + shift == pos:
                break
        else:
            s, j = len(self.chars) - 1, len(self.chars[-1])
        counts = counter.counts(pieces)
        self.encoded += len(pieces)
        self.text = text
        rest_chars, rest_tokens = (self.chars[s][j:], self.tokens[s][j:]) if s < len(self.chars) else ([], [])
        if s == slot or s >= len(self.chars):
            last = min(s, len(self.chars) - 1)
        else:
            last = s
            self.chars[s], self.tokens[s] = rest_chars, rest_tokens
            rest_chars, rest_tokens = [], []
        self.chars[slot] = self.chars[slot][:k] + [len(p) for p in pieces] + rest_chars
        self.tokens[slot] = self.tokens[slot][:k] + counts + rest_tokens
        for x in range(slot + 1, last if last == s and s != slot and s < len(self.chars) else last + 1):
            self.chars[x], self.tokens[x] = [], []
        if len(self.chars[slot]) > MOST_IN_SLOT:
            chars, tokens = [n for c in self.chars for n in c], [n for c in self.tokens for n in c]
            cut = range(0, len(chars), SLOT)
            self.chars, self.tokens = [chars[i : i + SLOT] for i in cut], [tokens[i : i + SLOT] for i in cut]
            self._sum_all()
        else:
            for x in range(slot, min(last, len(self.chars) - 1) + 1):
                self._sum_path(x)


TREE = "text string, sizes array<int>, chars array<int>, tokens array<int>, char_sum array<int>, token_sum array<int>"
EDITS = "array<struct<at:int,deleted:int,inserted:string>>"


def _row(t: Tree) -> tuple:
    return t.text, [len(c) for c in t.chars], [n for c in t.chars for n in c], [n for c in t.tokens for n in c], t.char_sum, t.token_sum


def _tree(text: str, sizes: list[int], chars: list[int], tokens: list[int], char_sum: list[int], token_sum: list[int]) -> Tree:
    a, b, at = [], [], 0
    for n in sizes:
        a.append(chars[at : at + n])
        b.append(tokens[at : at + n])
        at += n
    return Tree(text, a, b, (char_sum, token_sum))


_counters: dict[tuple[int, str], Counter] = {}


def _counter(ranks: bytes, pattern: str) -> Counter:
    key = (hash(ranks), pattern)
    if key not in _counters:
        _counters[key] = Counter(ranks, pattern)
    return _counters[key]


_KINDS = [pa.string(), *[pa.list_(pa.int32())] * 5]
_NAMES = ["text", "sizes", "chars", "tokens", "char_sum", "token_sum"]


def trees(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tree, n_tokens) of each document."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [Tree.build(t or "", counter) for t in part.column(1).to_pylist()]
                cols = zip(*map(_row, made), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], pa.array([t.n_tokens for t in made], pa.int64())], names=["k", *_NAMES, "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, {TREE}, n_tokens long").withColumnRenamed("k", key)


def apply_edits(tree_rows: DataFrame, edits: Column, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """The trees after each row's list of edits, applied in order: (key, tree, n_tokens, n_encoded), n_encoded being the pre-tokens encoded anew."""
    file = tree_rows.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = []
                for row in zip(*[part.column(i).to_pylist() for i in range(1, 8)], strict=True):
                    t = _tree(*row[:6])
                    for e in row[6] or ():
                        t.edit(e["at"], e["deleted"], e["inserted"] or "", counter)
                    made.append(t)
                cols = zip(*map(_row, made), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], pa.array([t.n_tokens for t in made], pa.int64()), pa.array([t.encoded for t in made], pa.int64())], names=["k", *_NAMES, "n_tokens", "n_encoded"])

    rows = tree_rows.select(F.col(key).alias("k"), *_NAMES, edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, {TREE}, n_tokens long, n_encoded long").withColumnRenamed("k", key)


def standard_edits(text: str = "text") -> Column:
    """Three edits of any text, from its length: a word put in at the middle, ten characters out at a quarter, and a new beginning."""
    n = F.length(text)
    one = lambda at, deleted, inserted: F.struct(at.cast("int").alias("at"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(one(F.floor(n / 2), 0, " inserted"), one(F.floor(n / 4), 10, ""), one(F.lit(0), 1, "It's "))
