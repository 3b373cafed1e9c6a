"""Exact byte-pair encoding by backtracking, and decoding through an offset table.

A word is a string of symbols, its last byte being a symbol of its own kind (the end of
a word). An Aho-Corasick automaton of all tokens gives the longest token at each place
that is come to; a walk from the left takes the longest token whose pair
with the one before is compatible, tries its next shorter prefix otherwise, and marks
places from which the end can't be reached, so each is left at most once and time is
linear. A pair is compatible if merging by rank would never join across the seam, which
is decided by undoing merges on both sides and kept in a table. The result is exactly
that of merging by rank.

Words repeat, so a bounded two-generation cache keeps encoded words in each task.
The vocabulary file has a fixed size (checked) and is broadcast.

Defined results: null is empty; an empty text has no tokens and decodes to ""; repeated
rows each get a row; special tokens' strings in a text are those tokens; other columns
are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: The most a vocabulary file may have to be broadcast.
MOST_VOCABULARY_BYTES = 64 << 20
#: Encoded words that a task keeps, in each of two generations.
CACHE_WORDS = 100_000
#: Texts are handled in groups of about this many characters.
GROUP_CHARS = 2 << 20
_NONE = -1
_pack = [struct.Struct(f"={n}i").pack for n in range(16)]


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Tokens are numbered by rank here (base symbols, then merges in order); `ids` has the file's numbers."""

    def __init__(self, file: bytes):
        import ahocorasick

        spec = json.loads(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary, symbols = model["vocab"], byte_symbols()

        def text(token: str) -> str:
            """One character for each symbol: the byte, or 256 more at a word's end."""
            last = bool(end) and token.endswith(end) and token != end
            body = [symbols[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last)

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        base = [t for t in vocabulary if len(t) == 1 or (end and len(t) == 1 + len(end) and t.endswith(end))]
        self.texts = [text(t) for t in base]
        self.ids = [vocabulary[t] for t in base]
        number = {t: i for i, t in enumerate(base)}
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole = a + b if not (end and a.endswith(end) and len(a) > len(end)) else a[: -len(end)] + b
            x, y = number[a], number[b]
            if whole not in number:
                number[whole] = len(self.texts)
                self.texts.append(text(whole))
                self.ids.append(vocabulary[whole])
                self.left.append(x)
                self.right.append(y)
            self.merged.setdefault((x, y), number[whole])
        self.n_base = len(base)
        self.length = [len(t) for t in self.texts]
        by_text = {t: i for i, t in enumerate(self.texts)}
        self.shorter = []
        for t in self.texts:
            k = len(t) - 1
            while k and t[:k] not in by_text:
                k -= 1
            self.shorter.append(by_text[t[:k]] if k else _NONE)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.texts):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {c: np.array([i], np.int32).tobytes() for c, i in added.items()}
        # the offset tables: a token's string, and its number in digits, each with a space after
        most = max([*vocabulary.values(), *added.values()]) + 1
        content = [""] * most
        for t, i in [*vocabulary.items(), *added.items()]:
            content[i] = t
        self.strings = OffsetTable([c.encode() + b" " for c in content])
        self.digits = OffsetTable([str(i).encode() + b" " for i in range(most)])

    def joins(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side after merging by rank. Merges are undone
        from the latest; a merge across the seam that comes before what is undone forbids it."""
        key = (a, b)
        if (known := self.compatible.get(key)) is not None:
            return known
        before, answer, n_base = 1 << 62, True, self.n_base
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                answer = False
                break
            if a < n_base and b < n_base:
                break
            # equal ranks: the left one was merged first, as scanning goes from the left
            if a > b:
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]
        if len(self.compatible) > 200_000:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def word(self, data: bytes) -> bytes:
        """The ids of one pre-token, packed."""
        s = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        n = len(s)
        out: list[int] = []
        dead = bytearray(n + 1)
        length, shorter, known, match = self.length, self.shorter, self.compatible, self.automaton.iter_long
        at, last = 0, _NONE
        token = next(match(s))[1]  # every symbol is a token, so the first match begins here
        while True:
            while token != _NONE:
                if not dead[at + length[token]]:
                    fits = True if last == _NONE else known.get((last, token))
                    if fits or (fits is None and self.joins(last, token)):
                        break
                token = shorter[token]
            if token != _NONE:
                out.append(token)
                at += length[token]
                if at == n:
                    break
                last, token = token, next(match(s, at))[1]
            else:  # no way on from here: take a shorter token before it
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else _NONE
        ids = self.ids
        return _pack[len(out)](*[ids[t] for t in out]) if len(out) < 16 else np.array([ids[t] for t in out], np.int32).tobytes()


class OffsetTable:
    """All entries end to end, and where each begins: any list of ids becomes one gather."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all entries of ids, offset behind each)."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(total)], ends


class Words(dict):
    """Encoded words; when a generation is full it becomes the old one."""

    def __init__(self, encoder: Encoder):
        super().__init__(encoder.added)
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.encoder.word(word.encode())
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
            self.update(self.encoder.added)
        self[word] = got
        return got


# The vocabulary file's own split pattern, with Unicode classes and, for texts in ASCII, without.
# (alternatives that begin differently may stand in any order: the commonest is first)
_UNICODE = r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_ASCII = r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+"

def encoder(file: bytes) -> tuple[Encoder, Words]:
    """An encoder with its cache of words. A task has its own and drops it, as workers outlive stages and their memory counts."""
    e = Encoder(file)
    return e, Words(e)


def _patterns():
    import regex

    return re.compile(_ASCII).findall, regex.compile(_UNICODE).findall


def pre_tokens(text: str, enc: Encoder, find) -> list[str]:
    """Normalised pre-tokens; special tokens' strings stand for themselves."""
    ascii_, unicode_ = find

    def plain(t: str) -> list[str]:
        if t.isascii():
            return ascii_(t.lower())
        # lower-casing goes character by character: no final sigma
        return unicode_(unicodedata.normalize("NFC", t).replace("Σ", "σ").lower())

    if enc.special is None or "<|" not in text:
        return plain(text)
    out: list[str] = []
    for i, part in enumerate(enc.special.split(text)):
        if i % 2:
            out.append(part)
        elif part:
            out += plain(part)
    return out


def encode_texts(texts: list[str | None], enc: Encoder, cache: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts: (ids of all, number of ids of each)."""
    find = _patterns()
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append(b"".join(map(cache.__getitem__, pre_tokens(t, enc, find))) if t else b"")
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield np.frombuffer(b"".join(group), np.int32), np.array([len(g) // 4 for g in group], np.int64)
            group, size = [], 0
    if group:
        yield np.frombuffer(b"".join(group), np.int32), np.array([len(g) // 4 for g in group], np.int64)


def _shas(table: OffsetTable, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each text's entries joined by spaces; the table's entries end with one."""
    data, behind = table.join(ids)
    to = np.concatenate([[0], behind])[np.concatenate([[0], ends])]
    view = memoryview(data)
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return data


def digest(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count and hashes of the ids and of what they decode to, for each document; the ids themselves if asked for."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = encoder(file.value)
        for batch in batches:
            trim()
            count, id_sha, text_sha, lists = [], [], [], []
            for ids, n in encode_texts(batch.column(1).to_pylist(), enc, cache):
                ends = np.cumsum(n)
                count += n.tolist()
                id_sha += _shas(enc.digits, ids, ends)
                text_sha += _shas(enc.strings, ids, ends)
                if with_ids:
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)))
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                cols.append(pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("k", key)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with the token ids of each document."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = encoder(file.value)
        for batch in batches:
            at = 0
            for ids, n in encode_texts(batch.column(1).to_pylist(), enc, cache):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), lists], names=["k", "ids"])
                at += len(n)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, ids array<int>").withColumnRenamed("k", key)


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) with the tokens' strings joined by spaces; null ids are none."""
    file = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(file.value)
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                data, _ = enc.strings.join(np.array(x or [], np.int64))
                out.append(data.tobytes()[:-1].decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["k", "text"])

    rows = tokens.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, text string").withColumnRenamed("k", key)
