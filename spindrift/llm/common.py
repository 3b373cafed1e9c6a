"""Shared pieces: scratch tables in the shared folder, text buffers, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.scratch import Scratch, groups, partitions, shared_dir, trim  # noqa: F401

#: Bytes of text that one numpy pass works on; a longer single text is one chunk.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- text buffers
def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1 texts, valid) of a string column without copying; null is empty."""
    if len(col) >= 1000:  # once a batch
        trim()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    n = len(col)
    valid = np.ones(n, bool) if col.null_count == 0 else col.is_valid().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if not valid.all():
        lens = np.diff(off)
        if lens[~valid].any():  # a null's slot may hold bytes
            keep = np.repeat(valid, lens)
            data = data[keep]
            off = np.concatenate([[0], np.cumsum(np.where(valid, lens, 0))])
    return data, off, valid


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashing
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in and out."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _M1
        x ^= x >> np.uint64(33)
        x *= _M2
        x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, CHUNK_BYTES + 1024)
        with np.errstate(over="ignore"):
            for k, b in (("p", _BASE), ("i", _BASE_INV)):
                a = np.full(m, b, np.uint64)
                a[0] = 1
                _powers[k] = np.cumprod(a)
    return _powers["p"][:n], _powers["i"][:n]


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_fold = np.arange(256)
_fold[65:91] += 32
#: Values under which A-Z equal a-z.
BYTE_VALUE_LOWER = BYTE_VALUE[_fold]


def prefix_hash(buf: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """P with P[e] - P[s] the polynomial of buf[s:e] times base**s."""
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[buf] * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s:e], the same wherever the same bytes stand."""
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[e] - prefix[s]) * inv[s] + (e - s).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x20\x09-\x0D]
NOT_SPACE = ~SPACE
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(buf: np.ndarray, off: np.ndarray, wordy: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each maximal run of wordy bytes; runs end with their text. Classes are of bytes: bytes of 0x80 and above stay together."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = wordy[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    s = np.flatnonzero(m & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    e = np.flatnonzero(m & (~after | first[1:])) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def held_out(mod: int, is_: int, doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo mod, equals is_."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == is_, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
