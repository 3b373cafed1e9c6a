"""Duplicate measures over text fields: exact, normalised, near (MinHash bands) and fuzzy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import comparable
from spindrift.operators.validation import with_repeats
from spindrift.sources.scratch import Scratch, groups, partitions, trim

SIMILARITY, SHINGLE, SIGNATURE = 0.7, 3, 64
#: Signatures that a task compares with each other or with as many, and rows of that at once.
BLOCK, _ROWS = 2048, 256
#: Of two texts: lengths of matches looked for, matches held at once, and cells of a box left to difflib.
_GRAMS, _MATCHES, _SMALL = (256, 32, 8, 2, 1), 250_000, 2500


def exact(df: DataFrame, text: str | Column, order: str, name: str) -> DataFrame:
    """df with `name`, true for the second and later rows of a text. Texts meet by their SHA-256."""
    t = F.col(text) if isinstance(text, str) else text
    return with_repeats(df, [F.sha2(t, 256)], order, name)


def normalized(df: DataFrame, text: str, order: str, name: str) -> DataFrame:
    return exact(df, comparable(F.col(text)), order, name)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct word k-grams of a column of comparable texts; a shorter text is its own."""
    w = F.split(text, " ")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return F.array_distinct(F.when(F.size(w) >= k, many).otherwise(F.array(F.array_join(w, " "))))


def bands_for(similarity: float, size: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the most rows whose threshold is still at or below the similarity."""
    fit = [(size // r, r) for r in range(1, size + 1) if (1 / (size // r)) ** (1 / r) <= similarity]
    return max(fit, key=lambda x: x[1]) if fit else (size, 1)


def _signature(size: int, k: int):
    rng = np.random.default_rng(77)
    a = rng.integers(1, 1 << 62, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, size, dtype=np.int64).astype(np.uint64)

    @F.pandas_udf("binary")
    def signature(texts: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest

        trim()

        def one(t):
            if t is None:
                return None
            w = t.split(" ")
            grams = {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
            h = np.array([xxh64_intdigest(g) for g in grams], dtype=np.uint64)
            low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(h), 4096):
                with np.errstate(over="ignore"):
                    low = np.minimum(low, (h[i : i + 4096, None] * a + b).min(0))
            return (low >> np.uint64(2)).astype(np.int64).tobytes()

        return texts.map(one)

    return signature


def _best(size: int, similarity: float, window: int | None):
    """Over groups of a bucket's rows in key order: each row with the best of the earlier ones, ties to the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "i", "j"]):
            n = t.num_rows
            if n < 2:
                continue
            block, key = t.column("block").to_numpy(), t.column("key").combine_chunks()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.int64).reshape(n, size)
            columns = np.stack([np.unique(c, return_inverse=True)[1] for c in sig.T]).astype(np.uint16)
            across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            at, of, most = [], [], []
            for lo in range(0, n, _ROWS):
                hi = min(lo + _ROWS, n)
                same = np.zeros((hi - lo, hi), np.uint16)
                for c in columns:
                    same += c[lo:hi, None] == c[None, :hi]
                ok = np.arange(hi)[None, :] < np.arange(lo, hi)[:, None]
                if across:
                    ok &= block[lo:hi, None] != block[None, :hi]
                if window is not None:
                    k = key.to_numpy(zero_copy_only=False)
                    ok &= k[lo:hi, None] - k[None, :hi] <= window
                same[~ok] = 0
                best = same.argmax(1)
                m = same[np.arange(hi - lo), best]
                good = np.flatnonzero((m > 0) & (m / size >= similarity))
                at.append(good + lo)
                of.append(best[good])
                most.append(m[good] / size)
            at, of, most = np.concatenate(at), np.concatenate(of), np.concatenate(most)
            if len(at):
                yield pa.RecordBatch.from_arrays([key.take(pa.array(of)), key.take(pa.array(at)), pa.array(most)], names=["a", "b", "estimate"])

    return run


def near_pairs(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, k: int = SHINGLE, size: int = SIGNATURE, window: int | None = None) -> DataFrame:
    """(a, b, estimate): each row with its best earlier neighbour whose estimated similarity is enough.

    All rows that share a band's bucket are compared; of equally good ones the earliest is
    taken. Rows of one signature stand for each other, so copies cost nothing; a bucket of
    more than BLOCK signatures is cut into blocks, each pair of blocks a group of its own.
    A window, if given, is the largest difference of two keys; then every row stands for itself."""
    spark = df.sparkSession
    scratch, parts = Scratch(spark, "near"), partitions(spark)
    bands, rows = bands_for(similarity, size)
    clean = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), comparable(F.col(text)).alias("t"))
    sig = clean.select("key", _signature(size, k)("t").alias("sig"))
    every = scratch.save(sig.select("key", F.xxhash64("sig").alias("node"), "sig"))
    copies, one = None, every.select("key", "sig")
    if window is None:
        first = scratch.save(every.groupBy("node").agg(F.min("key").alias("a"), F.first("sig").alias("sig")))
        copies = every.select("key", "node").join(first.select("node", "a"), "node").where("a < key").select("a", F.col("key").alias("b"), F.lit(1.0).alias("estimate"))
        one = first.select(F.col("a").alias("key"), "sig")
    cut = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * rows * 8 + 1, rows * 8)) for i in range(bands)])
    banded = one.select("key", F.explode(cut).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = banded.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wide = dealt.join(one, "key").select("bucket", "i", "j", "key", "block", "sig").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    kind = dict(one.dtypes)["key"]
    scored = wide.mapInArrow(_best(size, similarity, window), f"a {kind}, b {kind}, estimate double")
    best = scored.groupBy("b").agg(F.min_by(F.struct("a", "estimate"), F.struct(-F.col("estimate"), "a")).alias("m")).select("m.a", "b", "m.estimate")
    return best if copies is None else best.union(copies)


class _Texts:
    """Two texts whose common substrings are found by ranks of their 2**p-grams, which are exact."""

    def __init__(self, a: str, b: str):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
        self.n, self.m, self.behind = len(x), len(y), len(x) + 1
        self.ranks = [np.unique(np.concatenate([x, [-1], y]), return_inverse=True)[1]]

    def rank(self, p: int) -> np.ndarray:
        while len(self.ranks) <= p:
            r, k = self.ranks[-1], 1 << len(self.ranks) - 1
            self.ranks.append(np.unique(r[:-k] * (len(r) + 1) + r[k:], return_inverse=True)[1] if len(r) > k else r[:0])
        return self.ranks[p]

    def grams(self, box: tuple[int, int, int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the k-grams (k of any size) inside both sides of a box."""
        alo, ahi, blo, bhi = box
        p = k.bit_length() - 1
        r, more = self.rank(p), k - (1 << p)
        at = [(alo, max(alo, ahi - k + 1)), (self.behind + blo, self.behind + max(blo, bhi - k + 1))]
        x, y = (r[i:j] if not more else r[i:j] * (len(r) + 1) + r[i + more : j + more] for i, j in at)
        return x, y

    def runs(self, box: tuple[int, int, int, int], k: int) -> np.ndarray | None:
        """(start in a, offset to b, length) of the maximal matches of k or more inside a box; None if there are too many to hold."""
        x, y = self.grams(box, k)
        order = np.argsort(y, kind="stable")
        y = y[order]
        lo, count = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        count -= lo
        total = int(count.sum())
        if total > _MATCHES:
            return None
        i = np.repeat(np.arange(len(x)), count)
        j = order[np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)] if total else i
        n = len(x) + 1  # a place that no match has parts the diagonals
        line = np.sort((j - i + len(x)) * n + i)
        first = np.flatnonzero(np.diff(line, prepend=-2) != 1)
        length = np.diff(np.append(first, len(line))) + k - 1
        d, i = np.divmod(line[first], n)
        return np.stack([i + box[0], d - len(x) + box[2] - box[0], length])

    def longest(self, box: tuple[int, int, int, int]) -> tuple[int, int, int]:
        """The longest match inside a box by halving, in memory of the texts' size; the earliest in a, then in b."""
        good, bad = 0, min(box[1] - box[0], box[3] - box[2]) + 1
        while bad - good > 1:
            k = (good + bad) // 2
            good, bad = (k, bad) if np.isin(*self.grams(box, k)).any() else (good, k)
        if not good:
            return box[0], box[2], 0
        x, y = self.grams(box, good)
        i = int(np.isin(x, y).argmax())
        return box[0] + i, box[2] + int((y == x[i]).argmax()), good


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """difflib's ratio (autojunk off), for texts of any length; -1 if it is below `least`.

    The longest match of a box splits it in two, as in difflib, but matches of at least k
    characters are found once for a box and cut to the boxes inside it, k falling when none is left."""
    import difflib

    if a == b:
        return 1.0
    total = len(a) + len(b)
    t = _Texts(a, b)
    kinds = int(t.ranks[0].max()) + 1
    x, y = t.grams((0, t.n, 0, t.m), 1)
    if 2.0 * int(np.minimum(np.bincount(x, minlength=kinds), np.bincount(y, minlength=kinds)).sum()) / total < least:
        return -1.0
    matched, open_ = 0, min(t.n, t.m)
    boxes = [((0, t.n, 0, t.m), 0 if open_ > 20_000 else 1, None)]
    while boxes:
        if 2.0 * (matched + open_) / total < least:
            return -1.0
        box, level, runs = boxes.pop()
        alo, ahi, blo, bhi = box
        n, m = ahi - alo, bhi - blo
        if n * m <= _SMALL:
            open_ -= min(n, m)
            if n and m:
                matched += sum(z.size for z in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
            continue
        k = _GRAMS[level]
        if runs is None:
            runs = t.runs(box, k)
        if runs is None:
            i, j, size = t.longest(box)
        else:
            i0, d, length = runs
            s = np.maximum(np.maximum(i0, alo), blo - d)
            size_of = np.minimum(np.minimum(i0 + length, ahi), bhi - d) - s
            keep = size_of >= k
            runs = np.stack([s[keep], d[keep], size_of[keep]])
            if not runs.shape[1]:
                if level + 1 < len(_GRAMS):
                    boxes.append((box, level + 1, None))
                else:
                    open_ -= min(n, m)
                continue
            size = int(runs[2].max())
            s, d, _ = runs[:, runs[2] == size]
            i = int(s.min())
            j = i + int(d[s == i].min())
        open_ -= min(n, m)
        matched += size
        for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
            if (least_side := min(part[1] - part[0], part[3] - part[2])) > 0:
                open_ += least_side
                boxes.append((part, level, runs))
    return 2.0 * matched / total if 2.0 * matched / total >= least else -1.0


def _alike(threshold: float):
    """Rows (a, b, estimate, ta, tb) whose texts are alike enough; two texts at once are held as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            r = np.array([likeness(x.as_py() or "", y.as_py() or "", threshold) for x, y in zip(batch.column(3), batch.column(4))], np.float64)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(r)], names=["a", "b", "estimate", "ratio"])
            yield out.filter(pa.array(r >= threshold))

    return run


def fuzzy_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.9, **near: Any) -> DataFrame:
    """Near pairs whose texts are alike enough."""
    pairs = near_pairs(df, key, text, **near)
    t = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    both = pairs.join(t.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "estimate", "ta", "tb").mapInArrow(_alike(threshold), f"a {kind}, b {kind}, estimate double, ratio double")


def report(df: DataFrame, key: str, text: str, methods: tuple[str, ...] = ("exact", "normalized", "minhash"), similarity: float = SIMILARITY, most: float | None = None, chaos: str | None = None) -> DataFrame:
    """(method, rows, duplicates, rate, uniqueness, breach); an exact hit is no normalised or near one, and deliberate copies are left out."""
    if "embeddings" in methods:
        raise ValueError("the embeddings method needs vectors; see the embedding operator")
    if chaos and chaos in df.columns:
        df = df.where(~F.map_contains_key(chaos, F.lit("@duplicate")))
    hashed = df.select(F.col(key).alias("k"), F.sha2(F.col(text), 256).alias("x"), F.sha2(comparable(F.col(text)), 256).alias("y"))
    marked = with_repeats(with_repeats(hashed, ["x"], "k", "e"), ["y"], "k", "n")
    near = near_pairs(df, key, text, similarity).select(F.col("b").alias("k"), F.lit(True).alias("m")) if "minhash" in methods else None
    marked = marked.join(near, "k", "left") if near is not None else marked.withColumn("m", F.lit(False))
    m = F.coalesce("m", F.lit(False))
    counts = marked.agg(F.count(F.lit(1)).alias("rows"), F.count_if("e").alias("exact"), F.count_if(F.col("n") & ~F.col("e")).alias("normalized"), F.count_if(m & ~F.col("e") & ~F.col("n")).alias("minhash"))
    each = counts.select("rows", F.explode(F.array(*[F.struct(F.lit(x).alias("method"), F.col(x).alias("duplicates")) for x in methods])).alias("x")).select("x.method", "rows", "x.duplicates")
    rate = F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows")).otherwise(0.0)
    return each.select("method", "rows", "duplicates", rate.alias("rate"), (1 - rate).alias("uniqueness"), (rate > most if most is not None else F.lit(False)).alias("breach"))


def bloom_size(n: int, error: float = 0.001) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter; kept for planning, exact grouping needs none."""
    bits = math.ceil(-n * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def textual_fields(fields: dict[str, dict[str, Any]]) -> list[str]:
    """Fields worth checking: model-written, text, or long strings; not unique ones."""
    return [n for n, f in fields.items() if not f.get("unique") and (f.get("generator") == "llm" or f.get("type") == "text" or (f.get("type") == "string" and (f.get("constraints") or {}).get("max_length", 0) >= 80))]


