"""Near-duplicate embeddings by randomly rotated binary codes with correction factors.

1. Equal vectors are one node with a number of copies.
2. A node's unit vector is padded and rotated at random; its code is the signs of the
   result, and the stored factor is how much of the vector the code keeps. With them the
   inner product with any other vector has an unbiased estimate and a confidence bound.
3. Bands of the code's bits deal nodes into buckets. Bits and number of bands follow from
   the number of nodes and the threshold, so that a bucket holds about BUCKET nodes and a
   pair at the threshold shares one with probability RECALL.
4. Only codes and factors are dealt into buckets. There the share of different bits of each
   pair is held against that of a pair at the threshold (its arcsine law), and a node none
   of whose pairs is within SIGMAS is done with. Vectors are fetched for the others: their
   unbiased estimates and bounds decide which pairs are recomputed exactly in double
   precision, in the first band that the pair shares. Sums and a forest of links leave a
   task, never the pairs. Buckets of more than BLOCK nodes are cut into blocks, each pair
   of blocks a group of its own.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths don't link; components are scaled by a
power of two first, so squares neither overflow nor vanish; rows are vectors, so repeated
rows link with each other; a null key has no part in a component's least key; an empty
table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups, partitions, prefix_hash, span_hash, text_buffer
from .components import components, forest

THRESHOLD, RECALL = 0.95, 0.99999
BUCKET, BLOCK = 512, 2048
LEAST_BITS, SIGMAS, SEED = 128, 6.0, 99
_PAIRS = 200_000


@dataclass(frozen=True)
class Plan:
    bits: int  # in a band
    bands: int
    width: int  # bits of a code

    @classmethod
    def of(cls, nodes: int, threshold: float) -> Plan:
        bits = int(np.clip(round(np.log2(max(nodes, 1) / BUCKET)), 4, 40))
        same = (1 - np.arccos(threshold) / np.pi) ** bits
        bands = int(np.ceil(np.log(1 - RECALL) / np.log(1 - same)))
        return cls(bits, bands, max(LEAST_BITS, bits * bands))


_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, width: int) -> np.ndarray:
    """width x dim with orthonormal columns (rows if dim is larger: a projection, scaled to keep lengths on average)."""
    if (dim, width) not in _rotations:
        g = np.random.default_rng(SEED + 1_000 * dim + width).standard_normal((max(width, dim), min(width, dim)))
        q = np.linalg.qr(g)[0]
        _rotations[dim, width] = q if width >= dim else q.T * np.sqrt(dim / width)
    return _rotations[dim, width]


def encode(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, signs as booleans, correction factors)."""
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1], width).T
    return y, y > 0, np.abs(y).sum(1) / np.sqrt(width)


def estimates(y: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner product of each row's vector with each column's, from the column's code; and the columns' standard errors."""
    width = y.shape[1]
    code = (signs * np.float32(2) - np.float32(1)) / np.float32(np.sqrt(width))
    e = (y.astype(np.float32) @ code.T) / factor.astype(np.float32)
    f2 = np.minimum(factor**2, 1 - 1e-9)
    return e, np.sqrt((1 - f2) / f2 / max(width - 1, 1))


def buckets(signs: np.ndarray, plan: Plan, dim: int) -> np.ndarray:
    """nodes x bands: the bits of each band and the dimension."""
    b = signs[:, : plan.bits * plan.bands].reshape(-1, plan.bands, plan.bits).astype(np.int64)
    return (b << np.arange(plan.bits)).sum(2) | (dim << 41)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, vec): node and vec are null for vectors that link with nothing."""
    for batch in batches:
        key, col = batch.column(0), batch.column(1)
        n = batch.num_rows
        out: list[bytes | None] = [None] * n
        if n:
            size = np.where(col.is_valid().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            flat = col.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            ok = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            most = np.zeros(n)
            some_rows = np.flatnonzero(size)
            if len(some_rows):
                most[some_rows] = np.maximum.reduceat(np.abs(flat), at[some_rows])
            exponent = np.frexp(np.where(ok, most, 1.0))[1]
            flat = np.ldexp(np.where(np.repeat(ok, size), flat, 0.0), -np.repeat(exponent, size)) + 0.0  # -0 is 0
            for i in np.flatnonzero(ok).tolist():
                out[i] = flat[at[i] : at[i + 1]].tobytes()
        vec = pa.array(out, pa.binary())
        buf, off, valid = text_buffer(vec)
        node = span_hash(prefix_hash(buf), off[:-1], off[1:]).view(np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([key, pa.array(node, mask=~valid), vec], names=["key", "node", "vec"])


def _matrix(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off, _ = text_buffer(vec)
    return buf, off


def _index(plan: Plan):
    """(node, copies, code, factor, buckets) of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _matrix(batch.column(2))
            dim = np.diff(off) // 8
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                x = np.stack([buf[off[i] : off[i + 1]].view(np.float64) for i in rows.tolist()])
                _, signs, factor = encode(x, plan.width)
                bucket = buckets(signs, plan, d)
                take = pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * plan.bands, pa.int32()), pa.array(bucket.ravel()))
                codes = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), codes, pa.array(factor), lists], names=["node", "copies", "code", "factor", "buckets"])

    return run


_GROUP = ["band", "bucket", "i", "j"]


def _signs(code: pa.ChunkedArray, plan: Plan) -> np.ndarray:
    buf, off = _matrix(code.combine_chunks())
    return np.unpackbits(buf.reshape(len(off) - 1, -1), axis=1)[:, : plan.width].astype(bool)


def _screen(plan: Plan, threshold: float):
    """Of each group, the rows of nodes with a pair whose codes could be of vectors at the threshold."""
    apart = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    most = apart + SIGMAS * np.sqrt(apart * (1 - apart) / plan.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, _GROUP):
            n = t.num_rows
            if n < 2:
                continue
            block, mixed = t.column("block").to_numpy(), t.column("i")[0] != t.column("j")[0]
            code = _signs(t.column("code"), plan) * np.float32(2) - np.float32(1)
            left = np.zeros(n, bool)
            for lo in range(0, n, 512):
                hi = min(n, lo + 512)
                maybe = code[lo:hi] @ code.T >= np.float32(plan.width * (1 - 2 * most))
                maybe[np.arange(hi - lo), np.arange(lo, hi)] = False
                if mixed:
                    maybe &= block[None, :] != block[lo:hi, None]
                left[lo:hi] = maybe.any(1)
            if left.any():
                yield from t.filter(pa.array(left)).combine_chunks().to_batches()

    return run


def _compare(plan: Plan, threshold: float):
    """Links within each group of a sorted stream: (a, b, links) with b the root of a's links in the group."""

    def group(band: int, mixed: bool, block: np.ndarray, node: np.ndarray, copies: np.ndarray, x: np.ndarray, signs: np.ndarray, factor: np.ndarray):
        n = len(node)
        norm = np.linalg.norm(x, axis=1)
        y = (x / norm[:, None]) @ rotation(x.shape[1], plan.width).T
        bucket = buckets(signs, plan, x.shape[1])
        links = np.zeros(n, np.int64)
        ea, eb = [], []
        for lo in range(0, n, 512):
            hi = min(n, lo + 512)
            e, err = estimates(y[lo:hi], signs, factor)
            back, back_err = estimates(y, signs[lo:hi], factor[lo:hi])
            upper = (e + back.T) / 2 + SIGMAS * (err[None, :] + back_err[:, None]) / 2
            maybe = upper >= threshold
            maybe &= np.arange(n)[None, :] > np.arange(lo, hi)[:, None]
            if mixed:
                maybe &= block[None, :] != block[lo:hi, None]
            p, q = np.nonzero(maybe)
            p += lo
            for k in range(0, len(p), _PAIRS):
                a, b = p[k : k + _PAIRS], q[k : k + _PAIRS]
                if band:
                    new = ~(bucket[a, :band] == bucket[b, :band]).any(1)
                    a, b = a[new], b[new]
                cos = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
                a, b = a[cos >= threshold], b[cos >= threshold]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                if len(a):  # a forest of them is enough
                    child, root = forest(a, b)
                    ea.append(child)
                    eb.append(root)
        if not ea:
            return None
        child, root = forest(np.concatenate(ea), np.concatenate(eb))
        to = np.arange(n)
        to[child] = root
        has = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(node[to[has]]), pa.array(links[has])], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, _GROUP):
            n = t.num_rows
            if n < 2:
                continue
            c = {k: t.column(k).to_numpy() for k in ("block", "node", "copies", "factor")}
            buf, _ = _matrix(t.column("vec").combine_chunks())
            band, mixed = t.column("band")[0].as_py(), t.column("i")[0] != t.column("j")[0]
            out = group(band, mixed, c["block"], c["node"], c["copies"], buf.view(np.float64).reshape(n, -1), _signs(t.column("code"), plan), c["factor"])
            if out is not None:
                yield out

    return run


def linked(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, links, component) for every row."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark, "embeddings"), partitions(spark)
    kind = dict(vectors.dtypes)[key]
    rows = scratch.save(vectors.select(F.col(key).alias("key"), F.col(embedding).alias("e")).mapInArrow(_clean, f"key {kind}, node long, vec binary"))
    one = scratch.save(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("rep"), F.first("vec").alias("vec")))
    plan = Plan.of(one.count(), threshold)
    index = scratch.save(one.select("node", "copies", "vec").mapInArrow(_index(plan), "node long, copies long, code binary, factor double, buckets array<long>"))

    # blocks of crowded buckets are settled on narrow rows, then joined to the index by node
    narrow = index.select("node", F.posexplode("buckets").alias("band", "bucket"))
    crowd = narrow.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    dealt = narrow.join(crowd, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "band", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    coded = index.drop("buckets").join(dealt, "node").select("node", "copies", "code", "factor", "block", *_GROUP)
    kind_of = "node long, copies long, code binary, factor double, block int, band int, bucket long, i int, j int"
    left = scratch.save(coded.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_screen(plan, threshold), kind_of))
    wide = left.join(one.select("node", "vec"), "node").repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
    found = scratch.save(wide.mapInArrow(_compare(plan, threshold), "a long, b long, links long"))

    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    root = components(found.select("a", "b"), scratch)
    least = one.select("node", "rep").join(root, "node").groupBy("root").agg(F.min("rep").alias("component"))
    of_node = root.join(least, "root").select("node", "component")
    of_all = one.select("node", "rep", "copies").join(links, "node", "left").join(of_node, "node", "left")
    of_all = scratch.save(of_all.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    out = rows.select("key", "node").join(of_all, "node", "left")
    return out.select("key", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def digest(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    got = linked(vectors, key, embedding, threshold)
    return got.select(F.col("key").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
