"""Near-duplicates by an LSH forest: sorted orders of MinHash signatures, with a depth for each region.

1. Each text becomes its set of word shingles, a 64-bit name of that set and a signature:
   TREES trees of LEVELS values. Texts of one set are one node from here on.
2. Each tree is an order of all nodes by its values. Rows are dealt by range of the
   order, ties by node, so a group of any size is spread. Nodes in a row that share
   `depth` values are a region. Two neighbouring regions that are sparse go up to the
   depth of their longest common prefix, not above SHALLOWER levels up, and are one.
   Regions of all trees that meet in a node make families.
3. A family's full sets are compared exactly, by products of their incidence matrices; a
   forest of the links leaves the task, never the pairs. A family of more than BLOCK sets
   is cut into its different regions if they hold fewer pairs than it, so families that
   boilerplate chains together don't grow with the corpus. What is above BLOCK sets or
   BLOCK_BYTES is cut into blocks, each pair of blocks a group of its own, so no pair is
   left out.
4. Links give components.

`depth` follows from the similarity: a pair just at the threshold is in one region of some
tree with a probability of at least RECALL. It is the deepest that a region may be.

Defined results: null, empty and blank texts have no shingles and are linked with nothing;
fewer words than a shingle has are one shingle; equal sets are linked; rows are documents,
so repeated rows and keys are linked by their texts alone; a null key has no part in the
least key of a component, which is null if all are; an empty table gives an empty result;
other columns pass through (keep_one: rows of a key stay or go together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE_LOWER, NOT_SPACE, Scratch, chunks, groups, mix, partitions, prefix_hash, span_hash, text_buffer, words
from .components import components, forest

SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
TREES, LEVELS, RECALL = 32, 8, 0.9999
#: A region of at most SPARSE nodes joins its nearest neighbour, if they share all but so many of the depth's values.
SPARSE, SHALLOWER = 4, 2
#: Sets, and bytes of them, that a task compares with each other or with as many.
BLOCK, BLOCK_BYTES = 2048, 24 << 20
#: Columns of an incidence matrix at once.
_COLUMNS = 4096
SEED = 20_240_517
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.int64).astype(np.uint64)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def depth_for(similarity: tuple[int, int]) -> int:
    """The deepest prefix at which a pair of that similarity meets in some tree with probability RECALL."""
    s = similarity[0] / similarity[1]
    fine = [k for k in range(1, LEVELS) if 1 - (1 - s**k) ** TREES >= RECALL]
    return max(fine, default=1)


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of each text, sorted by text and hash."""
    n = len(off) - 1
    s, e, of = words(buf, off, NOT_SPACE)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = span_hash(prefix_hash(buf, BYTE_VALUE_LOWER), s, e)
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    m = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.cumsum(m)
    doc = np.repeat(np.arange(n), m)
    at = np.arange(to[-1]) - (to - m)[doc] + first[doc]
    width = np.minimum(count, k)[doc]
    x = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x += np.where(j < width, h[np.minimum(at + j, len(h) - 1)], 0).astype(np.uint64) * _PLACE[j]
    x = mix(x)
    order = np.argsort(x, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], doc[new]


def names(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        count = np.diff(np.append(starts, len(x))).astype(np.uint64)
        return mix(total + count * _PLACE[60]).view(np.int64)


def signatures(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum: sets x (TREES * LEVELS)."""
    out = np.empty((len(starts), TREES * LEVELS), np.uint16)
    v = np.empty_like(x)
    with np.errstate(over="ignore"):
        for f in range(TREES * LEVELS):
            np.multiply(x, _A[f], out=v)
            np.add(v, _B[f], out=v)
            low = np.minimum.reduceat(v, starts)
            out[:, f] = ((low ^ (low >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _sets(batch_col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, behind, shingles, texts that have any, where theirs begin) by runs of texts."""
    buf, off, _ = text_buffer(batch_col)
    for i, j in chunks(off):
        x, doc = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
        has, starts = np.unique(doc, return_index=True)
        yield i, j, x, has, starts


def signed(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, n, node, sig) of each row; node and sig are null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, has, starts in _sets(batch.column(1), k):
                n, node, sig = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), [None] * (j - i)
                if len(has):
                    n[has] = np.diff(np.append(starts, len(x)))
                    node[has] = names(x, starts)
                    for d, row in zip(has.tolist(), signatures(x, starts), strict=True):
                        sig[d] = row.tobytes()
                cols = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(node, mask=n == 0), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "node", "sig"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n long, node long, sig binary")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the tree's eight values packed in two longs that sort by prefix."""
    shift = np.array([48, 32, 16, 0], np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        buf, _, _ = text_buffer(batch.column(1))
        sig = buf.view(np.uint16).reshape(n, TREES, LEVELS).astype(np.uint64)
        k1 = (sig[:, :, :4] << shift).sum(2, dtype=np.uint64)
        k2 = (sig[:, :, 4:] << shift).sum(2, dtype=np.uint64)
        cols = [np.tile(np.arange(TREES, dtype=np.int32), n), k1.ravel().view(np.int64), k2.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), TREES)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tree", "k1", "k2", "node"])


def common(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix, in values, of each row and the next."""
    out = np.zeros(max(len(k1) - 1, 0), np.int64)
    open_ = np.ones(len(out), bool)
    for k in (k1, k2):
        x = k[1:].view(np.uint64) ^ k[:-1].view(np.uint64)
        for level in range(4):
            open_ &= (x >> np.uint64(48 - 16 * level)) == 0
            out += open_
    return out


def region_of(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit name of the first `depth` values of a tree."""
    drop1, drop2 = np.uint64(16 * max(0, 4 - depth)), np.uint64(16 * (8 - max(depth, 4)))
    p1 = (k1.view(np.uint64) >> drop1) << drop1
    p2 = (k2.view(np.uint64) >> drop2) << drop2 if depth > 4 else np.zeros(len(k2), np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(p1 + tree.astype(np.uint64) * _PLACE[62]) + p2).view(np.int64)


def joined(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Which rows of an order are one region with the next, from the common prefixes of neighbours.

    Where `depth` values are shared, always. Where two regions meet in fewer, if both are
    sparse and neither shares more with the region on its other side."""
    deep = lcp >= depth
    gap = np.flatnonzero(~deep)
    if not len(gap):
        return deep
    shared = lcp[gap]
    size = np.diff(np.concatenate([[0], gap + 1, [len(lcp) + 1]]))
    around = np.concatenate([[-1], shared, [-1]])
    nearest = (shared > around[:-2]) & (shared >= around[2:])
    deep[gap[nearest & (shared >= max(1, depth - SHALLOWER)) & (np.maximum(size[:-1], size[1:]) <= SPARSE)]] = True
    return deep


def _neighbours(depth: int):
    """Over a sorted run of the orders: nodes (a, b, -) that are in one region, and one node (a, -, region) of the run's first and last regions, which may go on elsewhere."""

    def rows(a, b, region):
        n, m = len(b), len(region)
        cols = [pa.array(a), pa.array(np.concatenate([b, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([np.zeros(n, np.int64), region]), mask=np.arange(n + m) < n)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "region"])

    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = [batch.column(c).to_numpy() for c in range(4)]
            if last is None:
                yield rows(t[3][:1], none, region_of(*(c[:1] for c in t[:3]), depth))
            else:
                t = [np.concatenate([x, y]) for x, y in zip(last, t, strict=True)]
            tree, k1, k2, node = t
            lcp = np.where(tree[1:] == tree[:-1], common(k1, k2), 0)
            i = np.flatnonzero(joined(lcp, depth) & (node[1:] != node[:-1]))
            if len(i):
                child, root = forest(node[i], node[i + 1])
                yield rows(child, root, none)
            last = [c[-1:] for c in t]
        if last is not None:
            yield rows(last[3], none, region_of(*last[:3], depth))

    return run


def _regions(depth: int):
    """(node, family, region) of each node and tree, from (node, sig, family)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for t in _orders(iter([part])):
                    tree, k1, k2, node = (t.column(c).to_numpy() for c in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(part.column(2).to_numpy(), TREES)), pa.array(region_of(tree, k1, k2, depth))], names=["node", "family", "region"])

    return run


def grouped(sets: DataFrame, one: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(node, family) with families of more than BLOCK sets cut into their different regions where those hold fewer pairs."""
    whole = sets.select("node", "family")
    large = scratch.save(whole.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    if large.isEmpty():
        return whole
    held = one.select("node", "sig").join(whole.join(large.select("family"), "family"), "node").select("node", "sig", "family")
    rows = scratch.save(held.mapInArrow(_regions(depth), "node long, family long, region long"))
    each = rows.groupBy("family", "region").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of")).where("n > 1")
    different = scratch.save(each.groupBy("family", "n", "of").agg(F.min("region").alias("region")))
    pairs = different.groupBy("family").agg(F.sum(F.col("n").cast("double") ** 2).alias("pairs"))
    cut = scratch.save(large.join(pairs, "family").where(F.col("pairs") < F.col("size").cast("double") ** 2).select("family"))
    parts = rows.join(different.join(cut, "family", "left_semi").select("region"), "region").select("node", F.col("region").alias("family"))
    return whole.join(cut, "family", "left_anti").select("node", "family").union(parts)


def overlaps(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x n sizes of the intersections of sets, given as elements and the set each is of."""
    kinds, at = np.unique(x, return_inverse=True)
    shared = np.bincount(at, minlength=len(kinds)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, of = column[at[keep]], of[keep]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((n, n), np.float32)  # whole numbers up to 2**24 are exact
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        i, j = np.searchsorted(at, [c, c + _COLUMNS])
        m = np.zeros((n, _COLUMNS if at[-1] >= c + _COLUMNS else int(at[-1]) + 1 - c), np.float32)
        m[of[i:j], at[i:j] - c] = 1
        out += m @ m.T
    return out


def _compare(similarity: tuple[int, int]):
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["family", "i", "j"]):
            n = t.num_rows
            if n < 2:
                continue
            node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
            buf, off, _ = text_buffer(t.column("s"))
            size = np.diff(off) // 8
            both = overlaps(buf.view(np.uint64), np.repeat(np.arange(n), size), n).astype(np.int64)
            ok = den * both >= num * (size[:, None] + size[None, :] - both)
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                ok &= block[:, None] != block[None, :]
            a, b = np.nonzero(np.triu(ok, 1))
            if len(a):
                child, root = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root])], names=["a", "b"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy()
            for i, j, x, has, starts in _sets(batch.column(2), k):
                if not len(has):
                    continue
                name = names(x, starts)
                ends = np.append(starts, len(x))
                mine = np.flatnonzero(name == want[i:j][has])
                sets = [x[ends[m] : ends[m + 1]].tobytes() for m in mine.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(name[mine]), batch.column(1).slice(i, j - i).take(pa.array(has[mine])), pa.array(sets, pa.binary())], names=["node", "family", "s"])

    return run


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, n, component) for every row: the number of shingles and the least key that is reachable by links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    depth, parts = depth_for(similarity), partitions(spark)
    rows = scratch.save(signed(docs, key, text, k))
    one = scratch.save(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("rep"), F.first("sig").alias("sig")))

    order = one.select("node", "sig").mapInArrow(_orders, "tree int, k1 long, k2 long, node long")
    order = order.repartitionByRange(parts, "tree", "k1", "k2", "node").sortWithinPartitions("tree", "k1", "k2", "node")
    near = scratch.save(order.mapInArrow(_neighbours(depth), "a long, b long, region long"))
    ends = near.where("b is null")  # two rows for each partition
    first = ends.groupBy("region").agg(F.min("a").alias("b"))
    edges = near.where("b is not null").select("a", "b").union(ends.join(first, "region").select("a", first["b"]))
    family = components(edges, scratch).select("node", F.col("root").alias("family"))

    # full sets of the nodes that have any candidate
    wanted = one.select("node", "rep").join(family, "node")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("t"))
    full = wanted.join(texts, wanted["rep"].eqNullSafe(texts["rep"])).select("node", "family", "t")
    sets = scratch.save(full.mapInArrow(_full_sets(k), "node long, family long, s binary").dropDuplicates(["node"]))
    member = grouped(sets, one, depth, scratch)
    sized = member.join(sets.select("node", F.octet_length("s").alias("bytes")), "node")
    stats = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = member.join(stats, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "family", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wide = sets.select("node", "s").join(dealt, "node").repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = wide.mapInArrow(_compare(similarity), "a long, b long")
    root = components(links, scratch)

    least = one.select("node", "rep").join(root, "node").groupBy("root").agg(F.min("rep").alias("component"))
    of_node = root.join(least, "root").select("node", "component")
    of_all = scratch.save(one.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("component", "rep").alias("component")))
    return rows.select("key", "n", "node").join(of_all, "node", "left").select("key", "n", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    got = linked(docs, key, text, k, similarity)
    return got.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows that have the least key of their component, with all their columns."""
    kept = linked(docs, key, text, k, similarity).where(F.col("key").eqNullSafe(F.col("component"))).select(F.col("key").alias("__kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["__kept_key"]), "left_semi")
