"""Connected components of a graph of long ids by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that a task contracts at once.
CONTRACT_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges' nodes that are not roots; the root is the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task replaces what it has of a component by a star; connectivity stays."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        e = np.concatenate(held, axis=1)
        child, root = forest(e[0], e[1])
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
        if size >= CONTRACT_EDGES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def contract(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_contract, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root): every node of the edges with the least node of its component.

    Minima are combined before each shuffle and joined back, so a hub is a skewed join, which
    Spark splits from its own threshold of bytes on, and not a group in one task. Each
    round is written to the shared folder; rounds grow with the logarithm of the longest
    path, and more than `most` raise. Loops of one node are dropped; nulls must not occur."""
    now = scratch.save(contract(edges.where("a <> b")))
    mark = None
    for _ in range(most):
        # a forest of stars is reached when every second end is a root: no node stands on both sides
        seen = now.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen.n == 0 or (seen.n, seen.s) == mark:
            break
        mark = (seen.n, seen.s)
        nxt = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now = nxt
    else:
        raise RuntimeError(f"components not found in {most} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
