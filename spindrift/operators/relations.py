"""References: which parent a row has, and what it reads of it.

The parent's index is arithmetic on the child's, so a parent's column is, in this order,
an expression of that index substituted for its own (no join at all), a join with a
parent that Spark may broadcast by its measured size, or a shuffled join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.hashing import Draws


def parent_index(index: Column, n: int, draws: Draws, mode: str = "uniform", skew: float = 1.5) -> Column:
    """uniform; skewed (n * u ** e); sequential or round_robin (index mod n)."""
    if n <= 0:
        raise ValueError("a reference needs at least one parent")
    if n == 1:
        return F.lit(0).cast("long")
    if mode == "uniform":
        return F.least(F.floor(draws.u() * n).cast("long"), F.lit(n - 1))
    if mode == "skewed":
        e = min(20.0, skew) if skew >= 1 else 1 / max(skew, 0.05)
        return F.least(F.floor(F.pow(draws.u(), F.lit(float(e))) * n).cast("long"), F.lit(n - 1))
    if mode in ("sequential", "round_robin"):
        return index % n
    raise ValueError(f"unknown reference distribution {mode!r}")


def self_index(index: Column, n: int, draws: Draws) -> Column:
    """A lower index of the same entity; the first row has none."""
    return F.when(index > 0, F.least(F.floor(draws.u() * F.least(F.lit(n), index)).cast("long"), index - 1))


def read_parent(child: DataFrame, at: str, parent: DataFrame, parent_at: str, columns: dict[str, str], unavailable: str = "null") -> DataFrame:
    """child with parent columns (new name: parent's name), by index."""
    p = parent.select(F.col(parent_at).alias("__at"), *[F.col(c).alias(n) for n, c in columns.items()])
    out = child.join(p, child[at] == p["__at"], "left").drop("__at")
    if unavailable == "error":
        for n in columns:
            out = out.withColumn(n, F.when(F.col(at).isNotNull() & F.col(n).isNull(), F.raise_error(F.lit(f"{n}: the parent is missing")).cast(out.schema[n].dataType)).otherwise(F.col(n)))
    return out
