"""Array expressions whose cost doesn't grow with the square of the size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def blocks(items: Column) -> Column:
    """An array in runs of about the square root of its size, so that folds which append cost
    n * sqrt(n) in the size and not its square. A run has an even number of items."""
    size = F.size(items)
    step = F.greatest(F.lit(2), (F.ceil(F.sqrt(size) / 2) * 2).cast("int"))
    return let(step, lambda n: F.transform(F.sequence(F.lit(0), F.ceil(size / n).cast("int") - 1), lambda b: F.slice(items, b * n + 1, n)))
