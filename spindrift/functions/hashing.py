"""Deterministic uniforms: a draw is a hash of what it is for, never of where or when it is made.

Two interchangeable families: `fast` (xxhash64) and `portable` (md5), the latter giving
the same doubles in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAST, PORTABLE = "fast", "portable"
_FAST_SCALE, _PORTABLE_SCALE = 2.0**-53, 4503599627370496.0


class Draws:
    """The draws of one field: draw k of a row is `u(k)`, in [0, 1). Levels of the key (seed,
    entity, index, field, draw) are separate arguments, so that their boundaries count."""

    def __init__(self, seed: int | str, entity: str, index: Column, field: str, mode: str = FAST, namespace: str | None = None):
        if mode not in (FAST, PORTABLE):
            raise ValueError(f"unknown mode {mode!r}")
        self.seed, self.entity, self.index, self.field, self.mode, self.namespace = seed, entity, index, field, mode, namespace

    def _parts(self, k: int | str | Column) -> list[Column]:
        names = [F.lit(str(self.seed)), F.lit(self.entity)] + ([F.lit(f"ns:{self.namespace}")] if self.namespace else [])
        return [*names, self.index, F.lit(self.field), k if isinstance(k, Column) else F.lit(str(k))]

    def bits(self, k: int | str | Column = 0) -> Column:
        """64 hashed bits as a long."""
        if self.mode == FAST:
            return F.xxhash64(*self._parts(k))
        return F.conv(F.substring(F.md5(self._joined(k)), 17, 15), 16, 10).cast("long")

    def _joined(self, k: int | str | Column) -> Column:
        return F.concat_ws("|", *[p.cast("string") for p in self._parts(k)])

    def u(self, k: int | str | Column = 0) -> Column:
        if self.mode == FAST:
            return F.shiftrightunsigned(F.xxhash64(*self._parts(k)), 11).cast("double") * F.lit(_FAST_SCALE)
        return F.conv(F.substring(F.md5(self._joined(k)), 1, 13), 16, 10).cast("double") / F.lit(_PORTABLE_SCALE)

    def hex(self, k: int | str | Column = 0) -> Column:
        """32 hexadecimal digits."""
        if self.mode == PORTABLE:
            return F.md5(self._joined(k))
        halves = [F.lpad(F.lower(F.hex(F.xxhash64(*self._parts(k), F.lit(h)))), 16, "0") for h in ("hi", "lo")]
        return F.concat(*halves)

    def below(self, n: int | Column, k: int | str | Column = 0) -> Column:
        """A whole number in [0, n)."""
        return F.floor(self.u(k) * n).cast("long")

    def sub(self, label: str) -> Draws:
        return Draws(self.seed, self.entity, self.index, f"{self.field}/{label}", self.mode, self.namespace)


def pick(values: list, at: Column) -> Column:
    """The literal at a 0-based place."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
