"""The sixteen transform operations, and pipelines of them. Null passes through all but `nullify`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


class TransformError(ValueError):
    pass


@F.pandas_udf(T.StringType())
def _compress(s, level):  # noqa: ANN001
    import base64
    import zlib

    return s.combine(level, lambda v, k: None if v is None else base64.b64encode(zlib.compress(v.encode(), int(k))).decode())


@F.pandas_udf(T.StringType())
def _decompress(s):  # noqa: ANN001
    import base64
    import zlib

    return s.map(lambda v: None if v is None else zlib.decompress(base64.b64decode(v)).decode())


def _number(name: str, arg: str | None, default: int, low: int | None = None, high: int | None = None) -> int:
    try:
        n = int(arg) if arg not in (None, "") else default
    except ValueError:
        raise TransformError(f"{name}: {arg!r} is not a whole number") from None
    if (low is not None and n < low) or (high is not None and n > high):
        raise TransformError(f"{name}: {n} is out of range")
    return n


def _numeric(name: str, t: T.DataType) -> None:
    if not isinstance(t, T.NumericType):
        raise TransformError(f"{name} needs a number, not {t.simpleString()}")


def _temporal(name: str, x: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return x
    if isinstance(t, T.StringType):
        return x.cast("timestamp_ntz")
    raise TransformError(f"{name} needs a date, not {t.simpleString()}")


def _encode(x: Column, t: T.DataType, arg: str | None) -> Column:
    how, s = arg or "base64", x.cast("string")
    if how == "base64":
        return F.regexp_replace(F.base64(F.encode(s, "UTF-8")), r"\s", "")
    if how == "hex":
        return F.lower(F.hex(F.encode(s, "UTF-8")))
    if how == "url":
        out = F.url_encode(s)
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out
    if how == "json":
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(x)
        if isinstance(t, (T.NumericType, T.BooleanType)):
            return s
        return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    raise TransformError(f"encode: unknown form {how!r}")


def _noise(x: Column, t: T.DataType, arg: str | None) -> Column:
    """Plus or minus arg percent, by a hash of the value itself."""
    _numeric("add_noise", t)
    p = _number("add_noise", arg, 5, 0)
    u = F.conv(F.substring(F.md5(F.concat(F.lit("noise|"), x.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)
    out = x.cast("double") * (1 + (2 * u - 1) * p / 100)
    return F.bround(out).cast("long") if isinstance(t, T.IntegralType) else F.round(out, 6)


def _round(x: Column, t: T.DataType, arg: str | None) -> Column:
    _numeric("round", t)
    n = _number("round", arg, 0)
    out = F.bround(x, n)
    return out.cast("long") if n <= 0 and not isinstance(t, T.DecimalType) else out


def _hash(x: Column, t: T.DataType, arg: str | None) -> Column:
    n = _number("hash", arg, 32, 4, 128)
    return F.substring(F.sha2(x.cast("string"), 256 if n <= 64 else 512), 1, n)


def _mask(x: Column, t: T.DataType, arg: str | None) -> Column:
    n, s = _number("mask", arg, 4, 0), x.cast("string")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(s) - n, F.lit(0))), F.right(s, F.lit(n)))


OPERATIONS = {
    "lowercase": lambda x, t, a: F.lower(x.cast("string")),
    "uppercase": lambda x, t, a: F.upper(x.cast("string")),
    "title": lambda x, t, a: tx.title(x.cast("string")),
    "strip": lambda x, t, a: tx.strip(x.cast("string")),
    "truncate": lambda x, t, a: F.substring(x.cast("string"), 1, _number("truncate", a, 50, 0)),
    "normalize": lambda x, t, a: tx.normalize(x.cast("string")),
    "slug": lambda x, t, a: tx.slug(x.cast("string")),
    "hash": _hash,
    "mask": _mask,
    "round": _round,
    "format_date": lambda x, t, a: F.date_format(_temporal("format_date", x, t), tx.date_pattern(a or "%Y-%m-%d")),
    "encode": _encode,
    "compress": lambda x, t, a: _compress(x.cast("string"), F.lit(_number("compress", a, 6, 1, 9))),
    "decompress": lambda x, t, a: _decompress(x.cast("string")),
    "add_noise": _noise,
    "nullify": lambda x, t, a: F.lit(None).cast(t),
}
ALIASES = {"lower": "lowercase", "upper": "uppercase", "trim": "strip", "trunc": "truncate", "redact": "mask", "date_format": "format_date", "b64": "encode", "noise": "add_noise", "null": "nullify"}


def parse(step: str) -> tuple[str, str | None]:
    name, _, arg = step.strip().partition(":")
    name = ALIASES.get(name.strip(), name.strip())
    if name not in OPERATIONS:
        raise TransformError(f"unknown operation {name!r}; known: {', '.join(OPERATIONS)}")
    return name, arg or None


def is_pipeline(source: str) -> bool:
    """Whether every step between bars is an operation."""
    try:
        return all(parse(s) for s in source.split("|"))
    except TransformError:
        return False




def apply(x: Column, t: T.DataType, steps: list[str]) -> tuple[Column, T.DataType]:
    """The value after each step in turn, and its type."""
    for s in steps:
        name, arg = parse(s)
        x = OPERATIONS[name](x, t, arg)
        if name == "round":
            n = int(arg or 0)
            t = t if isinstance(t, T.DecimalType) else T.LongType() if n <= 0 else t
        elif name == "add_noise":
            t = T.LongType() if isinstance(t, T.IntegralType) else T.DoubleType()
        elif name != "nullify":
            t = T.StringType()
    return x, t
