"""String pieces with Python's meaning where Spark's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strftime directives and the patterns of date_format that mean the same.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "B": "MMMM", "b": "MMM",
    "A": "EEEE", "a": "EEE", "I": "hh", "p": "a", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%",
}


def title(x: Column) -> Column:
    """Upper case after anything but a letter."""
    parts = F.split(F.lower(x), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def zero_pad(x: Column, width: int) -> Column:
    """Left-pads with 0 and never cuts; a sign stays in front."""
    s = x.cast("string")
    negative = s.startswith("-")
    digits = F.when(negative, F.substring(s, 2, 1 << 30)).otherwise(s)
    padded = F.when(F.length(s) < width, F.lpad(digits, width, "0")).otherwise(digits)
    signed = F.when(F.length(s) < width, F.concat(F.lit("-"), F.lpad(digits, width - 1, "0"))).otherwise(s) if width > 1 else s
    return F.when(negative, signed).otherwise(padded)


def date_pattern(fmt: str) -> str:
    """A strftime format as a pattern of date_format; other letters are quoted."""
    out, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in STRFTIME:
                raise ValueError(f"unsupported date directive %{fmt[i + 1]}")
            out.append(STRFTIME[fmt[i + 1]])
            i += 2
            continue
        out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
        i += 1
    return "".join(out)




@F.pandas_udf(T.StringType())
def _nfkc(s):  # noqa: ANN001
    import unicodedata

    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _nfkc_fold(s):  # noqa: ANN001
    import unicodedata

    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def normalize(x: Column) -> Column:
    """NFKC with white space collapsed; texts in ASCII never leave the JVM."""
    n = F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_nfkc(x))
    return strip(F.regexp_replace(n, r"\s+", " "))


def comparable(x: Column) -> Column:
    """For duplicate detection: NFKC and case folded, punctuation as spaces, collapsed."""
    n = F.when(x.rlike(r"^\p{ASCII}*$"), F.lower(x)).otherwise(_nfkc_fold(x))
    return strip(F.regexp_replace(F.regexp_replace(n, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))


# Template filters, applied left to right: name -> function of the value and an optional argument.
FILTERS = {
    "lower": lambda x, a: F.lower(x),
    "upper": lambda x, a: F.upper(x),
    "title": lambda x, a: title(x),
    "strip": lambda x, a: strip(x),
    "slug": lambda x, a: slug(x),
    "initial": lambda x, a: F.substring(x, 1, 1),
    "trunc": lambda x, a: F.substring(x, 1, int(a or 10)),
    "pad": lambda x, a: zero_pad(x, int(a or 2)),
    "nospace": lambda x, a: F.regexp_replace(x, r"\s+", ""),
}


def apply_filters(x: Column, filters: list[str]) -> Column:
    for f in filters:
        name, _, arg = f.partition(":")
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}; known: {', '.join(FILTERS)}")
        x = FILTERS[name](x, arg or None)
    return x
