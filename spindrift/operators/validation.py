"""Validation as columns: structure with repair, constraints, assertions, uniqueness,
references, distributions, privacy, policies and the quality report.

A check is a boolean column named after what it finds; nothing is collected but reports.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import types as ty
from spindrift.functions.expressions import condition, names_in

POLICIES = ("abort", "retry", "skip", "placeholder", "incomplete", "report")


@dataclass(frozen=True)
class Check:
    field: str
    category: str  # structural, constraint, referential, logical, privacy, uniqueness
    message: str
    fails: Column
    severity: str = "error"


#: Checks that a project asks for by name in quality.validators: make(frame, options) -> list of Check.
VALIDATORS: dict[str, Any] = {}


# ---------------------------------------------------------------- structure and constraints
def structural(x: Column, name: str, type_name: str, nullable: bool) -> tuple[Column, list[Check]]:
    """The value repaired by coercion where its check fails, and what remains wrong."""
    ok = ty.check(x, type_name)
    repaired = F.when(ok, x.cast("string")).otherwise(ty.coerce(x, type_name).cast("string")) if type_name not in ("geo_point", "array", "object", "binary") else x
    checks = [Check(name, "structural", "wrong type, repaired", ~ok & repaired.isNotNull(), "warning"), Check(name, "structural", "wrong type", ~ok & repaired.isNull())]
    if not nullable:
        checks.append(Check(name, "structural", "null", x.isNull()))
    return repaired, checks


def constraints(x: Column, name: str, spec: dict[str, Any], textual: bool = False, listed: bool = False) -> list[Check]:
    """min, max, min_length, max_length, pattern (anywhere), enum, forbidden, multiple_of. Null passes."""
    out = []
    size = F.size(x) if listed else F.length(x.cast("string"))
    as_number = x.try_cast("double") if textual else x

    def add(key: str, fails: Column) -> None:
        out.append(Check(name, "constraint", key, F.coalesce(fails, F.lit(False))))

    for key, v in spec.items():
        if v is None or key == "precision":
            continue
        if key == "min":
            add(key, (as_number if isinstance(v, (int, float)) else x) < F.lit(v))
        elif key == "max":
            add(key, (as_number if isinstance(v, (int, float)) else x) > F.lit(v))
        elif key == "min_length":
            add(key, size < v)
        elif key == "max_length":
            add(key, size > v)
        elif key == "pattern":
            add(key, ~x.cast("string").rlike(v))
        elif key == "enum":
            add(key, ~x.isin(*v))
        elif key == "forbidden":
            add(key, x.isin(*v))
        elif key == "multiple_of":
            r = F.abs(x.cast("double") % F.lit(float(v)))
            add(key, (r > 1e-9) & (F.abs(r - abs(float(v))) > 1e-9))
        else:
            raise ValueError(f"{name}: unknown constraint {key!r}")
    return out


def assertions(df: DataFrame, sources: Iterable[str], damaged: str | None = None) -> list[Check]:
    """Expressions that must hold; rows whose damage touches a name they read are left out."""
    out = []
    for s in sources:
        fails = ~condition(s, df.schema, s)
        if damaged and damaged in df.columns:
            names = names_in(s)[0]
            touched = reduce(lambda a, b: a | b, [F.map_contains_key(damaged, F.lit(n)) for n in sorted(names)], F.lit(False))
            fails = fails & ~F.coalesce(touched, F.lit(False))
        out.append(Check("*", "logical", s, fails))
    return out


# ---------------------------------------------------------------- across rows
def with_repeats(df: DataFrame, keys: list[str | Column], order: str, name: str) -> DataFrame:
    """df with `name`, true for the second and later rows of a value by `order`; null keys don't count.

    Firsts are a combined minimum of the values that occur again, joined back, so a hot value
    is a skewed join and not a window in one task. Nulls are dealt by their order. Rows of one
    value and one order are told apart among themselves."""
    named = {f"__key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    rows = df.withColumns(named)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in named])
    rows = rows.withColumn("__salt", F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(order)))
    again = rows.where(known).groupBy(*named).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("__salt", F.lit(0).cast("long")).drop("__n")
    joined = rows.join(again, [*named, "__salt"], "left")
    alike = F.when(F.col("__first").isNotNull(), F.row_number().over(Window.partitionBy(*named, "__salt", order).orderBy(F.lit(0)))).otherwise(1)
    return joined.withColumn(name, F.coalesce((F.col(order) > F.col("__first")) | (alike > 1), F.lit(False))).drop(*named, "__salt", "__first")


def repeats(key: str, order: str) -> Column:
    """True for the second and later rows of a value by `order`; nulls don't count and are dealt
    by their order. One sorted stream for each value: for generated frames, whose expressions
    are too long to be run again for a join, and whose values seldom repeat."""
    w = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(order))).orderBy(order)
    return F.col(key).isNotNull() & (F.row_number().over(w) > 1)


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent, by any kind of key."""
    p = parent.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull())
    return child.where(F.col(foreign).isNotNull()).join(p, F.col(foreign) == F.col("__key"), "left_anti")


def integrity(child: DataFrame, foreign: str, parent: DataFrame, key: str, every: int = 1, index: str | None = None) -> DataFrame:
    """(checked, broken, integrity) over every nth reference."""
    c = child.where(F.col(foreign).isNotNull())
    if every > 1:
        c = c.where(F.col(index or foreign) % every == 0)
    p = parent.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    hit = c.select(F.col(foreign).alias("__f")).join(p, F.col("__f") == F.col("__key"), "left")
    n, broken = F.count(F.lit(1)), F.count_if(F.col("__key").isNull())
    return hit.agg(n.alias("checked"), broken.alias("broken"), F.when(n > 0, (n - broken) / n).otherwise(1.0).alias("integrity"))


def distribution(df: DataFrame, column: str, expected: dict[Any, float], tolerance: float = 0.08) -> DataFrame:
    """(samples, distance, worst, confident, within): total variation distance of the observed shares from the declared weights."""
    total = float(sum(expected.values()))
    spark = df.sparkSession
    want = spark.createDataFrame([(str(k), v / total) for k, v in expected.items()], "value string, want double")
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(F.broadcast(want), "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("want", F.lit(0.0)).alias("want"))
    n = both.agg(F.sum("n").alias("samples"))
    gap = both.crossJoin(n).withColumn("gap", F.abs(F.when(F.col("samples") > 0, F.col("n") / F.col("samples")).otherwise(0.0) - F.col("want")))
    out = gap.agg(F.max("samples").alias("samples"), F.round(F.sum("gap") / 2, 9).alias("distance"), F.max_by("value", F.struct("gap", "value")).alias("worst"))
    return out.select("samples", "distance", "worst", (F.col("samples") >= 30 * len(expected)).alias("confident"), (F.col("distance") <= tolerance).alias("within"))


def sample_size(categories: int) -> int:
    """Samples from which a distribution's verdict is meant."""
    return 30 * categories


# ---------------------------------------------------------------- privacy
# Domains that RFC 2606 reserves.
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", "example.edu")
RESERVED_SUFFIXES = (".test", ".example", ".invalid", ".localhost", ".local")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card_numbers(x: Column) -> Column:
    """Whether a run of 13 to 19 digits (spaces and dashes between) passes the Luhn check."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"(?<![\d])((?:\d[ -]?){12,18}\d)(?![\d])"), F.lit(1)), lambda d: F.regexp_replace(d, "[ -]", ""))
    return F.exists(found, _luhn)


def issuable_ssn(x: Column) -> Column:
    """Whether there is a number that could be issued: no area 000, 666 or 9xx, no group 00, no serial 0000."""
    found = F.regexp_extract_all(x, F.lit(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"), F.lit(1))
    return F.exists(found, lambda s: ~F.substring(s, 1, 3).isin("000", "666") & (F.substring(s, 1, 1) != "9") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000"))


def open_domains(x: Column) -> Column:
    """Whether an address is at a domain that isn't reserved for examples."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1)), lambda d: F.lower(d))
    safe = lambda d: reduce(lambda a, b: a | b, [d.isin(*RESERVED_DOMAINS), *[d.endswith("." + r) for r in RESERVED_DOMAINS], *[d.endswith(s) for s in RESERVED_SUFFIXES]])
    return F.exists(found, lambda d: ~safe(d))


def _octets(ip: Column) -> list[Column]:
    return [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]


def routable(ip: Column) -> Column:
    """Whether a dotted quad is outside private, loopback, link-local, multicast, reserved and documentation ranges."""
    a, b, c, _ = _octets(ip)
    closed = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(~closed, F.lit(False))


def open_ip(x: Column, network_typed: bool = False) -> Column:
    """A routable address: IPv4 as the whole value (anywhere in network-typed fields), IPv6 anywhere."""
    pattern = r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.])"
    v4 = F.exists(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), routable) if network_typed else F.when(F.trim(x).rlike(ty.IPV4), routable(F.trim(x))).otherwise(False)
    v6 = F.regexp_extract_all(x, F.lit(r"(?<![0-9A-Fa-f:])([0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Fa-f:])"), F.lit(1))
    open6 = lambda a: F.lower(a).rlike("^[23]") & ~F.lower(a).rlike("^2001:0?db8:") & (F.length(F.regexp_replace(a, "[^:]", "")) >= 2) & a.rlike("::|^([^:]+:){7}[^:]+$")
    return v4 | F.exists(v6, open6)


def dialable_phone(x: Column) -> Column:
    """A number of the North American plan that is not 555-01xx."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\d)((?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4})(?!\d)"), F.lit(1)), lambda p: F.right(F.regexp_replace(p, r"\D", ""), F.lit(10)))
    return F.exists(found, lambda p: ~((F.substring(p, 4, 3) == "555") & (F.substring(p, 7, 2) == "01")))


PRIVACY = {"card": card_numbers, "ssn": issuable_ssn, "domain": open_domains, "ip": open_ip, "phone": dialable_phone}


def privacy(fields: dict[str, Column], checks: Iterable[str] = PRIVACY, policy: str = "report", exempt: Iterable[str] = (), network: Iterable[str] = ()) -> list[Check]:
    severity = {"report": "info", "warn": "warning", "block": "error"}[policy]
    out = []
    for name, x in fields.items():
        if name in set(exempt):
            continue
        for c in checks:
            found = open_ip(x.cast("string"), name in set(network)) if c == "ip" else PRIVACY[c](x.cast("string"))
            out.append(Check(name, "privacy", c, F.coalesce(found, F.lit(False)), severity))
    return out


# ---------------------------------------------------------------- policies and reports
def issues(checks: list[Check], damaged: str | None = None) -> Column:
    """The failures of a row, in order; checks on damaged fields are left out."""
    items = []
    for c in checks:
        fails = c.fails
        if damaged and c.field != "*":
            fails = fails & ~F.coalesce(F.map_contains_key(damaged, F.lit(c.field)), F.lit(False))
        items.append(F.when(fails, F.struct(F.lit(c.field).alias("field"), F.lit(c.category).alias("category"), F.lit(c.message).alias("message"), F.lit(c.severity).alias("severity"))))
    if not items:
        return F.array().cast("array<struct<field:string,category:string,message:string,severity:string>>")
    return F.filter(F.array(*items), lambda i: i.isNotNull())


def _issue(**want: str):
    return lambda i: reduce(lambda a, b: a & b, [i[k] == v for k, v in want.items()])


def enforce(df: DataFrame, column: str, policy: str, placeholders: dict[str, Any] | None = None) -> DataFrame:
    """What becomes of rows with errors in the issues column."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    bad = F.exists(column, lambda i: i["severity"] == "error")
    if policy == "abort":
        return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("invalid record: "), F.to_json(F.col(column)))).cast(df.schema[column].dataType)).otherwise(F.col(column)))
    if policy in ("skip", "retry"):  # a draw is a function of the row: another try gives the same
        return df.where(~bad)
    if policy in ("placeholder", "incomplete"):
        for c in df.columns:
            if c == column:
                continue
            wrong = F.exists(column, _issue(field=c, severity="error"))
            new = F.lit((placeholders or {}).get(c)).cast(df.schema[c].dataType) if policy == "placeholder" else F.lit(None).cast(df.schema[c].dataType)
            df = df.withColumn(c, F.when(wrong, new).otherwise(F.col(c)))
    return df


def statistics(df: DataFrame, column: str) -> DataFrame:
    """(records, valid, validity, one count of failing rows by category)."""
    valid = ~F.exists(column, lambda i: i["severity"] == "error")
    by = [F.count_if(F.exists(column, _issue(category=c))).alias(f"n_{c}") for c in ("structural", "constraint", "referential", "logical", "privacy", "uniqueness")]
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(valid).alias("valid"), F.coalesce(F.count_if(valid) / F.count(F.lit(1)), F.lit(1.0)).alias("validity"), *by)


def systematic_sample(df: DataFrame, index: str, every: int) -> DataFrame:
    return df.where(F.col(index) % every == 0)
