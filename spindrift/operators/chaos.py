"""Deliberate damage and edge cases, drawn by (seed, entity, index), logged in a map column."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.expressions import kind_of
from spindrift.functions.hashing import Draws, pick

KINDS = ("missing_data", "malformed_text", "unexpected_unicode", "outliers", "temporal_anomalies", "referential_anomalies", "duplicates")
# Rates of each kind by preset; a kind that is left out has none.
PRESETS = {
    "pristine": {},
    "realistic": {"outliers": 0.005, "missing_data": 0.02, "duplicates": 0.001, "malformed_text": 0.004, "unexpected_unicode": 0.001, "temporal_anomalies": 0.0005},
    "messy": {"outliers": 0.02, "missing_data": 0.06, "duplicates": 0.01, "malformed_text": 0.03, "unexpected_unicode": 0.01, "temporal_anomalies": 0.005, "referential_anomalies": 0.002},
    "hostile_qa": {"outliers": 0.05, "missing_data": 0.1, "duplicates": 0.02, "malformed_text": 0.08, "unexpected_unicode": 0.05, "temporal_anomalies": 0.02, "referential_anomalies": 0.01},
    "absolute": {"outliers": 0.15, "missing_data": 0.2, "duplicates": 0.05, "malformed_text": 0.2, "unexpected_unicode": 0.15, "temporal_anomalies": 0.08, "referential_anomalies": 0.05},
}
# Characters that text seldom expects (zero-width space, right-to-left mark, combining acute, byte-order mark, e acute, emoji, sharp s, no-break space).
GREMLINS = ["\u200b", "\u200f", "\u0301", "\ufeff", "é", "🙂", "ß", "\u00a0"]
# Ways to mangle a text, factors of an outlier, and other notations of a date (Spark's patterns; the last is ctime's).
DEFECTS = ["double_space", "trailing_space", "leading_space", "upper", "lower", "transpose", "drop_character", "repeat_character", "truncate", "tab"]
MULTIPLIERS = [1e3, 1e4, -1.0, -1e3, 1e6]
DATE_FORMATS = ["dd/MM/yyyy", "MM-dd-yyyy", "yyyyMMdd", "dd MMM yyyy", "EEE MMM dd HH:mm:ss yyyy"]


def rates(spec: dict[str, Any] | str | None) -> dict[str, float]:
    """A preset with the rates above 0 that are given put over it."""
    spec = {"preset": spec} if isinstance(spec, str) else dict(spec or {})
    preset = spec.pop("preset", "pristine") or "pristine"
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {', '.join(PRESETS)}")
    return dict.fromkeys(KINDS, 0.0) | PRESETS[preset] | {k: float(v) for k, v in spec.items() if k in KINDS and float(v) > 0}


def _malformed(x: Column, d: Draws) -> Column:
    """One of the defects; one that can't apply (no blank, too short) leaves the text or repeats a character."""
    n, at = F.length(x), F.floor(d.u("at") * F.greatest(F.length(x), F.lit(1))).cast("int")
    cut = lambda a, b: F.substring(x, a, b)
    rest, before_last = F.lit(1 << 30), F.greatest(F.least(at, F.length(x) - 2), F.lit(0))
    blanks = F.repeat(F.lit(" "), (F.floor(d.u("blanks") * 3) + 1).cast("int"))
    off = (F.floor(d.u("cut") * F.greatest(F.floor(n / 3), F.lit(1))) + 1).cast("int")
    again = F.concat(cut(F.lit(1), at + 1), cut(at + 1, rest))
    forms = {
        "double_space": F.regexp_replace(x, "^([^ ]*) ", "$1  "), "trailing_space": F.concat(x, blanks), "leading_space": F.concat(blanks, x), "upper": F.upper(x), "lower": F.lower(x),
        "transpose": F.when(n > 1, F.concat(cut(F.lit(1), before_last), cut(before_last + 2, F.lit(1)), cut(before_last + 1, F.lit(1)), cut(before_last + 3, rest))).otherwise(again),
        "drop_character": F.concat(cut(F.lit(1), at), cut(at + 2, rest)), "repeat_character": again,
        "truncate": F.when(n > 3, cut(F.lit(1), F.greatest(n - off, F.lit(1)))).otherwise(again), "tab": F.regexp_replace(x, "^([^ ]*) ", "$1\t"),
    }
    which = F.floor(d.u("defect") * len(DEFECTS))
    out = x
    for i, name in enumerate(DEFECTS):
        out = F.when(which == i, forms[name]).otherwise(out)
    return F.when(n > 0, out).otherwise(x)


def _notation(x: Column, d: Draws) -> Column:
    """A date or datetime in another notation."""
    which = F.floor(d.u("notation") * len(DATE_FORMATS))
    out = F.date_format(x, DATE_FORMATS[0])
    for i, form in enumerate(DATE_FORMATS[1:], 1):
        out = F.when(which == i, F.date_format(x, form)).otherwise(out)
    return out


def _moved(x: Column, kind: str, d: Draws) -> tuple[Column, Column]:
    """(a draw, the moment moved): below 0.4 into the future, below 0.7 into the past."""
    u, v = d.u("which"), d.u("days")
    days = F.when(u < 0.4, F.lit(400) + F.floor(v * 3601)).otherwise(F.lit(-4000) - F.floor(v * 36001)).cast("int")
    return u, F.date_add(x, days) if kind == "date" else F.timestamp_add("DAY", days, x)


def damaged(x: Column, t: T.DataType, kind: str, d: Draws) -> Column | None:
    """The value damaged that way, or None where the kind can't touch the type."""
    k = kind_of(t)
    if kind == "missing_data":
        return F.lit(None).cast(t)
    if kind == "malformed_text" and k == "str":
        return _malformed(x, d)
    if kind == "unexpected_unicode" and k == "str":
        at = F.floor(d.u("at") * (F.length(x) + 1)).cast("int")
        return F.concat(F.substring(x, F.lit(1), at), pick(GREMLINS, F.floor(d.u("gremlin") * len(GREMLINS))), F.substring(x, at + 1, F.lit(1 << 30)))
    if kind == "outliers" and k in ("int", "float"):
        m = pick(MULTIPLIERS, F.floor(d.u("multiplier") * len(MULTIPLIERS)))
        big = F.when(x == 0, m).otherwise(x.cast("double") * m)
        return big.try_cast(t)
    if kind == "temporal_anomalies" and k in ("date", "datetime"):
        # the other notation is no date: a typed column holds what a reader makes of it, null (see `as_text`)
        u, moved = _moved(x, k, d)
        return F.when(u < 0.7, moved)
    if kind == "temporal_anomalies" and k == "str":
        return F.when((F.length(x) >= 10) & (F.substring(x, 5, 1) == "-"), F.replace(x, F.lit("-"), F.lit("/"))).otherwise(x)
    if kind == "referential_anomalies" and k == "int":
        return (x + 1_000_000 + F.floor(d.u("orphan") * 9_000_001)).cast(t)
    if kind == "referential_anomalies" and k == "str":
        return F.concat(x, F.lit("-ORPHAN"), F.lpad(F.floor(d.u("orphan") * 1000).cast("string"), 3, "0"))
    return None


def damage(df: DataFrame, entity: str, index: str, seed: int | str, spec: dict[str, Any] | str, protected: tuple[str, ...] = (), mode: str = "fast", log: str = "_chaos", as_text: bool = False) -> DataFrame:
    """df with damaged values, a map of field to kind, and repeated rows right after their originals (marked @duplicate).

    as_text: dates and datetimes become ISO text, so that a temporal anomaly can also be another notation."""
    rate = rates(spec)
    times = {f.name: kind_of(f.dataType) for f in df.schema.fields if as_text and kind_of(f.dataType) in ("date", "datetime") and not f.name.startswith("_")}
    if times:
        texts = {}
        for n, k in times.items():
            x, d = F.col(f"`{n}`"), Draws(seed, entity, F.col(index), "chaos.temporal_anomalies", mode)
            texts[n] = F.replace(x.cast("string"), F.lit(" "), F.lit("T"))
            if n not in (*protected, index):
                u, moved = _moved(x, k, d)
                texts[f"__late_{n}"] = F.when(u < 0.7, F.replace(moved.cast("string"), F.lit(" "), F.lit("T"))).otherwise(_notation(x, d))
        df = df.withColumns(texts)
    own = [f for f in df.schema.fields if f.name not in (*protected, index) and not f.name.startswith("_")]
    out = df.withColumn(log, F.create_map().cast("map<string,string>"))
    for kind in KINDS[:-1]:
        if rate[kind] <= 0 or not own:
            continue
        # a projection for each kind: nested in one, the expressions would multiply
        d = Draws(seed, entity, F.col(index), f"chaos.{kind}", mode)
        which = F.when(d.u("hit") < rate[kind], F.floor(d.u("field") * len(own)))
        out = out.withColumn("__which", which)
        # texts are damaged in one place, whichever field is hit: the expression is long
        texts = [(i, f.name) for i, f in enumerate(own) if isinstance(f.dataType, T.StringType) and not (kind == "temporal_anomalies" and f.name in times)]
        hit = F.lit(None).cast("string")
        for i, n in texts:
            hit = F.when(F.col("__which") == i, F.col(f"`{n}`")).otherwise(hit)
        shared = damaged(F.col("__text"), T.StringType(), kind, d) if texts else None
        if shared is not None:
            out = out.withColumn("__text", hit).withColumn("__text", shared)
        names_of_texts = {n for _, n in texts}

        def new(f: T.StructField) -> Column | None:
            if kind == "temporal_anomalies" and f.name in times:
                return F.col(f"`__late_{f.name}`")
            if f.name in names_of_texts:
                return None if shared is None else F.col("__text")
            return damaged(F.col(f"`{f.name}`"), f.dataType, kind, d)

        made = {f.name: new(f) for f in own}
        fresh = {f"__new_{n}": F.when((F.col("__which") == i) & F.col(f"`{n}`").isNotNull(), F.struct(x.alias("v"))) for i, (n, x) in enumerate(made.items()) if x is not None}
        out = out.withColumns(fresh)
        names = [n[6:] for n in fresh]
        changed = [F.when(F.col(f"`__new_{n}`").isNotNull() & ~F.col(f"`__new_{n}`.v").eqNullSafe(F.col(f"`{n}`")), F.lit(n)) for n in names]
        hit = F.coalesce(*changed) if changed else F.lit(None).cast("string")
        noted = F.map_concat(F.map_filter(log, lambda k, v: k != F.col("__hit")), F.create_map(F.col("__hit"), F.lit(kind)))
        out = out.withColumn("__hit", hit).withColumns({n: F.when(F.col(f"`__new_{n}`").isNotNull(), F.col(f"`__new_{n}`.v")).otherwise(F.col(f"`{n}`")) for n in names} | {log: F.when(F.col("__hit").isNotNull(), noted).otherwise(F.col(log))})
        out = out.drop("__which", "__hit", "__text", *fresh)
    if rate["duplicates"] > 0:
        again = Draws(seed, entity, F.col(index), "chaos.duplicates", mode).u("hit") < rate["duplicates"]
        copies = F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        out = out.select("*", copies.alias("__copy"))
        mark = F.map_concat(F.col(log), F.create_map(F.lit("@duplicate"), F.lit("duplicates")))
        out = out.withColumn(log, F.when(F.col("__copy") == 1, mark).otherwise(F.col(log))).drop("__copy")
    return out.drop(*[f"__late_{n}" for n in times])


def damage_report(df: DataFrame, log: str = "_chaos") -> DataFrame:
    """(kind, n)."""
    return df.select(F.explode(F.map_values(log)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- edge cases
# The categories, and values that are legal but awkward.
CATEGORIES = ("boundary_length", "unicode_text", "emoji", "punctuation_names", "rtl_text", "extreme_numbers", "temporal_boundaries", "extreme_coordinates", "whitespace")
TEXTS = {
    "punctuation_names": ["O'Brien-Smith", "d'Arcy", "Mary-Jane Watson-Parker", "Ó Séaghdha", "van der Waals", "St. John-Stevas", "Jean-Luc de la Croix", "McDonald-O'Neill", "Abu-Bakr al-Rashid", "Ng-Chan"],
    "unicode_text": ["Ω", "Ærandwine Þorsteinsdóttir", "Zoë Straße", "İstanbul Işık", "e\u0301le\u0300ve", "ﬁnancial ﬂow", "Ｆｕｌｌｗｉｄｔｈ Ｎａｍｅ", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ꙮ", "Ｖ𝕒𝕣𝕚𝕠𝕦𝕤 𝔰𝔠𝔯𝔦𝔭𝔱𝔰"],
    "emoji": ["🙂", "Ada 👩‍💻 Lovelace", "👨‍👩‍👧‍👦 Family Trust", "🏳️‍🌈 Pride Collective", "Café ☕ Ltd", "🇬🇧🇺🇸 Transatlantic", "Team 💯 Alpha", "🧑🏽‍🚀 Crew"],
    "rtl_text": ["محمد عبد الله", "דוד בן־גוריון", "علی رضا", "شركة الاتحاد للتجارة", "\u202eevil.txt.exe", "abc\u200fdef"],
    "whitespace": [" leading space", "trailing space ", "double  space", "tab\tseparated", "non\u00a0breaking space", "\u200bzero width", "line\nbreak"],
}
INTEGERS = [0, -1, 2**31 - 1, 2**31, -(2**31), 2**53, 2**63 - 1, -(2**63)]
FLOATS = [0.0, -1.0, 0.1, 1e-7, 1e15, -1e15]
MOMENTS = ["2024-02-29 12:00:00", "2000-02-29 00:00:00", "2026-12-31 23:59:59", "1970-01-01 00:00:00", "2026-03-08 07:30:00", "2026-11-01 05:30:00"]
POINTS = [(90.0, 0.0), (-90.0, 180.0), (0.0, -180.0), (0.0, 0.0), (-33.8688, 151.2093)]
EMAILS = ["o'brien-smith@example.com", "first.last+tag@example.org", "very.long.local.part.that.keeps.going.and.going@example.net", "a@example.com", "quoted\\ name@example.com"]
PHONES = ["+1-555-0100", "555-0199"]
DURATIONS = [dt.timedelta(0), dt.timedelta(days=36_500)]


def _bounds(c: dict[str, Any], o: dict[str, Any]) -> tuple[Any, Any]:
    """A field's range: its constraints, else its generator's."""
    low = next((v for v in (c.get("min"), o.get("min"), o.get("low")) if v is not None), None)
    high = next((v for v in (c.get("max"), o.get("max"), o.get("high")) if v is not None), None)
    return low, high


def labelled_cases(type_name: str, constraints: dict[str, Any] | None = None, options: dict[str, Any] | None = None) -> list[tuple[str, Any]]:
    """(category, value) of the cases of a type within the range of its constraints or its generator."""
    c, o = constraints or {}, options or {}
    if type_name in ("string", "text"):
        low, high = c.get("min_length") or 0, c.get("max_length")
        lengths = ["a" * low] + (["W" * high, ("Wi" * high)[: high - high % 2] + "W" * (high % 2)] if high else [])
        return [("boundary_length", v) for v in lengths] + [(k, v) for k, vs in TEXTS.items() for v in vs]
    if type_name in ("integer", "float", "decimal", "currency", "percentage"):
        low, high = _bounds(c, o)
        kind = int if type_name == "integer" else float
        near = [kind(v) for b, step in ((low, 1), (high, -1)) if isinstance(b, (int, float)) for v in (b, b + step)]
        if low is None and high is None:
            near = list(INTEGERS if type_name == "integer" else FLOATS)
        elif low is None:
            near += [kind(0), kind(-1)]
        return [("extreme_numbers", v) for v in near]
    if type_name in ("date", "datetime", "time"):
        part = {"date": slice(0, 10), "time": slice(11, 19), "datetime": slice(0, 19)}[type_name]
        more = {"date": ["2026-01-01"], "time": ["00:00:00", "23:59:59"], "datetime": []}[type_name]
        return [("temporal_boundaries", v) for v in [m[part] for m in MOMENTS] + more]
    fixed = {"geo_point": ("extreme_coordinates", POINTS), "email": ("punctuation_names", EMAILS), "phone": ("boundary_length", PHONES), "duration": ("extreme_numbers", DURATIONS)}
    if type_name in fixed:
        category, values = fixed[type_name]
        return [(category, v) for v in values]
    return [("boundary_length", v) for v in (c["enum"][0], c["enum"][-1])] if c.get("enum") else []


def allowed(v: Any, c: dict[str, Any]) -> bool:
    """Whether a value keeps its field's constraints; one that doesn't is damage, no edge case."""
    if isinstance(v, (int, float)) and not ((c.get("min") is None or v >= c["min"]) and (c.get("max") is None or v <= c["max"])):
        return False
    if isinstance(v, str):
        if not (c.get("min_length") or 0) <= len(v) <= (c.get("max_length") or 1 << 30):
            return False
        if c.get("pattern") and not re.search(c["pattern"], v):
            return False
    return (not c.get("enum") or v in c["enum"]) and v not in (c.get("forbidden") or [])


def cases(type_name: str, constraints: dict[str, Any] | None = None, categories: list[str] | None = None, options: dict[str, Any] | None = None) -> list[Any]:
    """The cases of a type, of some categories, that its constraints allow."""
    if extra := set(categories or ()) - set(CATEGORIES):
        raise ValueError(f"unknown edge categories {sorted(extra)}; known: {', '.join(CATEGORIES)}")
    return [v for k, v in labelled_cases(type_name, constraints, options) if (not categories or k in categories) and allowed(v, constraints or {})]


def edge_plan(entity: str, index: Column, seed: int | str, fraction: float, fields: dict[str, int], mode: str = "fast") -> tuple[Column, Column, Column]:
    """(hit, field number among the sorted names, case number) of a row; fields: name -> number of cases."""
    d = Draws(seed, entity, index, "edges", mode)
    names = sorted(fields)
    at = F.floor(d.u("field") * len(names)).cast("int")
    n = pick([fields[x] for x in names], at)
    return d.u("hit") < fraction, at, F.floor(d.u("case") * n).cast("int")


def with_case(x: Column, t: T.DataType, values: list[Any], mine: Column, case: Column) -> Column:
    """The case in place of the value where the plan says so."""
    names = t.fieldNames() if isinstance(t, T.StructType) else []
    one = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v, strict=True)]) if names else F.lit(v)
    literals = F.array(*[one(v).cast(t) for v in values])
    return F.when(mine, F.element_at(literals, case + 1)).otherwise(x)
