"""Value generators: each builds a Column from a row's index and its field's draws.

Register more with `@generator("name", "alias")`. What no expression can say (beta
quantiles, PDF, images, speech) is an Arrow-batched function at the end of the file.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import text as tx
from spindrift.functions import transforms as tf
from spindrift.functions.expressions import Translator, Value, columns_of
from spindrift.functions.hashing import Draws, pick
from spindrift.functions.types import spark_type

GENERATORS: dict[str, Callable] = {}
ALIASES: dict[str, str] = {}


class GeneratorError(ValueError):
    pass


def generator(name: str, *aliases: str) -> Callable:
    def register(f: Callable) -> Callable:
        GENERATORS[name] = f
        ALIASES.update(dict.fromkeys(aliases, name))
        return f

    return register


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in GENERATORS:
        raise GeneratorError(f"unknown generator {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return name


@dataclass
class Context:
    name: str
    type: str
    entity: str
    index: Column
    draws: Draws
    schema: T.StructType
    constraints: dict[str, Any] = field(default_factory=dict)
    attribute: Callable[[str, str], Value] | None = None
    sim: dict[str, Column] = field(default_factory=dict)
    now: dt.datetime = dt.datetime(2026, 1, 1)
    base: str = "."
    spark: Any = None
    values: dict[str, Value] | None = None  # columns that stand for the schema's, where a parent is substituted

    @property
    def columns(self) -> dict[str, Value]:
        return self.values if self.values is not None else columns_of(self.schema)

    def column(self, name: str) -> Column:
        return self.columns[name].col

    def expression(self, source: str) -> Value:
        return Translator(self.columns, self.attribute, f"{self.entity}.{self.name}").value(source)

    def fail(self, what: str):
        raise GeneratorError(f"{self.entity}.{self.name}: {what}")


def opt(o: dict[str, Any], *names: str, default: Any = None) -> Any:
    """The first of several spellings that is given."""
    return next((o[n] for n in names if n in o and o[n] is not None), default)


def _is_text(c: Context) -> bool:
    return isinstance(spark_type(c.type), T.StringType)


# ---------------------------------------------------------------- simple
@generator("constant", "literal", "fixed")
def _constant(o, c):
    v = opt(o, "value")
    return F.from_json(F.lit(json.dumps(v)), "array<string>" if isinstance(v, list) else "map<string,string>") if isinstance(v, (list, dict)) else F.lit(v)


@generator("null", "none", "empty")
def _null(o, c):
    return F.lit(None)


def sequence_value(o: dict[str, Any], index: Column, textual: bool) -> Column:
    step = int(opt(o, "step", default=1))
    if step == 0:
        raise GeneratorError("a sequence's step can't be 0")
    n = F.lit(int(opt(o, "start", default=1))) + index * F.lit(step)
    fmt, pad = opt(o, "format", "pattern", "template"), opt(o, "pad", "width", "zero_pad")
    if fmt:
        m = re.search(r"\{(0+|#+)\}", fmt)
        if not m:
            return F.concat(F.lit(fmt), n.cast("string"))
        return F.concat(F.lit(fmt[: m.start()]), tx.zero_pad(n, len(m[1])), F.lit(fmt[m.end() :]))
    if pad:
        return tx.zero_pad(n, int(pad))
    return n.cast("string") if textual else n


@generator("sequence", "serial", "autoincrement")
def _sequence(o, c):
    return sequence_value(o, c.index, _is_text(c))


def _uuid_text(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _versioned(h: Column, version: int) -> Column:
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return _uuid_text(F.concat(F.substring(h, 1, 12), F.lit(str(version)), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


# Name spaces of RFC 4122.
_SPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8", "oid": "6ba7b8129dad11d180b400c04fd430c8", "x500": "6ba7b8149dad11d180b400c04fd430c8"}


@generator("uuid", "guid")
def _uuid(o, c):
    if int(opt(o, "version", default=4)) == 5:
        space = _SPACES.get(str(opt(o, "namespace", default="dns")).lower(), str(opt(o, "namespace", default="dns")).replace("-", ""))
        source = opt(o, "name", "name_field", "field")
        name = c.column(source).cast("string") if source in c.columns else F.concat(F.lit(f"{c.entity}:"), c.index.cast("string"))
        return _versioned(F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8"))), 5)
    return _versioned(c.draws.hex("uuid"), 4)


# ---------------------------------------------------------------- numbers
# Alphabets by name.
ALPHABETS = {
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "hex": "0123456789abcdef",
}


def between(c: Context, lo: int, hi: int, k: Any = 0) -> Column:
    return (F.floor(c.draws.u(k) * F.lit(hi - lo + 1)) + F.lit(lo)).cast("long")


def random_text(draws: Draws, alphabet: str, length: Column | int) -> Column:
    chars = F.sequence(F.lit(1), length if isinstance(length, Column) else F.lit(length))
    return F.array_join(F.transform(chars, lambda i: F.substring(F.lit(alphabet), (F.floor(draws.u(i) * len(alphabet)) + 1).cast("int"), F.lit(1))), "")


@generator("random", "rand")
def _random(o, c):
    lo, hi = opt(o, "min", "minimum", "low", default=c.constraints.get("min")), opt(o, "max", "maximum", "high", default=c.constraints.get("max"))
    if c.type == "integer":
        lo = 0 if lo is None else int(lo)
        return between(c, lo, max(lo, 100) if hi is None else int(hi))
    if c.type in ("float", "decimal"):
        lo, hi = float(0 if lo is None else lo), float(1 if hi is None else hi)
        p = opt(o, "precision", default=c.constraints.get("precision", 2 if c.type == "decimal" else None))
        x = F.lit(lo) + c.draws.u() * F.lit(hi - lo)
        return x if p is None else F.round(x, int(p))
    if c.type == "boolean":
        return c.draws.u() < float(opt(o, "probability", default=0.5))
    if c.type in ("date", "time", "datetime"):
        return GENERATORS["datetime"](o, c)
    alphabet = opt(o, "charset", "alphabet", default="alphanumeric")
    n = opt(o, "length")
    a, b = opt(o, "min_length", default=c.constraints.get("min_length")), opt(o, "max_length", default=c.constraints.get("max_length"))
    if n is None and (a is not None or b is not None):
        a = int(a or 1)
        n = between(c, a, max(a, int(b or a + 8)), "length").cast("int")
    return random_text(c.draws, ALPHABETS.get(alphabet, alphabet), n if isinstance(n, Column) else int(n or 8))


@generator("boolean", "bool", "flag")
def _boolean(o, c):
    return c.draws.u() < float(opt(o, "probability", "p", "true_probability", default=0.5))


def _normal(d: Draws) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - d.u("n1"))) * F.cos(F.lit(2 * math.pi) * d.u("n2"))


def poisson_table(lam: float) -> list[float]:
    """Cumulative probabilities until they no longer grow."""
    p, total, out, k = math.exp(-lam), 0.0, [], 0
    while total < 1 - 1e-12 and k < 10 * lam + 60:
        total += p
        out.append(total)
        k += 1
        p *= lam / k
    return out


def step_of(u: Column, cumulative: list[float]) -> Column:
    """The first place whose cumulative share exceeds u."""
    table = F.array(*[F.lit(float(x)) for x in cumulative])
    return F.least(F.size(F.filter(table, lambda x: x <= u)), F.lit(len(cumulative) - 1))


@generator("distribution", "dist", "statistical")
def _distribution(o, c):
    kind, d = str(opt(o, "distribution", "kind", "name", "shape", default="normal")).lower(), c.draws
    lo, hi = opt(o, "min", default=c.constraints.get("min")), opt(o, "max", default=c.constraints.get("max"))
    if kind == "uniform":
        a, b = float(0 if lo is None else lo), float(1 if hi is None else hi)
        x = F.lit(a) + d.u() * F.lit(b - a)
    elif kind in ("normal", "gaussian"):
        x = F.lit(float(opt(o, "mean", "mu", default=0))) + F.lit(float(opt(o, "stddev", "std", "sigma", default=1))) * _normal(d)
    elif kind == "lognormal":
        x = F.exp(F.lit(float(opt(o, "mean", "mu", default=0))) + F.lit(float(opt(o, "sigma", "stddev", default=1))) * _normal(d))
    elif kind == "exponential":
        scale = opt(o, "scale", default=1 / float(opt(o, "rate", "lambda", default=1)))
        x = F.lit(-float(scale)) * F.log(F.lit(1.0) - d.u())
    elif kind == "poisson":
        lam = float(opt(o, "lam", "lambda", "rate", "mean", default=1))
        x = step_of(d.u(), poisson_table(lam)) if lam <= 500 else F.greatest(F.round(F.lit(lam) + F.lit(math.sqrt(lam)) * _normal(d)), F.lit(0))
    elif kind == "beta":
        a, b = float(opt(o, "alpha", "a", default=2)), float(opt(o, "beta", "b", default=2))
        low, high = float(0 if lo is None else lo), float(1 if hi is None else hi)
        x = F.lit(low) + F.lit(high - low) * beta_quantile(d.u(), a, b)
    elif kind == "histogram":
        bins = opt(o, "bins", "histogram") or c.fail("a histogram needs bins")
        bins = [{"value": k, "weight": w} for k, w in bins.items()] if isinstance(bins, dict) else bins
        cumulative, total = [], 0.0
        for b in bins:
            total += float(b.get("weight", 1))
            cumulative.append(total)
        at = step_of(d.u() * F.lit(total), cumulative)
        edge = [[float(v) for v in (b["range"] if "range" in b else (b.get("min", b.get("value")), b.get("max", b.get("value"))))] for b in bins]
        a, b = pick([e[0] for e in edge], at), pick([e[1] for e in edge], at)
        x = a + d.u("bin") * (b - a)
    else:
        c.fail(f"unknown distribution {kind!r}")
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    if c.type == "integer" or kind == "poisson":
        return F.bround(x).cast("long")
    p = opt(o, "precision", default=c.constraints.get("precision", 2 if c.type == "decimal" else None))
    return x if p is None else F.round(x, int(p))


# ---------------------------------------------------------------- text
_TOKEN = re.compile(r"\{\{|\}\}|\{([^{}]*)\}")


def pattern_parts(pattern: str) -> list[tuple[str, int]]:
    """(alphabet, repeats) for each token, and (literal, 0)."""
    out: list[tuple[str, int]] = []
    at = 0
    for m in _TOKEN.finditer(pattern):
        if m.start() > at:
            out.append((pattern[at : m.start()], 0))
        at = m.end()
        if m[0] in ("{{", "}}"):
            out.append((m[0][0], 0))
            continue
        body, _, times = m[1].partition(":")
        n = int(times) if times else None
        if body and set(body) <= {"0"} or body and set(body) <= {"#"}:
            out.append((ALPHABETS["digits"], n or len(body)))
        elif body and set(body) <= {"?"}:
            out.append((ALPHABETS["upper"], n or len(body)))
        elif body and set(body) <= {"*"}:
            out.append((ALPHABETS["upper"] + ALPHABETS["digits"], n or len(body)))
        elif re.fullmatch(r"(.-.)+", body):
            alphabet = "".join("".join(map(chr, range(ord(body[i]), ord(body[i + 2]) + 1))) for i in range(0, len(body), 3))
            out.append((alphabet, n or 1))
        else:
            raise GeneratorError(f"unknown token {m[0]!r} in pattern {pattern!r}")
    if at < len(pattern):
        out.append((pattern[at:], 0))
    return out


@generator("pattern", "shape", "mask")
def _pattern(o, c):
    out, k = [], 0
    for alphabet, n in pattern_parts(str(opt(o, "pattern", "format", "shape", default=""))):
        if not n:
            out.append(F.lit(alphabet))
        for _ in range(n):
            out.append(F.substring(F.lit(alphabet), (F.floor(c.draws.u(k) * len(alphabet)) + 1).cast("int"), F.lit(1)))
            k += 1
    x = F.concat(*out) if out else F.lit("")
    case = str(opt(o, "case", default=""))
    return F.upper(x) if o.get("upper") or case == "upper" else F.lower(x) if o.get("lower") or case == "lower" else x


def template_fields(source: str) -> list[str]:
    return [m[1].split("|")[0].strip() for m in _TOKEN.finditer(source) if m[1]]


@generator("template", "interpolate", "format")
def _template(o, c):
    source = str(opt(o, "template", "format", "value", "pattern", default=""))
    if not template_fields(source):
        c.fail("a template needs at least one {field}")
    missing, out, at = str(opt(o, "on_missing", default="empty")), [], 0
    for m in _TOKEN.finditer(source):
        out.append(F.lit(source[at : m.start()]))
        at = m.end()
        if m[0] in ("{{", "}}"):
            out.append(F.lit(m[0][0]))
            continue
        name, *filters = (s.strip() for s in m[1].split("|"))
        v = c.expression(name)
        x = tx.apply_filters(F.when(v.col, "True").otherwise("False") if v.kind == "bool" else v.col.cast("string"), filters)
        other = {"empty": F.lit(""), "keep": F.lit(m[0]), "error": F.raise_error(F.lit(f"{c.entity}.{c.name}: {name} is missing")).cast("string")}[missing]
        out.append(F.coalesce(x, other))
    out.append(F.lit(source[at:]))
    return F.concat(*out)


@generator("expression", "expr", "derived", "computed")
def _expression(o, c):
    return c.expression(str(opt(o, "expression", "expr", "formula", "value", default=""))).col


# ---------------------------------------------------------------- categories
def weights_of(choices: Any) -> list[tuple[Any, float]]:
    """Values and weights of a mapping, a list, or a list of {value, weight} or pairs."""
    if isinstance(choices, dict):
        return [(k, float(w)) for k, w in choices.items()]
    out = []
    for x in choices or []:
        if isinstance(x, dict) and "value" in x:
            out.append((x["value"], float(x.get("weight", 1))))
        elif isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[1], (int, float)):
            out.append((x[0], float(x[1])))
        else:
            out.append((x, 1.0))
    return out


def weighted(u: Column, choices: list[tuple[Any, float]]) -> Column:
    total, cumulative = 0.0, []
    for _, w in choices:
        total += w
        cumulative.append(total)
    if total <= 0:
        raise GeneratorError("weights must add up to more than 0")
    values = [v for v, _ in choices]
    if len(values) <= 50:
        out = F.lit(values[-1])
        for v, s in list(zip(values, cumulative, strict=True))[-2::-1]:
            out = F.when(u * F.lit(total) <= F.lit(s), F.lit(v)).otherwise(out)
        return out
    return pick(values, step_of(u * F.lit(total), cumulative))


@generator("weighted", "choice", "categorical", "enum")
def _weighted(o, c):
    choices = weights_of(opt(o, "values", "choices", "weights", "options", default=c.constraints.get("enum")))
    return weighted(c.draws.u(), choices or c.fail("there is nothing to choose from"))


@generator("lookup", "dataset", "from_list")
def _lookup(o, c):
    from spindrift.sources.lookup import load_values

    values = load_values(c.spark, opt(o, "values", "table", "list", "source", "path", "file"), opt(o, "column", "field"), c.base)
    if not values:
        c.fail("the lookup table is empty")
    n = len(values)
    return pick(values, c.index % n if str(opt(o, "mode", default="random")) == "cycle" else F.floor(c.draws.u() * n))


# ---------------------------------------------------------------- time
# Weights of the hours of a day that has business hours, midnight first.
BUSINESS_HOURS = [0.2, 0.1, 0.1, 0.1, 0.2, 0.6, 1.5, 3.0, 6.0, 8.0, 8.5, 8.0, 6.0, 7.5, 8.0, 8.0, 7.0, 5.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.4]


def moment(v: Any, now: dt.datetime) -> dt.datetime:
    if v in (None, "now"):
        return now
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v).replace("Z", "")).replace(tzinfo=None)


def literal_time(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def after(start: Column, seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.floor(seconds * 1_000_000).cast("long"), start)


@generator("datetime", "date", "time", "timestamp", "temporal")
def _datetime(o, c):
    start = moment(opt(o, "start", "min", "from"), c.now - dt.timedelta(days=365)) if opt(o, "start", "min", "from") else c.now - dt.timedelta(days=365)
    end = moment(opt(o, "end", "max", "to"), c.now)
    span = max(0.0, (end - start).total_seconds())
    draw = lambda k: after(literal_time(start), F.floor(c.draws.u(k) * span))
    t = draw(0)
    if o.get("weekdays_only"):
        tries = F.array(*[draw(k) for k in range(12)])
        t = F.coalesce(F.try_element_at(F.filter(tries, lambda x: F.weekday(x) < 5), F.lit(1)), F.element_at(tries, 12))
    if o.get("business_hours"):
        hour = weighted(c.draws.u("hour"), [(h, w) for h, w in enumerate(BUSINESS_HOURS) if w])
        t = after(F.date_trunc("DAY", t).cast("timestamp_ntz"), hour * 3600 + F.floor(c.draws.u("second") * 3600))
    if shift := opt(o, "timezone_offset"):
        t = after(t, F.lit(float(shift) * 3600))
    return F.to_date(t) if c.type == "date" else F.date_format(t, "HH:mm:ss") if c.type == "time" else t


# ---------------------------------------------------------------- reserved identifiers
# Ranges that RFC 5737, 3849 and 7042 set aside for documentation.
SAFE_V4, SAFE_V6, SAFE_OUI = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"), "2001:db8::/32", "00:00:5e"


def _v4(net: ipaddress.IPv4Network, d: Draws) -> Column:
    skip = net.num_addresses > 2
    n = F.lit(int(net.network_address) + skip) + F.floor(d.u("host") * (net.num_addresses - 2 * skip)).cast("long")
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


@generator("ip", "ip_address", "ipv4")
def _ip(o, c):
    network, safe = opt(o, "network", "cidr", "subnet"), bool(opt(o, "safe", default=True))
    version = int(opt(o, "version", default=4))
    if version == 6 or (network and ":" in str(network)):
        net = ipaddress.IPv6Network(str(network or SAFE_V6), strict=False)
        digits, fixed = f"{int(net.network_address):032x}", net.prefixlen // 4
        h = F.concat(F.lit(digits[:fixed]), F.substring(c.draws.hex("v6"), 1, 32 - fixed))
        return F.concat_ws(":", *[F.substring(h, 4 * i + 1, 4) for i in range(8)])
    if network:
        return _v4(ipaddress.IPv4Network(str(network), strict=False), c.draws)
    if safe:
        nets = [_v4(ipaddress.IPv4Network(n), c.draws) for n in SAFE_V4]
        return F.element_at(F.array(*nets), (c.draws.below(3, "net") + 1).cast("int"))
    return F.concat_ws(".", (c.draws.below(222, "a") + 1).cast("string"), *[c.draws.below(256, k).cast("string") for k in "bcd"])


@generator("mac", "mac_address")
def _mac(o, c):
    oui, sep = opt(o, "oui"), str(opt(o, "separator", default=":"))
    lead = [F.lit(x) for x in re.split("[:-]", str(oui))] if oui else [F.lit(x) for x in SAFE_OUI.split(":")] if opt(o, "safe", default=True) else [F.lit("02"), *[F.lpad(F.lower(F.hex(c.draws.below(256, f"o{i}"))), 2, "0") for i in range(2)]]
    x = F.concat_ws(sep, *lead, *[F.lpad(F.lower(F.hex(c.draws.below(256, i))), 2, "0") for i in range(6 - len(lead))])
    return F.upper(x) if o.get("upper") else x


@generator("phone", "phone_number", "telephone")
def _phone(o, c):
    area = opt(o, "area_code")
    a = F.lit(str(area)) if area else (c.draws.below(800, "area") + 200).cast("string")
    safe = bool(opt(o, "safe", default=True))
    exchange = F.lit("555") if safe else (c.draws.below(800, "exchange") + 200).cast("string")
    line = F.concat(F.lit("01"), F.lpad(c.draws.below(100, "line").cast("string"), 2, "0")) if safe else F.lpad(c.draws.below(10000, "line").cast("string"), 4, "0")
    form = str(opt(o, "format", default="e164"))
    if form == "e164":
        return F.concat(F.lit("+1"), a, exchange, line)
    return F.concat(F.lit("("), a, F.lit(") "), exchange, F.lit("-"), line) if form == "national" else F.concat(a, exchange, line)


@generator("government_id", "ssn", "national_id")
def _government_id(o, c):
    area = (c.draws.below(100, "area") + 900) if opt(o, "safe", default=True) else (c.draws.below(665, "area") + 1)
    serial = F.lpad((c.draws.below(9999, "serial") + 1).cast("string"), 4, "0")
    if o.get("masked"):
        return F.concat(F.lit("***-**-"), serial)
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((c.draws.below(99, "group") + 1).cast("string"), 2, "0"), serial)


# Our own short word tables for realistic-looking fields.
WORDS = {
    "first_name": "Ada Ben Cleo Dev Edda Finn Gia Hugo Ines Jon Kira Leo Mina Nils Ola Pia Quin Rosa Sven Tara Uma Vito Wanda Xenia Yann Zoe".split(),
    "last_name": "Adler Brandt Castro Dahl Eriksen Fuchs Garcia Hansen Ito Jensen Keller Lund Moreau Novak Olsen Petit Quist Rossi Silva Toth Ueda Vogel Weiss Yilmaz Zeman".split(),
    "city": "Arden Brill Corvo Dunmere Elston Farrow Gant Holt Irvine Jarrow Kelso Linden Marl Norwick Orrin Penrith".split(),
    "country": "Austria Brazil Canada Denmark Egypt France Germany Hungary India Japan Kenya Norway Peru Spain Sweden Turkey".split(),
    "street": "Oak Elm Birch Cedar Maple Mill Church Station Harbour Garden River Bridge".split(),
    "company": "Aster Borealis Cobalt Delphi Ember Fathom Granite Helix Indigo Juniper Krill Lumen Meridian Nimbus".split(),
    "suffix": "GmbH Ltd Inc SA AB Group Partners Labs".split(),
    "job": "Analyst Engineer Manager Designer Accountant Technician Nurse Teacher Consultant Planner Clerk Architect".split(),
    "color": "red orange yellow green blue indigo violet black white grey".split(),
    "currency": "EUR USD GBP JPY CHF SEK NOK CAD".split(),
    "word": "amber basin cable delta engine fable garnet harbor island jacket kernel ladder magnet needle orbit pebble quartz ribbon signal timber".split(),
    "product": "Lamp Chair Kettle Router Jacket Bottle Notebook Charger Backpack Speaker".split(),
    "language": "en de fr es it pt nl sv".split(),
}


def _say(c: Context, provider: str) -> Column:
    w = lambda table, k=0: pick(WORDS[table], c.draws.below(len(WORDS[table]), f"{table}{k}"))
    name = lambda: F.concat_ws(" ", w("first_name"), w("last_name"))
    handle = lambda: F.concat(F.lower(w("first_name")), F.lit("."), F.lower(w("last_name")), c.draws.below(1000, "n").cast("string"))
    sentence = lambda k=0: F.concat(F.initcap(w("word", f"s{k}")), *[F.concat(F.lit(" "), w("word", f"{k}.{i}")) for i in range(7)], F.lit("."))
    made = {
        "name": name, "full_name": name, "user_name": handle, "username": handle, "email": lambda: F.concat(handle(), F.lit("@example.com")), "safe_email": lambda: F.concat(handle(), F.lit("@example.com")),
        "domain_name": lambda: F.concat(F.lower(w("company")), F.lit(".example.com")), "hostname": lambda: F.concat(w("word"), F.lit("-"), c.draws.below(100, "h").cast("string"), F.lit(".example.net")),
        "url": lambda: F.concat(F.lit("https://"), F.lower(w("company")), F.lit(".example.com/"), w("word")), "uri": lambda: F.concat(F.lit("https://example.com/"), w("word")),
        "company": lambda: F.concat_ws(" ", w("company"), w("suffix")), "street_address": lambda: F.concat((c.draws.below(200, "no") + 1).cast("string"), F.lit(" "), w("street"), F.lit(" Street")),
        "address": lambda: F.concat((c.draws.below(200, "no") + 1).cast("string"), F.lit(" "), w("street"), F.lit(" Street, "), w("city")), "postcode": lambda: F.lpad(c.draws.below(100000, "zip").cast("string"), 5, "0"),
        "zipcode": lambda: F.lpad(c.draws.below(100000, "zip").cast("string"), 5, "0"), "state": lambda: w("city", "s"), "country_code": lambda: F.upper(F.substring(w("country"), 1, 2)),
        "currency_code": lambda: w("currency"), "color_name": lambda: w("color"), "sentence": sentence, "catch_phrase": lambda: F.concat_ws(" ", F.initcap(w("word", 1)), w("word", 2), w("word", 3)),
        "paragraph": lambda: F.concat_ws(" ", *[sentence(i) for i in range(4)]), "text": lambda: F.concat_ws(" ", *[sentence(i) for i in range(3)]), "language_code": lambda: w("language"),
        "phone_number": lambda: GENERATORS["phone"]({}, c), "ssn": lambda: GENERATORS["government_id"]({}, c), "ipv4": lambda: GENERATORS["ip"]({}, c), "mac_address": lambda: GENERATORS["mac"]({}, c), "uuid4": lambda: GENERATORS["uuid"]({}, c),
        "latitude": lambda: F.round(c.draws.u("lat") * 180 - 90, 6), "longitude": lambda: F.round(c.draws.u("lon") * 360 - 180, 6),
        "user_agent": lambda: F.concat(F.lit("Mozilla/5.0 (example; "), w("word"), F.lit(")")), "file_name": lambda: F.concat(w("word"), F.lit(".txt")), "iban": lambda: F.concat(F.lit("XX00"), random_text(c.draws, ALPHABETS["digits"], 16)),
    }
    if provider in made:
        return made[provider]()
    if provider in WORDS:
        return w(provider)
    c.fail(f"unknown provider {provider!r}; known: {', '.join(sorted({*made, *WORDS}))}")


@generator("faker", "fake")
def _faker(o, c):
    return _say(c, str(opt(o, "provider", "method", "kind", default=c.name)))


# ---------------------------------------------------------------- compositions
@generator("composite", "pipeline", "chain")
def _composite(o, c):
    steps = opt(o, "steps", "generators") or c.fail("a composite needs steps")
    x = None
    for i, s in enumerate(steps):
        s = {"type": s} if isinstance(s, str) else dict(s)
        if "type" not in s and len(s) == 1:
            (k, v), = s.items()
            s = {"type": k, **(v if isinstance(v, dict) else {"value": v})}
        kind = canonical(s.pop("type"))
        inner = Context(**{**c.__dict__, "draws": c.draws.sub(str(i))})
        if kind == "transform":
            x, _ = tf.apply(x, T.StringType(), _steps(opt(s, "operations", "steps", "value")))
        else:
            # a later step sees the value before it as `value`
            if x is not None:
                at = Translator({**c.columns, "value": Value(x, "str" if _is_text(c) else "float")}, c.attribute, f"{c.entity}.{c.name}")
                if kind == "expression":
                    x = at.value(str(opt(s, "expression", "value"))).col
                    continue
            x = GENERATORS[kind](s, inner)
    return x


def _steps(ops: Any) -> list[str]:
    return ops.split("|") if isinstance(ops, str) else [o if isinstance(o, str) else ":".join(map(str, next(iter(o.items())))) for o in ops or []]


@generator("transform", "post_process")
def _transform(o, c):
    source = opt(o, "source", "field", "from") or c.fail("a transform needs a source")
    kind = c.schema[source].dataType if c.values is None and source in c.schema.names else T.StringType()
    return tf.apply(c.expression(source).col, kind, _steps(opt(o, "operations", "steps")))[0]


# ---------------------------------------------------------------- simulation (columns made before the fields)
@generator("event_time", "occurred_at", "timeline")
def _event_time(o, c):
    t = c.sim.get("time") if str(opt(o, "spread", default="ordered")) == "ordered" else c.sim.get("random_time")
    if t is None:
        c.fail("an event time needs a timeline")
    if (f := opt(o, "offset_field")) is not None:
        t = after(t, c.column(f).cast("double") * 3600)
    if (h := opt(o, "offset")) is not None:
        t = after(t, F.lit(float(h) * 3600))
    return F.to_date(t) if c.type == "date" else F.date_format(t, "HH:mm:ss") if c.type == "time" else t


@generator("subject", "belongs_to_subject", "actor")
def _subject(o, c):
    return c.sim.get(f"subject.{o['field']}" if o.get("field") else "subject") if c.sim else c.fail("a subject needs a simulation")


@generator("state", "running", "accumulated")
def _state(o, c):
    name = f"state.{opt(o, 'variable', default=c.name)}"
    return c.sim[name] if name in c.sim else c.fail(f"there is no state {name!r}")


@generator("scenario", "incident", "affected_by")
def _scenario(o, c):
    report = str(opt(o, "report", default="name"))
    x = c.sim.get(f"scenario.{report}", F.lit(None))
    normal = opt(o, "normal")
    return F.coalesce(x, F.lit(normal)) if normal is not None else x


# ---------------------------------------------------------------- providers and what is refused
def fitted(type_name: str, text: str) -> Column:
    """A placeholder that fits the field's type."""
    fit = {"integer": 0, "float": 0.0, "decimal": 0, "boolean": False, "date": dt.date(1970, 1, 1), "datetime": "1970-01-01 00:00:00", "array": None, "object": None}
    return F.lit(fit.get(type_name, text))


def unavailable(o: dict[str, Any], c: Context, what: str) -> Column:
    policy = str(opt(o, "on_unavailable", default="error"))
    if policy == "placeholder":
        return fitted(c.type, f"[{what}]")
    if policy == "null":
        return F.lit(None)
    c.fail(f"{what} is not available")


@generator("script", "python", "custom")
def _script(o, c):
    return unavailable(o, c, "script")


@generator("llm", "language_model", "ai", "gpt")
def _llm(o, c):
    from spindrift.operators.enrichment import LANGUAGE_MODELS

    name = str(opt(o, "provider", default="mock"))
    if name not in LANGUAGE_MODELS:
        return unavailable(o, c, f"provider {name}")
    context = [c.column(n).cast("string") for n in opt(o, "context", default=[]) if n in c.columns]
    return LANGUAGE_MODELS[name](F.lit(str(opt(o, "prompt", "description", default=c.name))), F.concat_ws("; ", *context) if context else F.lit(""), c.draws.bits("llm"), int(opt(o, "max_tokens", default=40)))


@generator("image", "invokeai", "text_to_image")
def _image(o, c):
    from spindrift.operators.enrichment import IMAGES

    name = str(opt(o, "provider", default="procedural"))
    if name not in IMAGES:
        return unavailable(o, c, f"provider {name}")
    return F.concat(F.lit("image-"), F.sha2(IMAGES[name](c.draws.bits("image"), F.lit(int(opt(o, "width", default=64))), F.lit(int(opt(o, "height", default=64)))), 256), F.lit(".png"))


@generator("tts", "speech", "voice")
def _tts(o, c):
    from spindrift.operators.enrichment import SPEECH

    name = str(opt(o, "provider", default="procedural"))
    if name not in SPEECH:
        return unavailable(o, c, f"provider {name}")
    text = c.expression(str(o["source"])).col.cast("string") if opt(o, "source") else F.lit(str(opt(o, "text", default=c.name)))
    return F.concat(F.lit("audio-"), F.sha2(SPEECH[name](text, F.lit(int(opt(o, "sample_rate", default=8000)))), 256), F.lit(".wav"))


@generator("document", "pdf", "invoice", "report")
def _document(o, c):
    from spindrift.operators.enrichment import simple_pdf

    source = str(opt(o, "template", default="") or "") or (open(opt(o, "template_path"), encoding="utf-8").read() if opt(o, "template_path") else "{" + c.schema.names[0] + "}")
    body = _template({"template": source}, c)
    form = str(opt(o, "format", default="txt"))
    if form == "pdf":
        return F.base64(simple_pdf(F.lit(str(opt(o, "title", default=c.name))), body))
    return F.concat(F.lit(f"<html><head><title>{opt(o, 'title', default=c.name)}</title></head><body>"), body, F.lit("</body></html>")) if form == "html" else body


@F.pandas_udf(T.DoubleType())
def _beta(u, a, b):  # noqa: ANN001
    import numpy as np
    import pandas as pd

    x = (np.arange(200_000) + 0.5) / 200_000
    log_density = (float(a.iloc[0]) - 1) * np.log(x) + (float(b.iloc[0]) - 1) * np.log1p(-x)
    cdf = np.cumsum(np.exp(log_density - log_density.max()))
    return pd.Series(np.interp(u.to_numpy() * cdf[-1], cdf, x))


def beta_quantile(u: Column, a: float, b: float) -> Column:
    """The inverse of the beta distribution on a grid of 200,000 steps."""
    return _beta(u, F.lit(a), F.lit(b))
