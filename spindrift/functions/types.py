"""The 28 field types: the Spark type that holds each, a coercion and a check as Columns.

Coercion forgives and leaves null where a value has no reading (the caller keeps the
original); a check is true for a value that is already of the type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shapes that text of these types has.
HOSTNAME = r"^(?=.{1,253}$)([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MAC = r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:.+"
DURATION = r"^P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"
UUID = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
IPV6 = r"^(?=.*:)(?!.*:::)(?!.*::.*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$"
_TRUE, _FALSE = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")

GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@dataclass(frozen=True)
class FieldType:
    name: str
    spark: T.DataType
    group: str  # numeric, textual, temporal, media, nested, other


def _decimal(precision: int | None) -> T.DataType:
    return T.DecimalType(38, 2 if precision is None else precision)


TYPES: dict[str, FieldType] = {
    name: FieldType(name, kind, group)
    for group, names in {
        "textual": {k: T.StringType() for k in ("string", "text", "uuid", "enum", "uri", "ip_address", "cidr", "mac_address", "hostname", "email", "phone")},
        "numeric": {"integer": T.LongType(), "float": T.DoubleType(), "decimal": _decimal(None)},
        "temporal": {"date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampNTZType(), "duration": T.DayTimeIntervalType()},
        "media": {k: T.StringType() for k in ("image", "audio", "file")},
        "nested": {"array": T.ArrayType(T.StringType()), "object": T.MapType(T.StringType(), T.StringType()), "geo_point": GEO, "json": T.StringType()},
        "other": {"boolean": T.BooleanType(), "binary": T.BinaryType(), "custom": T.StringType()},
    }.items()
    for name, kind in names.items()
}


def spark_type(name: str, precision: int | None = None) -> T.DataType:
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}; known: {', '.join(sorted(TYPES))}")
    return _decimal(precision) if name == "decimal" else TYPES[name].spark


def coerce(x: Column, name: str, precision: int | None = None) -> Column:
    """The value as that type, null where it has no such reading. x is any column; text is trimmed first."""
    s = F.trim(x.cast("string"))
    if name == "boolean":
        low = F.lower(s)
        return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)
    if name == "integer":
        whole = F.regexp_extract(s, r"^([+-]?\d+)(\.0*)?$", 1)
        return F.when(F.lower(s) == "true", F.lit(1)).when(F.lower(s) == "false", F.lit(0)).otherwise(F.when(whole != "", whole)).try_cast("long")
    if name in ("float", "decimal"):
        return s.try_cast(spark_type(name, precision))
    if name == "date":
        return F.coalesce(s.try_cast("date"), s.try_cast("timestamp_ntz").try_cast("date"))
    if name == "datetime":
        return F.regexp_replace(s, "Z$", "").try_cast("timestamp_ntz")
    if name == "time":
        return F.when(s.rlike(TIME), F.when(F.length(s) == 5, F.concat(s, F.lit(":00"))).otherwise(s))
    if name == "duration":
        return F.make_dt_interval(secs=s.try_cast("decimal(18,6)"))
    if name == "uuid":
        h = F.regexp_replace(F.lower(s), "[{}-]", "")
        cut = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.when(s.rlike(UUID), cut)
    if name == "binary":
        return F.encode(x.cast("string"), "UTF-8")
    if name == "geo_point":
        pair = F.split(F.regexp_replace(s, r"[\[\]()]", ""), r"\s*,\s*")
        lat = F.coalesce(F.get_json_object(s, "$.lat"), F.get_json_object(s, "$.latitude"), F.try_element_at(pair, F.lit(1))).try_cast("double")
        lon = F.coalesce(F.get_json_object(s, "$.lon"), F.get_json_object(s, "$.lng"), F.get_json_object(s, "$.longitude"), F.try_element_at(pair, F.lit(2))).try_cast("double")
        return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
    if name == "array":
        return F.from_json(s, "array<string>")
    if name == "object":
        return F.from_json(s, "map<string,string>")
    if name == "ip_address":
        return F.when(s.rlike(IPV4), s).when(s.rlike(IPV6), F.lower(s))
    if name == "cidr":
        ip, bits = F.split_part(s, F.lit("/"), F.lit(1)), F.split_part(s, F.lit("/"), F.lit(2)).try_cast("int")
        octet = [F.split_part(ip, F.lit("."), F.lit(i + 1)).try_cast("long") for i in range(4)]
        number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
        block = F.pow(F.lit(2), 32 - bits).cast("long")
        base = number - number % block
        dotted = F.concat_ws(".", *[(F.floor(base / (256 ** (3 - i))) % 256).cast("string") for i in range(4)])
        return F.when(ip.rlike(IPV4) & bits.between(0, 32), F.concat(dotted, F.lit("/"), bits.cast("string")))
    return x.cast("string")


def check(x: Column, name: str) -> Column:
    """Whether a value (of the type's own Spark type, or text) is valid; null is."""
    s = x.cast("string") if name not in ("geo_point", "array", "object", "binary") else None
    shape = {"hostname": HOSTNAME, "email": EMAIL, "mac_address": MAC, "uri": URI, "uuid": UUID, "time": TIME}
    if name in shape:
        ok = s.rlike(shape[name])
    elif name == "ip_address":
        ok = s.rlike(IPV4) | s.rlike(IPV6)
    elif name == "cidr":
        ok = coerce(s, "cidr").isNotNull() | (F.split_part(s, F.lit("/"), F.lit(1)).rlike(IPV6) & F.split_part(s, F.lit("/"), F.lit(2)).try_cast("int").between(0, 128))
    elif name == "duration":
        ok = s.rlike(DURATION) | s.startswith("INTERVAL")
    elif name == "geo_point":
        ok = x["lat"].between(-90, 90) & x["lon"].between(-180, 180)
    elif name == "json":
        ok = F.try_parse_json(s).isNotNull() | (F.lower(F.trim(s)) == "null")
    elif name in ("integer", "float", "decimal", "boolean", "date", "datetime"):
        ok = coerce(x, name).isNotNull()
    else:
        ok = F.lit(True)
    return x.isNull() | F.coalesce(ok, F.lit(False))
