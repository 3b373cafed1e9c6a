"""File sources, sinks and the file transform: read, patch, write beside, rename."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import patches

FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "parquet": "parquet", "sqlite": "sqlite", "db": "sqlite", "sql": "sql"}
#: Formats added by name: write(frame, path, mode, options).
WRITERS: dict[str, Any] = {}
#: Different values of the partition columns that one write may have.
MOST_PARTITIONS = 512
NULL_PARTITION = "__null__"


def format_of(path: str, given: str | None = None) -> str:
    name = given or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if name in WRITERS:
        return name
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(FORMATS)}")
    return FORMATS[name]


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines fail fast on broken lines; CSV cells are text; JSON arrays are read whole."""
    kind, reader = format_of(path, fmt), spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("json", "jsonl"):
        return reader.option("mode", "FAILFAST").option("multiLine", kind == "json").json(path)
    raise ValueError(f"{kind} is not a source")


def _flat(df: DataFrame) -> DataFrame:
    """Nested, binary and interval columns as text, for formats without them."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.regexp_replace(F.base64(c), r"\s", "").alias(f.name)
        if isinstance(f.dataType, T.DayTimeIntervalType):
            return (F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)).cast("double").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def partition_value(c: Column) -> Column:
    """A partition's name: unsafe characters as _, null by name."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[^A-Za-z0-9._=-]", "_"), F.lit(NULL_PARTITION))


def with_date_parts(df: DataFrame, names: Iterable[str], source: str | None = None) -> DataFrame:
    """year, month, day and hour of the first temporal column, where partitions ask for them and no field has the name."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
    source = source or next((f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)
    for n in names:
        if n not in df.columns and n in parts and source:
            df = df.withColumn(n, parts[n](F.col(source)))
    return df


def write(df: DataFrame, path: str, fmt: str | None = None, partition_by: Iterable[str] = (), mode: str = "errorifexists", table: str = "records", primary_key: str | None = None, relaxed: bool = False, options: dict[str, Any] | None = None) -> None:
    kind, names, options = format_of(path, fmt), list(partition_by), options or {}
    if kind in WRITERS:
        return WRITERS[kind](df, path, mode, options)
    if names:
        df = with_date_parts(df, names)
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"partition columns {missing} are not fields")
        if df.select(*names).distinct().limit(MOST_PARTITIONS + 1).count() > MOST_PARTITIONS:
            raise ValueError(f"more than {MOST_PARTITIONS} partitions")
        named = df.withColumns({f"__p_{n}": partition_value(F.col(n)) for n in names}) if kind != "parquet" else df.withColumns({n: partition_value(F.col(n)) for n in names})
        if kind == "parquet":
            return named.write.mode(mode).options(**options).partitionBy(*names).parquet(path)
        # text formats keep the columns, too
        out = _flat(named) if kind == "csv" else named
        writer = out.write.mode(mode).partitionBy(*[f"__p_{n}" for n in names])
        return writer.option("header", True).csv(path) if kind == "csv" else writer.option("ignoreNullFields", False).json(path)
    if kind == "parquet":
        return df.write.mode(mode).options(**options).parquet(path)
    if kind == "jsonl":
        return df.write.mode(mode).option("ignoreNullFields", False).json(path)
    if kind == "csv":
        return _flat(df).write.mode(mode).option("header", True).option("escape", '"').options(**options).csv(path)
    if kind == "json":
        return _write_json_array(df, path, mode)
    if kind == "sqlite":
        return _write_sqlite(df, path, table, primary_key, relaxed, mode)
    return _sql_script(df, table, primary_key).write.mode(mode).text(path)


def _new_file(path: str, mode: str) -> str:
    path = path.removeprefix("file://")
    if os.path.exists(path) and mode == "errorifexists":
        raise FileExistsError(path)
    return path


def _write_json_array(df: DataFrame, path: str, mode: str) -> None:
    """One array in one file: for small results, streamed row by row."""
    path, first = _new_file(path, mode), True
    with open(path + ".partial", "w", encoding="utf-8") as f:
        f.write("[")
        for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write("\n  " if first else ",\n  ")
            f.write(r.j)
            first = False
        f.write("\n]\n")
    os.replace(path + ".partial", path)


def _sql_type(t: T.DataType) -> str:
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(t, (T.FractionalType,)):
        return "REAL" if not isinstance(t, T.DecimalType) else "NUMERIC"
    return "BLOB" if isinstance(t, T.BinaryType) else "TEXT"


def ddl(schema: T.StructType, table: str, primary_key: str | None = None, relaxed: bool = False, foreign: dict[str, tuple[str, str]] | None = None) -> str:
    """CREATE TABLE; relaxed leaves constraints out, as damaged data needs."""
    cols = []
    for f in schema.fields:
        c = f'"{f.name}" {_sql_type(f.dataType)}'
        if not relaxed:
            c += " PRIMARY KEY" if f.name == primary_key else "" if f.nullable else " NOT NULL"
        cols.append(c)
    if not relaxed:
        cols += [f'FOREIGN KEY ("{c}") REFERENCES "{t}" ("{k}")' for c, (t, k) in (foreign or {}).items()]
    return f'CREATE TABLE "{table}" ({", ".join(cols)})'


def _write_sqlite(df: DataFrame, path: str, table: str, key: str | None, relaxed: bool, mode: str) -> None:
    path = path.removeprefix("file://")
    flat = _flat(df)
    flat = flat.select(*[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)) else F.col(f"`{f.name}`") for f in flat.schema.fields])
    db = sqlite3.connect(path)
    try:
        if mode == "overwrite":
            db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(ddl(df.schema, table, key, relaxed))
        marks = ", ".join("?" * len(df.columns))
        rows = flat.toLocalIterator(prefetchPartitions=True)
        while batch := [tuple(r) for _, r in zip(range(500), rows)]:
            db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', batch)
        db.commit()
    finally:
        db.close()


def _literal(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.NumericType,)):
        text = c.cast("string")
    elif isinstance(t, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(F.when(c.isNull(), "NULL").otherwise(text), F.lit("NULL"))


def _sql_script(df: DataFrame, table: str, key: str | None) -> DataFrame:
    """DDL, then an INSERT for every row, rendered where the rows are."""
    flat = _flat(df)
    values = F.concat(F.lit(f'INSERT INTO "{table}" VALUES ('), F.concat_ws(", ", *[_literal(F.col(f"`{f.name}`"), f.dataType) for f in flat.schema.fields]), F.lit(");"))
    head = df.sparkSession.createDataFrame([(ddl(df.schema, table, key) + ";",)], "value string")
    return head.union(flat.select(values.alias("value")))


def transform_file(spark: SparkSession, source: str, to: str, rules: Iterable[Any], fmt: str | None = None, force: bool = False, keep_columns: bool = True) -> dict[str, Any]:
    """Reads, patches, writes beside the destination, renames, and leaves a summary there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(to)
    fs = path.getFileSystem(conf)
    if fs.exists(path) and not force:
        raise FileExistsError(to)
    df = read(spark, source, fmt or format_of(source))
    out, seen = patches.apply_counted(df, rules)
    if keep_columns and format_of(to) == "csv" and set(out.columns) - set(df.columns):
        raise ValueError(f"a CSV can't gain columns: {sorted(set(out.columns) - set(df.columns))}")
    partial = jvm.org.apache.hadoop.fs.Path(to + ".partial")
    fs.delete(partial, True)
    write(out, to + ".partial", format_of(to), mode="overwrite")
    if fs.exists(path):
        fs.delete(path, True)
    fs.rename(partial, path)
    stats = {"rules": [{"rule": name, **o.get} for name, o in seen], "source": source, "destination": to}
    side = fs.create(jvm.org.apache.hadoop.fs.Path(to + ".transform.json"), True)
    side.write(bytearray(json.dumps(stats, indent=2).encode()))
    side.close()
    return stats


def write_range(df: DataFrame, path: str, start: int, end: int) -> bool:
    """Writes the rows of one index range to a directory of its own; a range that is complete is left alone. Returns whether it wrote."""
    spark, to = df.sparkSession, f"{path}/range={start:012d}-{end:012d}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to + "/_SUCCESS")
    if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return False
    df.write.mode("overwrite").parquet(to)
    return True


def store_assets(df: DataFrame, payload: str, path: str, suffix: str) -> DataFrame:
    """Content-addressed payloads: each different one is written once under its hash; returns df with `asset`, the name."""
    named = df.withColumn("asset", F.concat(F.sha2(F.col(payload), 256), F.lit(suffix)))
    one = named.groupBy("asset").agg(F.first(payload).alias("content"))
    one.write.mode("append").parquet(path)
    return named
