"""One query for each operator over the test tables, with the SQL that must agree.

Draws are in portable mode, so that SQL computes the same uniforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions.expressions import condition, translate
from spindrift.functions.hashing import PORTABLE, Draws
from spindrift.operators import chaos, duplicates, generators, patches, simulation, validation
from spindrift.operators.relations import parent_index, self_index
from spindrift.sources.files import partition_value

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_sql(index: str, field: str, k: str | int = 0, entity: str = "e", seed: int = 7) -> str:
    return f"(('0x' || substr(md5('{seed}|{entity}|' || {index} || '|{field}|{k}'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496)"


def draws(index: str, field: str, entity: str = "e") -> Draws:
    return Draws(7, entity, F.col(index), field, PORTABLE)


def context(df: DataFrame, index: str, name: str, type_name: str = "string", **constraints) -> generators.Context:
    return generators.Context(name, type_name, "e", F.col(index), draws(index, name), df.schema, constraints)


def generated(df: DataFrame, index: str, name: str, kind: str, options: dict, type_name: str = "string", **constraints):
    return generators.GENERATORS[generators.canonical(kind)](options, context(df, index, name, type_name, **constraints))


# ---------------------------------------------------------------- patches
@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) ELSE c_name END AS c_name, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def patch_mask_and_drop(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return patches.apply(df, [{"where": "c_mktsegment == 'BUILDING'", "set": {"c_name": "mask:4"}}, {"where": "c_acctbal < 0", "drop": True}]).drop("c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000")
def patch_keep(spark, d):
    return patches.apply(table(spark, d, "orders"), [{"where": "o_orderstatus in ['F', 'O'] and o_totalprice > 1000", "keep": True}]).select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS o_orderpriority, o_orderstatus, o_custkey % 10 AS bucket FROM orders),
b AS (SELECT *, CASE WHEN bucket > 5 THEN 'high' ELSE NULL END AS band FROM a)
SELECT o_orderkey, o_orderpriority, bucket, band, CASE WHEN bucket > 5 THEN coalesce(band, 'None') || '-' || o_orderstatus ELSE NULL END AS label FROM b WHERE bucket <> 3""")
def patch_compose(spark, d):
    rules = [{"set": {"o_orderpriority": "lower", "bucket": "o_custkey % 10"}}, {"where": "bucket > 5", "set": {"band": "'high'", "label": "concat(band, '-', o_orderstatus)"}}, {"where": "bucket == 3", "drop": True}]
    return patches.apply(table(spark, d, "orders"), rules).select("o_orderkey", "o_orderpriority", "bucket", "band", "label")


# ---------------------------------------------------------------- transforms
def _op(df: DataFrame, key: str, field: str, ops: dict[str, str]) -> DataFrame:
    return df.select(key, *[patches.edited(df.select(key, field), field, step, name).alias(name) for name, step in ops.items()])


@query("""SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, substr(p_name, 1, 5) AS cut, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
repeat('*', greatest(length(p_name) - 3, 0)) || right(p_name, 3) AS masked, substr(sha256(p_name), 1, 12) AS hashed, lower(hex(p_name)) AS hexed, to_base64(encode(p_name)) AS b64, NULL::VARCHAR AS gone FROM part""")
def op_text(spark, d):
    return _op(table(spark, d, "part"), "p_partkey", "p_name", {"low": "lowercase", "up": "upper", "cut": "truncate:5", "slug": "slug", "masked": "redact:3", "hashed": "hash:12", "hexed": "encode:hex", "b64": "b64", "gone": "nullify"})


@query("SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment || '-' || c_name), '[a-z]+|[^a-z]'), lambda w: upper(w[1]) || w[2:]), '') AS titled FROM customer")
def op_title(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", tx.title(F.concat_ws("-", "c_mktsegment", "c_name")).alias("titled"))


@query("SELECT s_suppkey, round_even(s_acctbal::DECIMAL(18,2), 0)::BIGINT AS even FROM supplier")
def op_round_even(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("x"))
    return _op(df, "s_suppkey", "x", {"even": "round:0"}).withColumn("even", F.col("even").cast("long"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%d/%m/%Y') AS dmy, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS dd FROM orders")
def op_format_date(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    made = {"y": "year(o_orderdate)", "m": "month(o_orderdate)", "dd": "day(o_orderdate)"}
    dates = _op(df, "o_orderkey", "o_orderdate", {"ym": "format_date:%Y-%m", "dmy": "date_format:%d/%m/%Y"})
    return dates.join(df.select("o_orderkey", *[translate(x, df.schema).alias(n) for n, x in made.items()]), "o_orderkey")


_NOISE = "(('0x' || substr(md5('noise|' || {x}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496)"


@query(f"SELECT c_custkey, round_even(c_nationkey * (1 + (2 * {_NOISE.format(x='c_nationkey')} - 1) * 5 / 100), 0)::BIGINT AS noisy FROM customer")
def op_noise(spark, d):
    return _op(table(spark, d, "customer"), "c_custkey", "c_nationkey", {"noisy": "noise:5"})


@query("SELECT n_nationkey, trim(regexp_replace(n_name, '\\s+', ' ', 'g')) || ' fi e' || chr(769) AS norm, 'e' || chr(769) AS composed, 'ﬁ' || n_name AS back FROM nation".replace("' fi e' || chr(769)", "' fi é'").replace("'e' || chr(769) AS composed", "'é' AS composed"))
def op_normalize_compress(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("  ﬁ 	 é ")).alias("x"), F.lit("é").alias("y"), F.concat(F.lit("ﬁ"), "n_name").alias("z"))
    made = _op(df, "n_nationkey", "x", {"norm": "normalize"}).join(_op(df, "n_nationkey", "y", {"composed": "normalize"}), "n_nationkey")
    return made.join(_op(df, "n_nationkey", "z", {"back": "compress:9|decompress"}), "n_nationkey")


# ---------------------------------------------------------------- expressions
def _expr(spark, d, name: str, key: str, made: dict[str, str]) -> DataFrame:
    df = table(spark, d, name)
    return df.select(key, *[translate(x, df.schema, n).alias(n) for n, x in made.items()])


@query("""SELECT l_orderkey * 10 + l_linenumber AS k, floor(l_partkey / 7.0)::BIGINT AS fdiv, (-l_partkey) - 7 * floor(-l_partkey / 7.0)::BIGINT AS fmod, l_partkey / 4.0::DOUBLE AS tdiv,
(l_linenumber * l_linenumber)::BIGINT AS squared, greatest(l_partkey, l_suppkey) AS most, least(l_partkey, l_suppkey, 50) AS least_of, abs(l_suppkey - l_partkey) AS gap, l_linenumber + l_partkey + 5 AS total FROM lineitem""")
def expr_arithmetic(spark, d):
    made = {"k": "l_orderkey * 10 + l_linenumber", "fdiv": "l_partkey // 7", "fmod": "(-l_partkey) % 7", "tdiv": "l_partkey / 4", "squared": "l_linenumber ** 2", "most": "max(l_partkey, l_suppkey)", "least_of": "min(l_partkey, l_suppkey, 50)", "gap": "abs(l_suppkey - l_partkey)", "total": "sum([l_linenumber, l_partkey, 5])"}
    return _expr(spark, d, "lineitem", "l_linenumber", made).drop("l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, o_orderstatus IN ('F', 'P') AS done, NOT (o_totalprice >= 1000 AND o_totalprice < 100000) AS outside,
o_orderstatus IS NULL AS none, contains(o_orderpriority, 'URG') AS urgent, starts_with(o_orderpriority, '1') AS one, o_orderstatus = 'F' OR o_totalprice > 100000 AS either FROM orders""")
def expr_logic(spark, d):
    made = {"size": "'big' if o_totalprice > 150000 else iif(o_totalprice > 50000, 'mid', 'small')", "done": "o_orderstatus in ['F', 'P']", "outside": "not (1000 <= o_totalprice < 100000)", "none": "o_orderstatus == null", "urgent": "'URG' in o_orderpriority", "one": "startswith(o_orderpriority, '1')", "either": "o_orderstatus == 'F' or o_totalprice > 100000"}
    return _expr(spark, d, "orders", "o_orderkey", made)


@query("""SELECT c_custkey, substr(c_name, 2, 3) AS inner_part, right(c_name, 3) AS tail, replace(c_name, 'Customer', 'C') AS short, length(c_name)::BIGINT AS n, 'x' || c_mktsegment AS joined, c_mktsegment || ':' || c_custkey AS both_of,
CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'none' END AS valued, trim('  ' || c_mktsegment || '  ') AS stripped, c_custkey::VARCHAR AS texted, coalesce(c_mktsegment, 'q') AS first_of, array_to_string([c_name, c_mktsegment], '/') AS listed, substr(sha256(c_name), 1, 12) AS h FROM customer""")
def expr_text(spark, d):
    made = {"inner_part": "substr(c_name, 1, 4)", "tail": "substr(c_name, -3)", "short": "replace(c_name, 'Customer', 'C')", "n": "len(c_name)", "joined": "'x' + c_mktsegment", "both_of": "concat(c_mktsegment, ':', c_custkey)", "valued": "c_mktsegment or 'none'", "stripped": "strip('  ' + c_mktsegment + '  ')", "texted": "str(c_custkey)", "first_of": "coalesce(c_mktsegment, 'q')", "listed": "join('/', [c_name, c_mktsegment])", "h": "hash(c_name)"}
    return _expr(spark, d, "customer", "c_custkey", made)


@query("SELECT event_id, value IS NOT DISTINCT FROM NULL AS missing, coalesce(value > 50, false) AS high, coalesce(value, 0) <> 0 AS truth, trunc(value)::BIGINT AS whole FROM events")
def expr_null(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", translate("value == null", df.schema).alias("missing"), condition("value > 50", df.schema).alias("high"), condition("value", df.schema).alias("truth"), translate("int(value)", df.schema).alias("whole"))


@query("""SELECT s_suppkey, lower(s_name) AS f_lower, upper(s_name) AS f_upper, substr(s_name, 1, 1) AS f_initial, substr(s_name, 1, 4) AS f_trunc, CASE WHEN length(s_suppkey::VARCHAR) < 6 THEN lpad(s_suppkey::VARCHAR, 6, '0') ELSE s_suppkey::VARCHAR END AS f_pad,
regexp_replace(s_name, '\\s+', '', 'g') AS f_nospace, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS f_slug FROM supplier""")
def template_filters(spark, d):
    df = table(spark, d, "supplier")
    made = {"f_lower": "{s_name|lower}", "f_upper": "{s_name|upper}", "f_initial": "{s_name|initial}", "f_trunc": "{s_name|trunc:4}", "f_pad": "{s_suppkey|pad:6}", "f_nospace": "{s_name|nospace}", "f_slug": "{s_name|slug}"}
    return df.select("s_suppkey", *[generated(df, "s_suppkey", n, "template", {"template": t}).alias(n) for n, t in made.items()])


# ---------------------------------------------------------------- generators
@query("SELECT c_custkey, 'EMP-' || lpad((c_custkey * 2 + 100)::VARCHAR, 8, '0') AS code, c_custkey + 1 AS n, lpad((c_custkey + 1)::VARCHAR, 9, '0') AS padded, 'x' AS fixed, NULL::VARCHAR AS none FROM customer")
def gen_sequence(spark, d):
    df = table(spark, d, "customer")
    g = lambda *a, **k: generated(df, "c_custkey", *a, **k)
    return df.select("c_custkey", g("code", "sequence", {"start": 100, "step": 2, "format": "EMP-{00000000}"}).alias("code"), g("n", "serial", {}, "integer").alias("n"), g("padded", "sequence", {"pad": 9}).alias("padded"), g("fixed", "constant", {"value": "x"}).alias("fixed"), g("none", "null", {}).cast("string").alias("none"))


_DIGIT = lambda k: f"floor({u_sql('c_custkey', 'p', k)} * 10)::BIGINT::VARCHAR"


@query(f"SELECT c_custkey, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + floor({u_sql('c_custkey', 'p', 0)} * 26)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + floor({u_sql('c_custkey', 'p', 1)} * 26)::INT, 1) || '-' || {_DIGIT(2)} || {_DIGIT(3)} AS p FROM customer")
def gen_pattern(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", generated(df, "c_custkey", "p", "pattern", {"pattern": "{A-Z:2}-{00}"}).alias("p"))


@query(f"SELECT c_custkey, CASE WHEN {u_sql('c_custkey', 'w')} * 10 <= 7 THEN 'a' WHEN {u_sql('c_custkey', 'w')} * 10 <= 9 THEN 'b' ELSE 'c' END AS w, {u_sql('c_custkey', 'b')} < 0.3 AS b, floor({u_sql('c_custkey', 'i')} * 91)::BIGINT + 10 AS i, round(5 + {u_sql('c_custkey', 'f')} * 20, 6) AS f, ['red','green','blue'][1 + c_custkey % 3] AS cyc, ['red','green','blue'][1 + floor({u_sql('c_custkey', 'lk')} * 3)::INT] AS lk FROM customer")
def gen_choices(spark, d):
    df = table(spark, d, "customer")
    g = lambda *a, **k: generated(df, "c_custkey", *a, **k)
    colors = {"values": ["red", "green", "blue"]}
    return df.select("c_custkey", g("w", "weighted", {"values": {"a": 7, "b": 2, "c": 1}}).alias("w"), g("b", "boolean", {"probability": 0.3}).alias("b"), g("i", "random", {"min": 10, "max": 100}, "integer").alias("i"), g("f", "random", {"min": 5, "max": 25, "precision": 6}, "float").alias("f"), g("cyc", "lookup", {**colors, "mode": "cycle"}).alias("cyc"), g("lk", "lookup", colors).alias("lk"))


@query(f"SELECT c_custkey, round(-3 * ln(1 - {u_sql('c_custkey', 'ex')}), 6) AS ex, round(10 + 2 * sqrt(-2 * ln(1 - {u_sql('c_custkey', 'no', 'n1')})) * cos(2 * pi() * {u_sql('c_custkey', 'no', 'n2')}), 6) AS no, round(exp(1 + 0.5 * sqrt(-2 * ln(1 - {u_sql('c_custkey', 'lo', 'n1')})) * cos(2 * pi() * {u_sql('c_custkey', 'lo', 'n2')})), 6) AS lo, round(CASE WHEN {u_sql('c_custkey', 'hi')} * 4 < 3 THEN 10 * {u_sql('c_custkey', 'hi', 'bin')} ELSE 10 + 90 * {u_sql('c_custkey', 'hi', 'bin')} END, 6) AS hi FROM customer")
def gen_distributions(spark, d):
    df = table(spark, d, "customer")
    g = lambda *a: generated(df, "c_custkey", *a)
    made = {"ex": {"distribution": "exponential", "scale": 3}, "no": {"distribution": "normal", "mean": 10, "stddev": 2}, "lo": {"distribution": "lognormal", "mean": 1, "sigma": 0.5}, "hi": {"distribution": "histogram", "bins": [{"range": [0, 10], "weight": 3}, {"range": [10, 100], "weight": 1}]}}
    return df.select("c_custkey", *[F.round(g(n, "distribution", o, "float"), 6).alias(n) for n, o in made.items()])


def _poisson_sql(lam: float) -> str:
    table_ = generators.poisson_table(lam)
    u = u_sql("c_custkey", "po")
    return f"least(len(list_filter([{', '.join(repr(x) for x in table_)}]::DOUBLE[], lambda x: x <= {u})), {len(table_) - 1})::BIGINT"


@query(f"SELECT c_custkey, {_poisson_sql(4.0)} AS po FROM customer")
def gen_poisson(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", generated(df, "c_custkey", "po", "distribution", {"distribution": "poisson", "lam": 4}, "integer").alias("po"))


@query("SELECT c_custkey, lower(c_mktsegment) || '.' || lpad(c_nationkey::VARCHAR, 3, '0') || '@' || lower(n_name) || '.example.com' AS address, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM customer JOIN nation ON n_nationkey = c_nationkey")
def gen_template_expression(spark, d):
    df = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("c_custkey", generated(df, "c_custkey", "address", "template", {"template": "{c_mktsegment|lower}.{c_nationkey|pad:3}@{n_name|lower}.example.com"}).alias("address"), generated(df, "c_custkey", "state", "expression", {"expression": "'debt' if c_acctbal < 0 else 'fine'"}).alias("state"))


@query(f"SELECT o_orderkey, CASE WHEN {u_sql('o_orderkey', 'q', 'null')} >= 0.05 THEN o_orderpriority END AS q FROM orders")
def gen_null_injection(spark, d):
    from spindrift.plans.compiler import Project

    p = Project({"project": {"seed": 7}, "entities": {"e": {"fields": {"q": {"type": "string", "generator": "constant", "null_probability": 0.05}}}}}, spark, PORTABLE)
    done = p._finished(p.entities["e"].fields["q"], F.col("o_orderpriority"), "e", F.col("o_orderkey"), None)
    return table(spark, d, "orders").select("o_orderkey", done.col.alias("q"))


_HEX = "md5('7|e|' || c_custkey || '|g|uuid')"


@query(f"SELECT c_custkey, substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-4' || substr({_HEX}, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr({_HEX}, 17, 1))::INT % 4, 1) || substr({_HEX}, 18, 3) || '-' || substr({_HEX}, 21, 12) AS g FROM customer")
def gen_uuid(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", generated(df, "c_custkey", "g", "uuid", {}).alias("g"))


@query(f"SELECT c_custkey, TIMESTAMP '2025-01-01' + to_seconds(floor({u_sql('c_custkey', 'ts')} * 31536000)::BIGINT) AS ts, (TIMESTAMP '2025-01-01' + to_seconds(floor({u_sql('c_custkey', 'dt')} * 31536000)::BIGINT))::DATE AS dt FROM customer")
def gen_datetime(spark, d):
    df = table(spark, d, "customer")
    o = {"start": "2025-01-01", "end": "2026-01-01"}
    return df.select("c_custkey", generated(df, "c_custkey", "ts", "datetime", o, "datetime").alias("ts"), generated(df, "c_custkey", "dt", "datetime", o, "date").alias("dt"))


@query(f"SELECT c_custkey, '10.1.' || ((256 * 1 + 0) * 0 + ((1 + floor({u_sql('c_custkey', 'ip', 'host')} * 65534)::BIGINT) >> 8)) || '.' || ((1 + floor({u_sql('c_custkey', 'ip', 'host')} * 65534)::BIGINT) & 255) AS ip, '+1' || 212 || '55501' || lpad(floor({u_sql('c_custkey', 'ph', 'line')} * 100)::BIGINT::VARCHAR, 2, '0') AS ph, lpad((900 + floor({u_sql('c_custkey', 'ss', 'area')} * 100)::BIGINT)::VARCHAR, 3, '0') || '-' || lpad((1 + floor({u_sql('c_custkey', 'ss', 'group')} * 99)::BIGINT)::VARCHAR, 2, '0') || '-' || lpad((1 + floor({u_sql('c_custkey', 'ss', 'serial')} * 9999)::BIGINT)::VARCHAR, 4, '0') AS ss FROM customer")
def gen_identifiers(spark, d):
    df = table(spark, d, "customer")
    g = lambda *a: generated(df, "c_custkey", *a)
    return df.select("c_custkey", g("ip", "ip", {"network": "10.1.0.0/16"}).alias("ip"), g("ph", "phone", {"area_code": "212"}).alias("ph"), g("ss", "government_id", {}).alias("ss"))


@query()
def gen_providers(spark, d):
    df = table(spark, d, "customer")
    c = lambda n: context(df, "c_custkey", n)
    names = ["name", "email", "company", "address", "sentence", "url", "latitude", "iban"]
    more = {"mac": ("mac", {}), "v6": ("ip", {"version": 6}), "beta": ("distribution", {"distribution": "beta", "alpha": 2, "beta": 5}), "llm": ("llm", {"prompt": "note"}), "doc": ("document", {"template": "Dear {c_name}", "format": "html"})}
    return df.select("c_custkey", *[generators.GENERATORS["faker"]({"provider": n}, c(n)).alias(n) for n in names], *[generated(df, "c_custkey", n, k, o, "float" if n == "beta" else "string").alias(n) for n, (k, o) in more.items()])


# ---------------------------------------------------------------- references
_N = "(SELECT count(*) FROM customer)"


@query(f"SELECT o_orderkey, least(floor({u_sql('o_orderkey', 'ru')} * {_N})::BIGINT, {_N} - 1) AS uni, least(floor(pow({u_sql('o_orderkey', 'rs')}, 1.9::DOUBLE) * {_N})::BIGINT, {_N} - 1) AS skewed, o_orderkey % {_N} AS seq, CASE WHEN o_orderkey > 0 THEN least(floor({u_sql('o_orderkey', 'rf')} * least(1000, o_orderkey))::BIGINT, o_orderkey - 1) END AS own FROM orders")
def ref_index(spark, d):
    n = table(spark, d, "customer").count()
    df, i = table(spark, d, "orders"), F.col("o_orderkey")
    return df.select("o_orderkey", parent_index(i, n, draws("o_orderkey", "ru")).alias("uni"), parent_index(i, n, draws("o_orderkey", "rs"), "skewed", 1.9).alias("skewed"), parent_index(i, n, draws("o_orderkey", "x"), "sequential").alias("seq"), self_index(i, 1000, draws("o_orderkey", "rf")).alias("own"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def ref_parent_read(spark, d):
    from spindrift.operators.relations import read_parent

    df = read_parent(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey", {"c_name": "c_name", "nk": "c_nationkey"})
    df = read_parent(df, "nk", table(spark, d, "nation"), "n_nationkey", {"n_name": "n_name", "rk": "n_regionkey"})
    return read_parent(df, "rk", table(spark, d, "region"), "r_regionkey", {"r_name": "r_name"}).select("o_orderkey", "c_name", "n_name", "r_name")


# ---------------------------------------------------------------- simulation
def _alloc_sql(weight: str) -> str:
    return f"""WITH s AS (SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS i, (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM events) AS e FROM supplier),
w AS (SELECT *, {weight} AS w FROM s), x AS (SELECT *, w * ((e - n * least(2, e // n)) / sum(w) OVER ()) AS x FROM w),
f AS (SELECT *, floor(x)::BIGINT AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, i) AS rk FROM x), c AS (SELECT *, fl + least(2, e // n) + CASE WHEN rk <= e - n * least(2, e // n) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS count FROM f)
SELECT i, count::BIGINT AS count, (sum(count) OVER (ORDER BY i) - count)::BIGINT AS start FROM c"""


def _alloc(spark, d, how: str) -> DataFrame:
    s, e = table(spark, d, "supplier"), table(spark, d, "events").count()
    n, low = s.count(), s.agg(F.min("s_suppkey")).first()[0]
    return simulation.allocate(s.select((F.col("s_suppkey") - low).alias("i")), "i", n, e, how, 1.7, 2).select("i", F.col("count").cast("long").alias("count"), F.col("start").cast("long").alias("start"))


@query(_alloc_sql("1.0::DOUBLE"))
def alloc_uniform(spark, d):
    return _alloc(spark, d, "uniform")


@query(_alloc_sql("1.0::DOUBLE / (i + 1)"))
def alloc_zipf(spark, d):
    return _alloc(spark, d, "zipf")


@query(_alloc_sql("pow((((i * (SELECT min(m) FROM (SELECT unnest(range(greatest(1, floor(n * 0.6180339887)::BIGINT), n + 2)) AS m) WHERE gcd(m, n) = 1) + n // 3) % n) + 0.5) / n, 1 / 1.7 - 1)"))
def alloc_skewed(spark, d):
    return _alloc(spark, d, "skewed")


@query(SQL["alloc_skewed"].join(["WITH a AS (", ") SELECT avg(count)::DOUBLE AS mean, max(count)::BIGINT AS max, min(count)::BIGINT AS min, ((SELECT sum(count) FROM (SELECT count FROM a ORDER BY count DESC LIMIT (SELECT greatest(1, count(*) // 10) FROM a))) / sum(count))::DOUBLE AS top_decile FROM a"]))
def alloc_skewed_report(spark, d):
    n = table(spark, d, "supplier").count()
    return simulation.allocation_report(_alloc(spark, d, "skewed"), n)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, round(100 + sum(v) OVER (PARTITION BY user_id ORDER BY k), 4) AS total, k AS counter FROM e""")
def state_running(spark, d):
    df = table(spark, d, "events").withColumn("v", F.coalesce("value", F.lit(0.0)))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return df.select("event_id", F.round(simulation.running_total(F.lit(100.0), F.col("v"), "user_id", "k"), 4).alias("total"), F.col("k").alias("counter"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, round(coalesce(value, 0), 0) - 40 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, least(500, greatest(0, 50 + v)) AS s FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, least(500, greatest(0, r.s + e.v)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, s::DOUBLE AS level FROM r""")
def state_clamped(spark, d):
    df = table(spark, d, "events").withColumn("v", F.round(F.coalesce("value", F.lit(0.0)), 0) - 40)
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "v", "k")
    out = simulation.fold(df, "user_id", "k", {"level": {"initial": 50, "update": "level + v", "min": 0, "max": 500}})
    return out.select("event_id", F.col("`state.level`").alias("level"))


@query(SQL["state_clamped"])
def state_clamped_long(spark, d):
    df = table(spark, d, "events").withColumn("v", F.round(F.coalesce("value", F.lit(0.0)), 0) - 40)
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "v", "k")
    return simulation.fold_long(df, "user_id", "k", "level", 50.0, "v", 0.0, 500.0).select("event_id", "level")


_SCEN = f"(('0x' || substr(md5('7|scenario|' || user_id || '|outage|0'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496) < 0.4"  # noqa: F541


@query(f"""WITH e AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 0.5) / count(*) OVER (PARTITION BY user_id) AS q FROM events)
SELECT event_id, CASE WHEN {_SCEN} AND q BETWEEN 0.25 AND 0.75 THEN 'outage' END AS scenario, CASE WHEN {_SCEN} AND q BETWEEN 0.25 AND 0.75 THEN CASE WHEN q BETWEEN 0.25 AND 0.5 THEN 'start' ELSE 'end' END END AS phase FROM e""")
def scenario_overlay(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("q", (F.row_number().over(w.orderBy("ts", "event_id")) - 0.5) / F.count(F.lit(1)).over(w))
    s = [simulation.Scenario("outage", {"affects_fraction": 0.4, "window": [0.25, 0.75], "phases": ["start", "end"]})]
    c = simulation.scenario_columns(s, "e", F.col("user_id"), F.col("q"), 7, PORTABLE)
    return e.select("event_id", c["scenario.name"].alias("scenario"), c["scenario.phase"].alias("phase"))


@query("""WITH b AS (SELECT unnest(range(0, 30 * 24)) AS bucket), w AS (SELECT bucket, CASE WHEN (bucket // 24) % 7 IN (2, 3) THEN 2.0 ELSE 1.0 END AS weight FROM b)
SELECT bucket, weight::DOUBLE AS weight, round(sum(weight) OVER (ORDER BY bucket) / sum(weight) OVER (), 9)::DOUBLE AS cumulative FROM w""")
def timeline_cdf(spark, d):
    # 2026-01-01 is a Thursday: days 2 and 3 of each week are its weekend; a spike holds its last day
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-01-31", "shape": "flat", "spikes": [{"start": f"2026-01-{x:02d}", "end": f"2026-01-{x + 1:02d}", "multiplier": 2} for x in (3, 10, 17, 24)]})
    return t.buckets(spark).select("bucket", "weight", F.round("cumulative", 9).alias("cumulative"))


# the weights of a shape stand in the SQL as the documentation gives them, not as the engine has them
_OFFICE_SQL = "[0.02,0.01,0.01,0.01,0.02,0.05,0.15,0.45,0.95,1.00,1.00,0.95,0.70,0.90,1.00,0.95,0.85,0.55,0.25,0.15,0.10,0.07,0.05,0.03]"
_WEEK_SQL = "[1.0,1.05,1.05,1.0,0.9,0.12,0.08]"


@query(f"""WITH b AS (SELECT i AS bucket, TIMESTAMP '2026-01-01' + to_hours(i) AS t FROM (SELECT unnest(range(0, 90 * 24)) AS i))
SELECT bucket, round(list_extract({_OFFICE_SQL}, hour(t) + 1)::DOUBLE * list_extract({_WEEK_SQL}, isodow(t))::DOUBLE * CASE month(t) WHEN 3 THEN 2.5 ELSE 1.0 END * CASE WHEN t::DATE IN (DATE '2026-01-06', DATE '2026-02-16') THEN 0.0 ELSE 1.0 END * (1 + (2.0 - 1) * bucket / (90 * 24 - 1)), 9)::DOUBLE AS weight FROM b""")
def timeline_growth_holidays(spark, d):
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-04-01", "shape": "office", "growth": 2.0, "months": {"march": 2.5}, "holidays": ["2026-01-06", "2026-02-16"]})
    return t.buckets(spark).select("bucket", F.round("weight", 9).alias("weight"))


@query(f"""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT i, TIMESTAMP '2026-01-01' + to_hours(i) AS t FROM (SELECT unnest(range(0, 364 * 24)) AS i)),
w AS (SELECT i, t, sum(list_extract({_OFFICE_SQL}, hour(t) + 1)::DOUBLE * list_extract({_WEEK_SQL}, isodow(t))::DOUBLE) OVER (ORDER BY i) / sum(list_extract({_OFFICE_SQL}, hour(t) + 1)::DOUBLE * list_extract({_WEEK_SQL}, isodow(t))::DOUBLE) OVER () AS c FROM b),
q AS (SELECT *, (k + {u_sql('event_id', 'at', 'jitter')} * 0.8) / n AS q FROM e)
SELECT event_id, user_id, k, hour_of FROM (SELECT event_id, user_id, k, (SELECT min(t) FROM w WHERE c >= q.q) AS hour_of FROM q)""")
def timeline_ordered(spark, d):
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-12-31", "shape": "office"})
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = t.ordered(F.col("k"), F.col("n"), 0.8, draws("event_id", "at"))
    return e.select("event_id", "user_id", F.col("k").cast("long").alias("k"), F.date_trunc("HOUR", at).cast("timestamp_ntz").alias("hour_of"))


# ---------------------------------------------------------------- damage
def _chaos_sql(kind: str, k: str) -> str:
    return u_sql("c_custkey", f"chaos.{kind}", k)


@query(f"""WITH a AS (SELECT c_custkey, CASE WHEN {_chaos_sql('missing_data', 'hit')} < 0.2 AND floor({_chaos_sql('missing_data', 'field')} * 3) = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN {_chaos_sql('missing_data', 'hit')} < 0.2 AND floor({_chaos_sql('missing_data', 'field')} * 3) = 1 THEN NULL ELSE c_acctbal END AS c_acctbal,
CASE WHEN {_chaos_sql('missing_data', 'hit')} < 0.2 AND floor({_chaos_sql('missing_data', 'field')} * 3) = 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment, {_chaos_sql('duplicates', 'hit')} < 0.1 AS twice FROM customer)
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM a UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM a WHERE twice""")
def chaos_missing_duplicates(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return chaos.damage(df, "e", "c_custkey", 7, {"missing_data": 0.2, "duplicates": 0.1}, mode=PORTABLE).drop("_chaos")


@query(f"SELECT c_custkey, CASE WHEN {_chaos_sql('outliers', 'hit')} < 0.3 THEN CASE WHEN c_acctbal = 0 THEN 1 ELSE c_acctbal END * [1e3, 1e4, -1.0, -1e3, 1e6][1 + floor({_chaos_sql('outliers', 'multiplier')} * 5)::INT] ELSE c_acctbal END AS c_acctbal FROM customer")
def chaos_outliers(spark, d):
    return chaos.damage(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "e", "c_custkey", 7, {"outliers": 0.3}, mode=PORTABLE).drop("_chaos")


@query(f"SELECT c_custkey, CASE WHEN {_chaos_sql('referential_anomalies', 'hit')} < 0.3 THEN c_mktsegment || '-ORPHAN' || lpad(floor({_chaos_sql('referential_anomalies', 'orphan')} * 1000)::BIGINT::VARCHAR, 3, '0') ELSE c_mktsegment END AS c_mktsegment FROM customer")
def chaos_orphans(spark, d):
    return chaos.damage(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "e", "c_custkey", 7, {"referential_anomalies": 0.3}, mode=PORTABLE).drop("_chaos")


_U = lambda k, kind: _chaos_sql(kind, k)
_AT = f"floor({_U('at', 'malformed_text')} * greatest(length(x), 1))::INT"
_SWAP = f"greatest(least({_AT}, length(x) - 2), 0)"
_BLANKS = f"repeat(' ', floor({_U('blanks', 'malformed_text')} * 3)::INT + 1)"
_TWICE = f"substr(x, 1, {_AT} + 1) || substr(x, {_AT} + 1)"


@query(f"""SELECT c_custkey, CASE WHEN {_U('hit', 'malformed_text')} < 0.7 THEN CASE floor({_U('defect', 'malformed_text')} * 10)::INT
 WHEN 0 THEN regexp_replace(x, '^([^ ]*) ', '\\1  ') WHEN 1 THEN x || {_BLANKS} WHEN 2 THEN {_BLANKS} || x WHEN 3 THEN upper(x) WHEN 4 THEN lower(x)
 WHEN 5 THEN CASE WHEN length(x) > 1 THEN substr(x, 1, {_SWAP}) || substr(x, {_SWAP} + 2, 1) || substr(x, {_SWAP} + 1, 1) || substr(x, {_SWAP} + 3) ELSE {_TWICE} END
 WHEN 6 THEN substr(x, 1, {_AT}) || substr(x, {_AT} + 2) WHEN 7 THEN {_TWICE}
 WHEN 8 THEN CASE WHEN length(x) > 3 THEN substr(x, 1, greatest(length(x) - (floor({_U('cut', 'malformed_text')} * greatest(length(x) // 3, 1))::INT + 1), 1)) ELSE {_TWICE} END
 ELSE regexp_replace(x, '^([^ ]*) ', '\\1' || chr(9)) END ELSE x END AS x FROM (SELECT c_custkey, c_mktsegment || ' ' || c_name AS x FROM customer)""")
def chaos_malformed(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("x"))
    return chaos.damage(df, "e", "c_custkey", 7, {"malformed_text": 0.7}, mode=PORTABLE).drop("_chaos")


_PUT = f"floor({_U('at', 'unexpected_unicode')} * (length(c_name) + 1))::INT"


@query(f"""SELECT c_custkey, CASE WHEN {_U('hit', 'unexpected_unicode')} < 0.7 THEN substr(c_name, 1, {_PUT}) || chr([8203, 8207, 769, 65279, 233, 128578, 223, 160][1 + floor({_U('gremlin', 'unexpected_unicode')} * 8)::INT]) || substr(c_name, {_PUT} + 1) ELSE c_name END AS c_name FROM customer""")
def chaos_unicode(spark, d):
    return chaos.damage(table(spark, d, "customer").select("c_custkey", "c_name"), "e", "c_custkey", 7, {"unexpected_unicode": 0.7}, mode=PORTABLE).drop("_chaos")


_WHICH, _DAYS = u_sql("o_orderkey", "chaos.temporal_anomalies", "which"), u_sql("o_orderkey", "chaos.temporal_anomalies", "days")


@query(f"""SELECT o_orderkey, CASE WHEN {u_sql('o_orderkey', 'chaos.temporal_anomalies', 'hit')} >= 0.6 THEN strftime(x, '%Y-%m-%d')
 WHEN {_WHICH} < 0.4 THEN strftime((x + to_days(400 + floor({_DAYS} * 3601)::INT))::DATE, '%Y-%m-%d') WHEN {_WHICH} < 0.7 THEN strftime((x - to_days(4000 + floor({_DAYS} * 36001)::INT))::DATE, '%Y-%m-%d')
 ELSE CASE floor({u_sql('o_orderkey', 'chaos.temporal_anomalies', 'notation')} * 5)::INT WHEN 0 THEN strftime(x, '%d/%m/%Y') WHEN 1 THEN strftime(x, '%m-%d-%Y') WHEN 2 THEN strftime(x, '%Y%m%d') WHEN 3 THEN strftime(x, '%d %b %Y') ELSE strftime(x, '%a %b %d %H:%M:%S %Y') END END AS x FROM (SELECT o_orderkey, o_orderdate::DATE AS x FROM orders)""")
def chaos_temporal(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("x"))
    return chaos.damage(df, "e", "o_orderkey", 7, {"temporal_anomalies": 0.6}, mode=PORTABLE, as_text=True).drop("_chaos")


@query("""SELECT * FROM (VALUES ('realistic', 'outliers', 0.005), ('realistic', 'missing_data', 0.02), ('realistic', 'duplicates', 0.001), ('realistic', 'malformed_text', 0.004), ('realistic', 'unexpected_unicode', 0.001), ('realistic', 'temporal_anomalies', 0.0005), ('realistic', 'referential_anomalies', 0.0),
 ('messy', 'outliers', 0.02), ('messy', 'missing_data', 0.06), ('messy', 'duplicates', 0.01), ('messy', 'malformed_text', 0.03), ('messy', 'unexpected_unicode', 0.01), ('messy', 'temporal_anomalies', 0.005), ('messy', 'referential_anomalies', 0.002),
 ('hostile_qa', 'outliers', 0.05), ('hostile_qa', 'missing_data', 0.1), ('hostile_qa', 'duplicates', 0.02), ('hostile_qa', 'malformed_text', 0.08), ('hostile_qa', 'unexpected_unicode', 0.05), ('hostile_qa', 'temporal_anomalies', 0.02), ('hostile_qa', 'referential_anomalies', 0.01),
 ('absolute', 'outliers', 0.15), ('absolute', 'missing_data', 0.2), ('absolute', 'duplicates', 0.05), ('absolute', 'malformed_text', 0.2), ('absolute', 'unexpected_unicode', 0.15), ('absolute', 'temporal_anomalies', 0.08), ('absolute', 'referential_anomalies', 0.05)) t(preset, kind, rate)""".replace("SELECT *", "SELECT preset, kind, rate::DOUBLE AS rate"))
def chaos_presets(spark, d):
    rows = [(p, k, r) for p in ("realistic", "messy", "hostile_qa", "absolute") for k, r in chaos.rates(p).items()]
    return spark.createDataFrame(rows, "preset string, kind string, rate double")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderkey % 100 / 100.0 AS q FROM orders)
SELECT o_orderkey, CASE WHEN q BETWEEN 0.2 AND 0.6 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN q BETWEEN 0.2 AND 0.4 THEN 'X' WHEN q BETWEEN 0.2 AND 0.6 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus FROM s""")
def scenario_effects(spark, d):
    s = [simulation.Scenario("sale", {"window": [0.2, 0.6], "effects": {"o_totalprice": "=round(o_totalprice * 2, 2)", "o_orderstatus": "Y"}, "phases": {"first": {"window": [0.2, 0.4], "effects": {"o_orderstatus": "X"}}}})]
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    c = simulation.scenario_columns(s, "e", F.col("o_orderkey"), F.col("o_orderkey") % 100 / F.lit(100.0), 7, PORTABLE)
    df = df.withColumns({"_s": c["scenario.name"], "_p": c["scenario.phase"]})
    return simulation.overlay(df, s, "e", "_s", "_p", lambda label: draws("o_orderkey", label)).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[^0-9-]+'), lambda s: regexp_full_match(s, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND s[1:3] NOT IN ('000', '666') AND s[1:1] <> '9' AND s[5:6] <> '00' AND s[8:11] <> '0000')) > 0 AS ssn FROM documents""")
def privacy_ssn(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(validation.issuable_ssn(F.col("text")), F.lit(False)).alias("ssn"))


@query()
def chaos_all(spark, d):
    df = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return chaos.damage_report(chaos.damage(df, "e", "o_orderkey", 7, "absolute", mode=PORTABLE))


@query(f"SELECT c_custkey, {u_sql('c_custkey', 'edges', 'hit')} < 0.2 AS hit, floor({u_sql('c_custkey', 'edges', 'field')} * 2)::INT AS field, floor({u_sql('c_custkey', 'edges', 'case')} * [5, 3][1 + floor({u_sql('c_custkey', 'edges', 'field')} * 2)::INT])::INT AS c FROM customer")
def edge_plan(spark, d):
    hit, at, case = chaos.edge_plan("e", F.col("c_custkey"), 7, 0.2, {"a": 5, "b": 3}, PORTABLE)
    return table(spark, d, "customer").select("c_custkey", hit.alias("hit"), at.alias("field"), case.alias("c"))


# ---------------------------------------------------------------- validation
@query("SELECT count(*) AS checked, count(*) FILTER (c_custkey IS NULL) AS broken, ((count(*) - count(*) FILTER (c_custkey IS NULL)) / count(*))::DOUBLE AS integrity FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL")
def val_integrity(spark, d):
    return validation.integrity(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def val_orphans(spark, d):
    return validation.orphans(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity > 45 AS c_max, l_quantity < 3 AS c_min, NOT regexp_matches(l_returnflag, '[AN]') AS c_pattern, l_linestatus NOT IN ('O') AS c_enum, l_linenumber IN (7) AS c_forbidden, abs(l_quantity % 5) > 1e-9 AS c_multiple, length(l_returnflag) < 2 AS c_length FROM lineitem""")
def val_constraints(spark, d):
    df = table(spark, d, "lineitem")
    q, one = validation.constraints, lambda cs: cs[0].fails
    return df.select(
        "l_orderkey", "l_linenumber", one(q(F.col("l_quantity"), "q", {"max": 45})).alias("c_max"), one(q(F.col("l_quantity"), "q", {"min": 3})).alias("c_min"), one(q(F.col("l_returnflag"), "r", {"pattern": "[AN]"}, True)).alias("c_pattern"),
        one(q(F.col("l_linestatus"), "s", {"enum": ["O"]}, True)).alias("c_enum"), one(q(F.col("l_linenumber"), "n", {"forbidden": [7]})).alias("c_forbidden"), one(q(F.col("l_quantity"), "q", {"multiple_of": 5})).alias("c_multiple"), one(q(F.col("l_returnflag"), "r", {"min_length": 2}, True)).alias("c_length"),
    )


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 1")
def val_unique(spark, d):
    return validation.with_repeats(table(spark, d, "documents"), [F.sha2("text", 256)], "doc_id", "r").where("r").select("doc_id")


@query("""WITH o AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT * FROM (VALUES ('1-URGENT', 0.3), ('2-HIGH', 0.2), ('3-MEDIUM', 0.2), ('4-NOT SPECIFIED', 0.2), ('5-LOW', 0.1)) t(value, want)),
b AS (SELECT value, coalesce(n, 0) / (SELECT count(*) FROM orders) AS seen, coalesce(want, 0) AS want FROM o FULL JOIN e USING (value))
SELECT (SELECT count(*) FROM orders) AS samples, round(sum(abs(seen - want)) / 2, 6)::DOUBLE AS distance, (SELECT count(*) FROM orders) >= 150 AS confident, sum(abs(seen - want)) / 2 <= 0.08 AS within FROM b""")
def val_distribution(spark, d):
    want = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 2, "4-NOT SPECIFIED": 2, "5-LOW": 1}
    return validation.distribution(table(spark, d, "orders"), "o_orderpriority", want).select("samples", F.round("distance", 6).alias("distance"), "confident", "within")


_TYPED = "CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+(\\.0*)?') THEN split_part(trim(v), '.', 1)::BIGINT END"


@query(f"SELECT event_id, {_TYPED} AS whole, try_cast(v AS DOUBLE) AS number, {_TYPED} IS NOT NULL AS ok FROM (SELECT event_id, round(value, 0)::BIGINT::VARCHAR || CASE WHEN event_id % 3 = 0 THEN '.0' WHEN event_id % 3 = 1 THEN '.5' ELSE '' END AS v FROM events)")
def val_structural(spark, d):
    from spindrift.functions import types as ty

    tail = F.when(F.col("event_id") % 3 == 0, ".0").when(F.col("event_id") % 3 == 1, ".5").otherwise("")
    df = table(spark, d, "events").select("event_id", F.concat(F.round("value", 0).cast("long").cast("string"), tail).alias("v"))
    whole, checks = validation.structural(F.col("v"), "v", "integer", False)
    failed = [F.coalesce(c.fails, F.lit(False)) for c in checks if c.severity == "error"]
    return df.select("event_id", ty.coerce(whole, "integer").alias("whole"), ty.coerce(F.col("v"), "float").alias("number"), (~(failed[0] | failed[1])).alias("ok"))


@query("SELECT count(*) AS records, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS n_logical FROM (SELECT coalesce(NOT (o_totalprice > 1000), true) OR coalesce(NOT (o_orderstatus = 'F' OR o_totalprice < 300000), true) AS bad FROM orders)")
def val_assert(spark, d):
    df = table(spark, d, "orders")
    checks = validation.assertions(df, ["o_totalprice > 1000", "o_orderstatus == 'F' or o_totalprice < 300000"])
    return validation.statistics(df.withColumn("_issues", validation.issues(checks)), "_issues").select("records", "valid", "n_logical")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O')")
def val_policy_skip(spark, d):
    df = table(spark, d, "orders")
    checks = validation.constraints(F.col("o_totalprice"), "o_totalprice", {"min": 1000}) + validation.constraints(F.col("o_orderstatus"), "o_orderstatus", {"enum": ["F", "O"]}, True)
    return validation.enforce(df.withColumn("_issues", validation.issues(checks)), "_issues", "skip").select("o_orderkey")


@query("""SELECT doc_id,
 len(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1), lambda x: lower(x)), lambda x: NOT regexp_matches(x, '(^|\\.)example\\.(com|org|net|edu)$|\\.(test|example|invalid|localhost|local)$'))) > 0 AS domain FROM documents""")
def privacy_domain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(validation.open_domains(F.col("text")), F.lit(False)).alias("domain"))


@query()
def privacy_all(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", *[F.coalesce(f(F.col("text")), F.lit(False)).alias(n) for n, f in validation.PRIVACY.items()])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 97 = 0")
def sample_every(spark, d):
    return validation.systematic_sample(table(spark, d, "lineitem"), "l_orderkey", 97).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS records, count(*) FILTER (ok) AS valid, (count(*) FILTER (ok) / count(*))::DOUBLE AS validity, sum(c)::BIGINT AS n_constraint FROM (SELECT l_quantity <= 40 AND l_discount <= 0.08 AS ok, CASE WHEN l_quantity > 40 OR l_discount > 0.08 THEN 1 ELSE 0 END AS c FROM lineitem)")
def quality_report(spark, d):
    df = table(spark, d, "lineitem")
    checks = validation.constraints(F.col("l_quantity"), "l_quantity", {"max": 40}) + validation.constraints(F.col("l_discount"), "l_discount", {"max": 0.08})
    return validation.statistics(df.withColumn("_issues", validation.issues(checks)), "_issues").select("records", "valid", "validity", "n_constraint")


# ---------------------------------------------------------------- duplicates
@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 1")
def dup_exact(spark, d):
    return duplicates.exact(table(spark, d, "documents"), "text", "doc_id", "x").where("x").select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 1""")
def dup_normalized(spark, d):
    return duplicates.normalized(table(spark, d, "documents"), "text", "doc_id", "x").where("x").select("doc_id")


@query()
def dup_minhash(spark, d):
    return duplicates.near_pairs(table(spark, d, "documents"), "doc_id", "text")


@query()
def dup_fuzzy(spark, d):
    return duplicates.fuzzy_pairs(table(spark, d, "documents"), "doc_id", "text", 0.9)


@query()
def dup_report(spark, d):
    return duplicates.report(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT n_name, array_sort(list(DISTINCT s)) AS shingles FROM (SELECT n_name, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM (SELECT n_name, string_split(lower(n_name || ' one ' || n_nationkey || ' two'), ' ') AS w FROM nation)) GROUP BY n_name")
def dup_shingles(spark, d):
    x = F.concat(F.col("n_name"), F.lit(" one "), F.col("n_nationkey").cast("string"), F.lit(" two"))
    named = table(spark, d, "nation").select("n_name", tx.comparable(x).alias("t"))
    return named.select("n_name", F.array_sort(duplicates.shingles(F.col("t"))).alias("shingles"))


# ---------------------------------------------------------------- sets, partitions, streams, projects
@query("SELECT o_orderkey, o_totalprice FROM orders")
def shard_union(spark, d):
    df = table(spark, d, "orders")
    n = df.agg(F.max("o_orderkey")).first()[0] + 1
    cuts = [n * i // 4 for i in range(5)]
    parts = [df.where(F.col("o_orderkey").between(a, b - 1)) for a, b in zip(cuts, cuts[1:])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("o_orderkey", "o_totalprice")


@query("SELECT event_id, coalesce(regexp_replace(event_type || ' ' || user_id, '[^A-Za-z0-9._=-]', '_', 'g'), '__null__') AS part FROM events")
def partition_values(spark, d):
    return table(spark, d, "events").select("event_id", partition_value(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("part"))


_M, _O = simulation._permutation(50)


@query(f"""SELECT event_id, floor({u_sql('event_id', 'uniform')} * 50)::BIGINT AS uniform, greatest(0, least(floor(exp({u_sql('event_id', 'zipf')} * (ln(50) + 0.5772156649 + 0.01) - 0.5772156649) + 0.5)::BIGINT - 1, 49)) AS zipf,
(((least(floor(pow({u_sql('event_id', 'skewed')}, 1.7::DOUBLE) * 50)::BIGINT, 49) - {_O}) * {pow(_M, -1, 50)}) % 50 + 50) % 50 AS skewed FROM events""")
def stream_subjects(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", *[simulation.stream_subject(F.col("event_id"), 50, draws("event_id", h), h, 1.7).alias(h) for h in ("uniform", "zipf", "skewed")])


PROJECT = {
    "project": {"name": "shop", "seed": 11},
    "timeline": {"start": "2026-01-01", "end": "2026-12-31", "shape": "retail"},
    "entities": {
        "company": {"count": 20, "fields": {"company_id": {"type": "integer", "generator": "sequence", "primary_key": True}, "domain": {"type": "string", "generator": {"type": "pattern", "pattern": "{a-z:6}.example.com"}}}},
        "employee": {"count": 500, "fields": {
            "employee_id": {"type": "integer", "generator": {"type": "sequence", "start": 1000}, "primary_key": True}, "company": {"generator": {"type": "reference", "entity": "company"}}, "first_name": {"type": "string"},
            "email": {"type": "email", "generator": {"type": "template", "template": "{first_name|lower}@{company.domain}"}}, "age": {"type": "integer", "generator": {"type": "distribution", "distribution": "normal", "mean": 40, "stddev": 8}, "min": 21, "max": 65}}},
        "login": {"count": 5000, "simulation": {"subject": "employee", "distribution": "skewed", "skew": 1.8, "minimum": 1}, "fields": {
            "login_id": {"type": "integer", "generator": "sequence"}, "employee": {"generator": "subject"}, "mail": {"generator": {"type": "expression", "expression": "employee.email"}}, "at": {"type": "datetime", "generator": "event_time"},
            "result": {"type": "enum", "generator": {"type": "weighted", "values": {"success": 95, "failure": 5}}}, "incident": {"generator": "scenario"}}},
    },
    "scenarios": {"attack": {"applies_to": "login", "affects_fraction": 0.2, "parameters": {"window": [0.4, 0.6], "effects": {"result": {"failure": 9, "success": 1}}}}},
    "chaos": {"preset": "realistic"},
}


def project(spark: SparkSession):
    from spindrift.plans.compiler import Project

    return Project(PROJECT, spark)


@query()
def semantic_judge(spark, d):
    """A judge of every 97th record, of 25 at most."""
    from spindrift.operators.enrichment import judge

    return judge(table(spark, d, "documents"), "doc_id", "text", lambda texts: [len(t or "") > 100 for t in texts])


@query()
def schema_lint(spark, d):
    from spindrift.plans.lint import lint

    return spark.createDataFrame([tuple(f) for f in lint(project(spark))], "rule string, place string, severity string, message string")


@query()
def project_login(spark, d):
    return project(spark).records("login").drop("_chaos")


@query()
def project_quality(spark, d):
    return project(spark).quality("employee")


@query()
def project_lookup(spark, d):
    return project(spark).frame("employee", 100, 10)
