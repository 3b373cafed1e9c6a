"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every distinct text is a blob named by its SHA-256. A ledger in the shared folder
remembers which (blob, rule@version) pairs were scanned and what they held, so a run
scans only pairs it has not seen and joins the findings back to every path.

Defined results: null text is the empty blob and has no spans; repeated rows and equal
texts share one blob and each row gets its findings; a null key is a key like another;
an empty table gives an empty result; extra columns are never touched (keep_columns);
a text of n spans costs about n * sqrt(n) steps, at any length that a string can have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.arrays import blocks, let

from .common import Scratch

#: Marks around matches while offsets are taken; neither is in any rule's classes.
_MARK, _STAND_IN = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """A pattern of java.util.regex; matches whose `group` is shorter than `least` are dropped after matching."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then those the ledger's second rule set adds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 2, 8),
    # a run of 16 or more is matched whole; a shorter one holds no other match that is long enough
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points, end exclusive: matches are put between marks and
    the text is split there, so odd pieces are matches and lengths add up to offsets."""
    none = F.array().cast(_SPAN)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        long = F.lit(True)
        if rule.least > 1:
            long = F.length(F.regexp_extract(piece, f"^{rule.pattern}$", rule.group)) >= rule.least
        span = F.array(F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        out = F.when(acc["hit"] & long, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), out.alias("out"))

    def of_block(x: Column) -> Column:
        return F.aggregate(x["pieces"], F.struct(x["at"].alias("at"), F.lit(False).alias("hit"), none.alias("out")), step, lambda acc: acc["out"])

    def of_runs(runs: Column) -> Column:
        length = F.transform(runs, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x)))
        placed = let(length, lambda n: F.transform(runs, lambda b, i: F.struct(F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x).alias("at"), b.alias("pieces"))))
        return F.flatten(F.transform(placed, of_block))

    pieces = F.split(F.regexp_replace(text, rule.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return let(pieces, lambda p: F.when(F.size(p) < 2, none).otherwise(let(blocks(p), of_runs)))


class Ledger:
    """One row for each scan of a blob: its rules and the spans they found."""

    SCHEMA = f"blob string, rules array<string>, spans {_SPAN}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select("blob", "rules", "spans").write.mode("append").parquet(self.path)


def with_blob(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.sha2(body, 256).alias("blob"), body.alias("body"))


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> None:
    """Scans what the ledger lacks. Equal texts are scanned once, at the row of the smallest
    key: the choice is a narrow, map-side combined aggregate, and the text is joined by that
    key, which no group of copies makes hot."""
    rows = with_blob(docs, key, text)
    want = F.array(*[F.lit(r.name) for r in rules])
    one = rows.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger.exists():
        seen = ledger.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        one = one.join(seen, "blob", "left").withColumn("todo", F.array_except(want, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
    else:
        one = one.withColumn("todo", want)
    left, right = rows.alias("l"), one.alias("r")
    todo = left.join(right, F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.blob") == F.col("r.blob")), "inner").select("l.blob", "l.body", "r.todo")
    body = F.translate("body", _MARK, _STAND_IN)
    none = F.array().cast(_SPAN)
    found = [F.when(F.array_contains("todo", r.name), rule_spans(body, r, k)).otherwise(none) for k, r in enumerate(rules)]
    ledger.append(todo.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*found)).alias("spans")).dropDuplicates(["blob"]))


def findings(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of blobs that have any, by the rules' present versions."""
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    now = ledger.read().where(F.size("spans") > 0)
    kinds = F.array(*[F.lit(r.name) for r in rules])
    # a row's spans count for those of its rules that are still current
    current = F.filter("spans", lambda s: F.exists(F.array_intersect("rules", kinds), lambda r: F.substring_index(r, "@", 1) == s["kind"]))
    ranked = F.transform(current, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    each = now.select("blob", ranked.alias("spans"))
    return each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans) for every row of docs; spans sorted by start, then rule."""
    ledger = ledger or Ledger(docs.sparkSession, Scratch(docs.sparkSession, "ledger").path)
    update(docs, ledger, rules, key, text)
    paths = with_blob(docs, key, text).select("key", "blob")
    return paths.join(findings(ledger, rules), "blob", "left").select("key", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("key").alias(key), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, key: str = "doc_id", text: str = "text", instead: str = "[REDACTED]") -> DataFrame:
    """docs with each union of overlapping spans replaced; rows, columns and null texts stay.
    A text without spans is returned as it is."""
    ledger = ledger or Ledger(docs.sparkSession, Scratch(docs.sparkSession, "ledger").path)
    update(docs, ledger, rules, key, text)
    name = "__spans"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    blob = f"{name}_blob"
    found = findings(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(name))
    rows = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(found, blob, "left")
    pair = "array<struct<s:int,e:int>>"

    def union(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["end"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["e"]), merged).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e")))))

    def append(acc: Column, more: Column) -> Column:
        """Runs of the next block after those of the blocks before; both are apart, in order."""
        last = F.try_element_at(acc, F.lit(-1))
        inside = F.filter(more, lambda x: x["s"] <= last["e"])
        tail = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], F.array_max(F.transform(inside, lambda x: x["e"]))).alias("e")))
        return F.when(F.size(acc) == 0, more).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), tail, F.filter(more, lambda x: x["s"] > last["e"])))

    none = F.array().cast(pair)
    runs = F.when(F.size(name) > 0, F.aggregate(F.transform(blocks(F.col(name)), lambda b: F.aggregate(b, none, union)), none, append)).otherwise(none)
    rows = rows.withColumn(f"{name}_runs", runs)
    r = F.col(f"{name}_runs")
    starts = F.concat(F.transform(r, lambda x: x["s"]), F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["e"]))
    gaps = F.arrays_zip(ends.alias("a"), starts.alias("b"))
    # offsets are counted from the front of a string, so gaps are cut from the piece of their block
    cut = lambda b: F.struct(b[0]["a"].alias("from"), b.alias("gaps"), F.substring(F.col(text), b[0]["a"] + 1, F.element_at(b, -1)["b"] - b[0]["a"]).alias("part"))
    parts = F.transform(blocks(gaps), cut)
    kept = F.array_join(F.flatten(F.transform(parts, lambda p: F.transform(p["gaps"], lambda g: F.substring(p["part"], g["a"] - p["from"] + 1, g["b"] - g["a"])))), instead)
    return rows.withColumn(text, F.when(F.col(name).isNotNull() & F.col(text).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)
