"""Simulated histories: events allocated to subjects, placed on a timeline, folded into
state and overlaid by scenarios. Events are made from their subjects, so no range join
and no sort is needed: index order is (subject, ordinal) order is time order."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.arrays import blocks, let
from spindrift.functions.expressions import Translator, Value, columns_of, kind_of
from spindrift.functions.hashing import Draws


# ---------------------------------------------------------------- allocation
def _permutation(n: int) -> tuple[int, int]:
    """A multiplier coprime with n, and an offset: ranks scattered over subjects."""
    m = max(1, int(n * 0.6180339887))
    while math.gcd(m, n) != 1:
        m += 1
    return m, n // 3


def weight(index: Column, n: int, how: str, skew: float = 1.5) -> Column:
    if how == "uniform":
        return F.lit(1.0)
    if how == "zipf":
        return 1.0 / (index + 1)
    if how == "skewed":
        m, o = _permutation(n)
        rank = (index * m + o) % n
        return F.pow((rank + 0.5) / n, F.lit(1 / skew - 1))
    raise ValueError(f"unknown allocation {how!r}")


def allocate(subjects: DataFrame, index: str, n: int, events: int, how: str = "uniform", skew: float = 1.5, minimum: int = 0) -> DataFrame:
    """subjects with `count` (largest remainder above a floor) and `start`, the first event's index.

    Floors and prefix sums are taken by range of the index with one small row for each
    range, so no window gathers all subjects in a task."""
    floor_each = min(minimum, events // n) if n else 0
    rest = events - floor_each * n
    w = subjects.withColumn("__w", weight(F.col(index), n, how, skew))
    total = w.agg(F.sum("__w")).first()[0] or 1.0
    x = w.withColumn("__x", F.col("__w") * F.lit(rest / total)).withColumn("__floor", F.floor("__x").cast("long")).withColumn("__frac", F.col("__x") - F.floor("__x"))
    left = rest - (x.agg(F.sum("__floor")).first()[0] or 0)
    counted = _leftovers(x, index, int(left)).withColumn("count", F.col("__floor") + floor_each + F.col("__one"))
    return prefix_sum(counted.drop("__w", "__x", "__floor", "__frac", "__one"), index, "count", "start", n)


#: Bins of a histogram that the driver gets, and rows among which a cut is made by sorting.
_BINS, _FEW = 1000, 10_000


def _narrowed(x: DataFrame, value: Column, lo: int, hi: int, want: int) -> tuple[int, int, int, int]:
    """The part [lo, hi) of a long's range that holds the want-th largest row: (lo, hi, rows above it, rows in it)."""
    above, inside = 0, 1 << 62
    while inside > _FEW and hi - lo > 1:
        step = -(-(hi - lo) // _BINS)
        bins = x.where((value >= lo) & (value < hi)).select((value - lo).alias("v")).groupBy(F.expr(f"v div {step}").alias("b")).count().collect()
        for r in sorted(bins, key=lambda r: -r.b):
            if above + r["count"] >= want:
                lo, hi, inside = lo + r.b * step, min(hi, lo + (r.b + 1) * step), r["count"]
                break
            above += r["count"]
    return lo, hi, above, inside


def _leftovers(x: DataFrame, index: str, left: int) -> DataFrame:
    """One more for the `left` rows with the largest fractions, the smaller index first among equals.

    The last of them is found by bounded histograms, of fractions and then, among equal
    fractions, of indexes, so neither ties nor their number put many rows in a task."""
    if left <= 0:
        return x.withColumn("__one", F.lit(0))
    i, key = F.col(index).cast("long"), F.floor(F.col("__frac") * F.lit(2.0**60)).cast("long")
    lo, hi, above, inside = _narrowed(x, key, 0, 1 << 60, left)
    part = x.where((key >= lo) & (key < hi))
    if inside > _FEW:  # equal fractions
        ends = part.agg(F.min(i).alias("a"), F.max(i).alias("b")).first()
        low, high, before, _ = _narrowed(part, -i, -ends.b, 1 - ends.a, left - above)
        part, above = part.where((-i >= low) & (-i < high)), above + before
    last = part.select(key.alias("f"), i.alias("i")).orderBy(F.desc("f"), "i").limit(left - above).orderBy("f", F.desc("i")).first()
    return x.withColumn("__one", F.when((key > last.f) | ((key == last.f) & (i <= last.i)), 1).otherwise(0))


def prefix_sum(df: DataFrame, index: str, value: str, name: str, n: int, width: int = 65_536) -> DataFrame:
    """The exclusive running sum of value in the order of a dense index, block by block."""
    blocked = df.withColumn("__b", F.floor(F.col(index) / width))
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy(index).rowsBetween(Window.unboundedPreceding, -1))
    sums = blocked.groupBy("__b").agg(F.sum(value).alias("__s"))  # one row for every `width` subjects
    before = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))
    return blocked.join(before, "__b").withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("__before")).drop("__b", "__before")


#: Events that one row of a subject is opened to.
EVENTS_OF_ROW = 10_000


def events_of(allocated: DataFrame, subject: str, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(index, subject, ordinal, total) of the events lo to hi, exploded from their subjects.

    A subject is first cut into pieces of EVENTS_OF_ROW, dealt by subject and piece, so a head
    of the distribution is spread; subjects outside the range are never opened."""
    first, behind = F.greatest(F.lit(lo) - F.col("start"), F.lit(0)), F.col("count") if hi is None else F.least(F.lit(hi) - F.col("start"), F.col("count"))
    some = allocated.select(F.col(subject).alias("subject"), F.col("count").alias("total"), "start", first.cast("long").alias("a"), behind.cast("long").alias("b")).where("b > a")
    pieces = some.withColumn("piece", F.explode(F.sequence(F.expr(f"a div {EVENTS_OF_ROW}"), F.expr(f"(b - 1) div {EVENTS_OF_ROW}")))).repartition("subject", "piece")
    within = F.sequence(F.greatest("a", F.col("piece") * EVENTS_OF_ROW), F.least("b", (F.col("piece") + 1) * EVENTS_OF_ROW) - 1)
    return pieces.select("start", "subject", "total", F.explode(within).alias("ordinal")).select((F.col("start") + F.col("ordinal")).alias("index"), "subject", "ordinal", "total")


def quantile(ordinal: Column, total: Column) -> Column:
    return (ordinal + 0.5) / total


def allocation_report(allocated: DataFrame, n: int) -> DataFrame:
    """(mean, max, min, share of the top tenth). The tenth's least count is found by histograms, not by sorting it."""
    top, c = max(1, n // 10), F.col("count").cast("long")
    least, most = allocated.agg(F.min(c), F.max(c)).first()
    if least is None:
        return allocated.agg(F.avg("count").alias("mean"), F.max("count").alias("max"), F.min("count").alias("min"), F.lit(None).cast("double").alias("top_decile"))
    lo, hi, above, _ = _narrowed(allocated, c, least, most + 1, min(top, n))
    part = allocated.where((c >= lo) & (c < hi)).select(c.alias("c"))
    rest = (top - above) * lo if hi - lo <= 1 else part.orderBy(F.desc("c")).limit(top - above).agg(F.sum("c")).first()[0]
    best = F.coalesce(F.sum(F.when(c >= hi, c)), F.lit(0)) + F.lit(rest)
    return allocated.agg(F.avg("count").alias("mean"), F.max("count").alias("max"), F.min("count").alias("min"), (best / F.sum("count")).alias("top_decile"))


def stream_subject(index: Column, n: int, draws: Draws, how: str, skew: float) -> Column:
    """A subject for each event of a stream, with the same shares: the inverse of the shares' running sum."""
    if how == "uniform":
        return draws.below(n)
    if how == "skewed":  # the integral of r ** (1/skew - 1) is r ** (1/skew)
        m, o = _permutation(n)
        rank = F.least(F.floor(F.pow(draws.u(), F.lit(float(skew))) * n).cast("long"), F.lit(n - 1))
        return F.pmod((rank - o) * pow(m, -1, n) if n > 1 else F.lit(0), F.lit(n))
    if how != "zipf":
        raise ValueError(f"unknown allocation {how!r}")
    h = math.log(n) + 0.5772156649 + 1 / (2 * n)
    return F.greatest(F.lit(0), F.least(F.floor(F.exp(draws.u() * h - 0.5772156649) + 0.5).cast("long") - 1, F.lit(n - 1)))


# ---------------------------------------------------------------- timeline
# Relative weights of weekdays (Monday first) and of hours (midnight first).
FLAT_WEEK, FLAT_DAY = [1.0] * 7, [1.0] * 24
BUSINESS_WEEK = [1.0, 1.05, 1.05, 1.0, 0.9, 0.12, 0.08]
RETAIL_WEEK = [0.82, 0.8, 0.84, 0.9, 1.05, 1.25, 1.15]
OFFICE_DAY = [0.02, 0.01, 0.01, 0.01, 0.02, 0.05, 0.15, 0.45, 0.95, 1.0, 1.0, 0.95, 0.7, 0.9, 1.0, 0.95, 0.85, 0.55, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03]
EVENING_DAY = [0.15, 0.08, 0.05, 0.04, 0.04, 0.06, 0.12, 0.25, 0.4, 0.5, 0.55, 0.6, 0.65, 0.6, 0.58, 0.6, 0.7, 0.85, 1.0, 1.0, 0.95, 0.8, 0.55, 0.3]
#: (hours, weekdays) by shape.
SHAPES: dict[str, tuple[list[float], list[float]]] = {
    "flat": (FLAT_DAY, FLAT_WEEK),
    "business_hours": (OFFICE_DAY, BUSINESS_WEEK),
    "office": (OFFICE_DAY, BUSINESS_WEEK),
    "retail": (EVENING_DAY, RETAIL_WEEK),
    "evening": (EVENING_DAY, FLAT_WEEK),
    "always_on": (FLAT_DAY, FLAT_WEEK),
}
#: Up to so many hours a timeline is hourly, beyond it daily.
MOST_HOURS = 24 * 366 * 3
MONTHS = "january february march april may june july august september october november december".split()


class Timeline:
    """Hourly buckets (daily beyond three years) with weights, and the inverse of their running sum.

    A bucket weighs its hour and weekday by shape, times its month, its holiday's weight, the
    trend (`growth` is the last bucket's factor against the first) and every spike that
    holds its day, the spike's last day included. A daily bucket is its 24 hours' sum."""

    def __init__(self, spec: dict[str, Any]):
        self.start = _time(spec.get("start", "2026-01-01"))
        self.end = _time(spec["end"]) if spec.get("end") else self.start + dt.timedelta(days=365)
        if self.end <= self.start:
            raise ValueError("a timeline must end after it starts")
        self.shape = str(spec.get("shape") or "flat").lower()
        if self.shape not in SHAPES:
            raise ValueError(f"unknown shape {self.shape!r}; known: {', '.join(SHAPES)}")
        self.seconds = (self.end - self.start).total_seconds()
        hourly = (int(self.seconds // 3600) or 1) <= MOST_HOURS
        self.bucket = 3600.0 if hourly else 86400.0
        n = max(1, math.ceil(self.seconds / self.bucket))
        at = pd.Series(pd.date_range(self.start, periods=n, freq=pd.Timedelta(seconds=self.bucket)))
        hours, days = (np.array(x) for x in SHAPES[self.shape])
        by_month = np.ones(13)
        for k, v in (spec.get("months") or {}).items():
            by_month[self._month(k)] = float(v)
        w = days[at.dt.weekday] * (hours[at.dt.hour] if hourly else hours.sum()) * by_month[at.dt.month]
        day = at.dt.normalize()
        holidays = [pd.Timestamp(_time(h).date()) for h in spec.get("holidays") or []]
        w = w * np.where(day.isin(holidays), max(0.0, float(spec.get("holiday_weight", 0.0))), 1.0)
        w = w * (1 + (float(spec.get("growth", 1.0)) - 1) * np.arange(n) / max(1, n - 1))
        for spike in spec.get("spikes") or []:
            first, last = (pd.Timestamp(_time(x).date()) for x in (spike["start"], spike.get("end", spike["start"])))
            w = w * np.where((day >= first) & (day <= last), float(spike.get("multiplier", 2.0)), 1.0)
        self.weights = np.maximum(w, 0.0)
        if self.weights.sum() <= 0:
            self.weights = np.ones(n)
        self.cumulative = np.concatenate([[0], np.cumsum(self.weights)]) / self.weights.sum()

    @staticmethod
    def _month(k: Any) -> int:
        return int(k) if str(k).isdigit() else next(i for i, m in enumerate(MONTHS, 1) if m.startswith(str(k).lower()[:3]))

    def seconds_at(self, q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 0, 1)
        i = np.clip(np.searchsorted(self.cumulative, q, "left") - 1, 0, len(self.weights) - 1)
        width = self.cumulative[i + 1] - self.cumulative[i]
        inside = np.where(width > 0, (q - self.cumulative[i]) / np.where(width > 0, width, 1), 0)
        return np.minimum((i + inside) * self.bucket, self.seconds)

    def at(self, q: Column) -> Column:
        """The moment of a quantile: a binary search in Arrow batches, never a range join."""
        me = self

        @F.pandas_udf(T.DoubleType())
        def inverse(x: pd.Series) -> pd.Series:
            return pd.Series(me.seconds_at(x.to_numpy()))

        return F.timestamp_add("MICROSECOND", F.floor(inverse(q) * 1_000_000).cast("long"), F.lit(self.start.isoformat(sep=" ")).cast("timestamp_ntz"))

    def ordered(self, ordinal: Column, total: Column, jitter: float, draws: Draws) -> Column:
        return self.at((ordinal + draws.u("jitter") * F.lit(min(jitter, 0.999999))) / total)

    def buckets(self, spark: SparkSession) -> DataFrame:
        """(bucket, start, weight, cumulative) for reports and checks."""
        rows = [(i, self.start + dt.timedelta(seconds=self.bucket * i), float(w), float(c)) for i, (w, c) in enumerate(zip(self.weights, self.cumulative[1:], strict=True))]
        return spark.createDataFrame(rows, "bucket long, start timestamp_ntz, weight double, cumulative double")

    def rate(self, when: dt.datetime) -> float:
        """The weight of a moment against the peak, at least 0.02."""
        i = min(len(self.weights) - 1, max(0, int((when - self.start).total_seconds() // self.bucket)))
        return max(0.02, float(self.weights[i] / self.weights.max()))


def _time(v: Any) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return dt.datetime(v.year, v.month, v.day) if isinstance(v, dt.date) else dt.datetime.fromisoformat(str(v).replace("Z", "")).replace(tzinfo=None)


# ---------------------------------------------------------------- state
def running_total(initial: Column, change: Column, subject: str, ordinal: str) -> Column:
    """State that only adds up: a prefix sum, the row's own change included."""
    return initial + F.sum(change).over(Window.partitionBy(subject).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def fold(df: DataFrame, subject: str, ordinal: str, variables: dict[str, dict[str, Any]], prefix: str = "state.", given: dict[str, str] | None = None) -> DataFrame:
    """State that is clamped or rounded or reads other state: one ordered pass over each subject.

    A subject's history is one row while it is folded, in runs of the square root of its
    length (see `fold_long` for histories beyond a row). given: columns with the state that
    a subject comes with, where it isn't null, in place of the initial value.

    variables: name -> {initial (expression over the row), update (expression over the row,
    all variables, subject and ordinal), min, max, precision}. Variables update in order and
    see those before them updated; min, max, then half-even rounding."""
    schema = df.schema
    base = columns_of(schema)
    names = list(variables)
    state = df
    for n, v in variables.items():
        init = v.get("initial", 0)
        first = (Translator(base, None, n).value(init).col if isinstance(init, str) else F.lit(init)).cast("double")
        state = state.withColumn(f"__i_{n}", F.coalesce(F.col((given or {})[n]), first) if n in (given or {}) else first)
    row = F.struct(F.col(ordinal).alias("__o"), *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`__i_{n}`") for n in names])
    grouped = state.groupBy(F.col(subject).alias("__subject")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    acc_type = ", ".join(f"`{n}`: double" for n in names)
    out_type = f"array<struct<{acc_type}>>"
    none = F.array().cast(out_type)
    start = F.struct(*[F.element_at("__rows", 1)[f"__i_{n}"].alias(n) for n in names])

    def step(acc: Column, r: Column) -> Column:
        cols = {f.name: Value(r[f.name], kind_of(f.dataType)) for f in schema.fields}
        cols |= {n: Value(acc["now"][n], "float") for n in names}
        cols |= {"ordinal": Value(r["__o"], "int"), "subject": cols[subject]}
        for n, v in variables.items():
            x = Translator(cols, None, n).value(str(v["update"])).col.cast("double")
            if v.get("min") is not None:
                x = F.greatest(x, F.lit(float(v["min"])))
            if v.get("max") is not None:
                x = F.least(x, F.lit(float(v["max"])))
            if v.get("precision") is not None:
                x = F.bround(x, int(v["precision"]))
            cols[n] = Value(x, "float")
        now = F.struct(*[cols[n].col.alias(n) for n in names])
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    def of_block(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["now"].alias("now"), none.alias("all")), step)
        return let(done, lambda d: F.struct(d["now"].alias("now"), F.concat(acc["all"], F.array(d["all"])).alias("all")))

    zero = F.struct(start.alias("now"), F.array().cast(f"array<{out_type}>").alias("all"))
    states = F.aggregate(blocks(F.col("__rows")), zero, of_block, lambda a: F.flatten(a["all"]))
    folded = grouped.select("__rows", states.alias("__states"))
    each = folded.select(F.explode(F.arrays_zip("__rows", "__states")).alias("z"))
    return each.select(*[F.col(f"z.__rows.`{c}`").alias(c) for c in df.columns], *[F.col(f"z.__states.`{n}`").alias(f"{prefix}{n}") for n in names])


def fold_long(df: DataFrame, subject: str, ordinal: str, variable: str, initial: float, change: str, low: float | None = None, high: float | None = None, precision: int | None = None) -> DataFrame:
    """A clamped sum over histories too long for an array in a row: sorted streams by subject in Arrow batches, with state carried between batches."""
    name = variable

    def run(batches):
        last, value = None, initial
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, (s, x) in enumerate(zip(pdf[subject].tolist(), pdf[change].tolist(), strict=True)):
                if s != last:
                    last, value = s, initial
                value += x or 0
                value = value if low is None else max(low, value)
                value = value if high is None else min(high, value)
                value = value if precision is None else round(value, precision)
                out[i] = value
            yield pdf.assign(**{name: out})


    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, subject).sortWithinPartitions(subject, ordinal).mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


# ---------------------------------------------------------------- scenarios
#: Scenarios that a project takes up by `use`, its own keys over theirs.
SCENARIOS: dict[str, dict[str, Any]] = {}


class Scenario:
    def __init__(self, name: str, spec: dict[str, Any]):
        if used := spec.get("use"):
            if used not in SCENARIOS:
                raise ValueError(f"{name}: unknown scenario {used!r}; known: {', '.join(sorted(SCENARIOS))}")
            spec = {**SCENARIOS[used], **{k: v for k, v in spec.items() if k != "use"}}
        p = spec.get("parameters") or {}
        self.name, self.enabled = name, bool(spec.get("enabled", True))
        self.applies_to = [spec["applies_to"]] if isinstance(spec.get("applies_to"), str) else list(spec.get("applies_to") or [])
        self.fraction = float(spec.get("affects_fraction", 1.0))
        self.window = self._window(p.get("window", spec.get("window", [0, 1])))
        self.effects = dict(p.get("effects") or spec.get("effects") or {})
        phases = p.get("phases") or spec.get("phases") or {}
        items = list(phases.items()) if isinstance(phases, dict) else [(x.get("name", str(i)), x) if isinstance(x, dict) else (str(x), {}) for i, x in enumerate(phases)]
        lo, hi = self.window
        self.phases = []
        for i, (n, x) in enumerate(items):
            x = x or {}
            even = (lo + (hi - lo) * i / len(items), lo + (hi - lo) * (i + 1) / len(items))
            self.phases.append((n, self._window(x["window"]) if "window" in x else even, dict(x.get("effects") or {})))
        self.rate_multiplier = float(p.get("rate_multiplier", 1.0))

    @staticmethod
    def _window(w: Any) -> tuple[float, float]:
        if isinstance(w, dict):
            return (float(w["at"]), float(w["at"]) + float(w.get("duration", 0.1))) if "at" in w else (float(w.get("start", 0)), float(w.get("end", 1)))
        return float(w[0]), float(w[1])

    def applies(self, entity: str) -> bool:
        return self.enabled and (not self.applies_to or entity in self.applies_to)

    def affects(self, subject: Column, seed: int | str, mode: str) -> Column:
        """The subject's own draw, whatever the population."""
        return F.lit(False) if self.fraction <= 0 else F.lit(True) if self.fraction >= 1 else Draws(seed, "scenario", subject, self.name, mode).u() < self.fraction


def scenario_columns(scenarios: list[Scenario], entity: str, subject: Column, at: Column, seed: int | str, mode: str) -> dict[str, Column]:
    """name, phase, involved and position of the first scenario whose window holds the row."""
    name = phase = position = F.lit(None)
    for s in reversed([s for s in scenarios if s.applies(entity)]):
        lo, hi = s.window
        hit = s.affects(subject, seed, mode) & at.between(lo, hi)
        p = F.lit(None).cast("string")
        for n, (a, b), _ in reversed(s.phases):
            p = F.when(at.between(a, b), F.lit(n)).otherwise(p)
        name, phase = F.when(hit, F.lit(s.name)).otherwise(name), F.when(hit, p).otherwise(phase)
        position = F.when(hit, (at - lo) / max(hi - lo, 1e-12)).otherwise(position)
    return {"scenario.name": name.cast("string"), "scenario.phase": phase.cast("string"), "scenario.involved": name.isNotNull(), "scenario.position": position.cast("double")}


def overlay(df: DataFrame, scenarios: list[Scenario], entity: str, name: str, phase: str, draws_of) -> DataFrame:
    """Effects on existing fields, a phase's before its scenario's: a constant, a weighted mapping, a choice, or "=expression". Derived fields stay as they are."""
    from spindrift.operators.generators import weighted, weights_of

    schema = df.schema
    changes: dict[str, Column] = {}
    for s in reversed([s for s in scenarios if s.applies(entity)]):
        layers = [(F.col(name) == s.name, s.effects)] + [((F.col(name) == s.name) & (F.col(phase) == n), e) for n, _, e in s.phases]
        for test, effects in layers:
            for f, v in effects.items():
                if f not in schema.names:
                    continue
                if isinstance(v, str) and v.startswith("="):
                    x = Translator(columns_of(schema), None, f"scenario {s.name}").value(v[1:]).col
                elif isinstance(v, (dict, list)):
                    x = weighted(draws_of(f"scenario.{s.name}.{f}").u(), weights_of(v))
                else:
                    x = F.lit(v)
                kind = schema[f].dataType
                changes[f] = F.when(test, x.cast(kind)).otherwise(changes.get(f, F.col(f"`{f}`")))
    return df.withColumns(changes) if changes else df


def scenario_report(df: DataFrame, name: str = "_scenario_name", phase: str = "_scenario_phase", subject: str = "_subject") -> DataFrame:
    """(scenario, phase, records, subjects) of what scenarios touched."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("scenario"), F.col(phase).alias("phase")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(subject).alias("subjects"))
