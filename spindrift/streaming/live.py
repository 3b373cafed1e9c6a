"""Live streams of a project's records: an unbounded source of contiguous indexes, the same
projection as a batch, sinks by micro-batch.

`run` paces micro-batches itself (any rate, exact record limits, retargets); `streaming`
is the same projection over Spark's rate source, with checkpoints."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import validation
from spindrift.operators.generators import opt
from spindrift.operators.simulation import fold, stream_subject
from spindrift.plans.compiler import Project
from spindrift.streaming.rates import Bucket, parse
from spindrift.streaming.sinks import FanOut, Sink

BATCH, IN_FLIGHT, CYCLE_SECONDS = 100, 20_000, 3600


def _after_state(project: Project, entity: str) -> set[str]:
    """The fields that hold state, and those made from them."""
    fields = project.entities[entity].fields
    late = {n for n, f in fields.items() if f.generator == "state"}
    while more := {n for n, f in fields.items() if n not in late and f.needs & late}:
        late |= more
    return late


def projection(project: Project, entity: str, indexes: DataFrame, index: str = "_index", live: bool = True, known: DataFrame | None = None, hidden: bool = False) -> DataFrame:
    """Records of the given indexes. Times of event_time and datetime fields become now; subjects are drawn by index, so shares hold and no event is numbered twice.

    State is folded over the rows of each subject by index, from `known`: (_subject, _seen,
    one column for each variable) of the subjects that had events before. hidden: keeps
    `_subject`, `_ordinal` (events of the subject before this one) and `state.` columns."""
    e = project.entities[entity]
    at = F.col(index)
    subject = None
    late = _after_state(project, entity)
    variables = project.state_variables(e) if late else {}
    if e.subject:
        sim = e.spec.simulation
        subject = stream_subject(at, project.entities[e.subject].spec.count, project.draws(entity, "@subject", at), str(sim.get("distribution", "uniform")), float(sim.get("skew", 1.5)))
        indexes = indexes.withColumn("_subject", subject)
    # what updates read must be there before the fold
    made = {n: _live_value(project, e, n, at, live) for n in e.fields if n not in late}
    first = indexes.select(at.alias("_index"), *([F.col("_subject")] if e.subject else []), *[c.alias(n) for n, c in made.items()])
    if not (variables or (hidden and e.subject)):
        return first.select("_index", *e.fields)
    names = list(variables)
    if known is None:
        known = project.spark.createDataFrame([], ", ".join(["_subject long", "_seen long", *[f"`{n}` double" for n in names]]))
    past = known.select("_subject", F.col("_seen").alias("__seen"), *[F.col(f"`{n}`").alias(f"__was_{n}") for n in names])
    met = first.join(F.broadcast(past), "_subject", "left")  # at most the rows of a micro-batch
    rank = F.row_number().over(Window.partitionBy("_subject").orderBy("_index")) - 1
    met = met.withColumn("_ordinal", (F.coalesce("__seen", F.lit(0)) + rank).cast("long"))
    if names:
        met = fold(met, "_subject", "_ordinal", variables, given={n: f"__was_{n}" for n in names})
    sim_columns = {c: F.col(f"`{c}`") for c in met.columns if c.startswith("state.")}
    for layer in e.layers:
        if mine := [n for n in layer if n in late]:
            met = met.withColumns({n: project._value(e, e.fields[n], met, F.col("_index"), sim_columns, {}, None) for n in mine})
    return met.select("_index", *(["_subject", "_ordinal", *[F.col(f"`{c}`") for c in sim_columns]] if hidden else []), *e.fields)


def _live_value(project: Project, e: Any, n: str, at: Column, live: bool) -> Column:
    entity, f = e.spec.name, e.fields[n]
    if live and f.generator in ("event_time", "datetime") and f.type in ("datetime", "date"):
        return F.current_timestamp().cast("timestamp_ntz" if f.type == "datetime" else "date")
    if f.generator == "subject":
        parent = project.entities[e.subject]
        key = f.options.get("field") or parent.spec.primary_key or next(iter(parent.fields))
        return project.inline(e.subject, key, F.col("_subject")).col
    if f.generator == "scenario":
        return _recurring(project, entity, f, at)
    if e.subject and any(project._owner(e, o) for o, _ in f.parents):
        values = {x: project.inline(entity, x, at) for x in f.needs if e.fields[x].generator not in ("subject", "event_time", "scenario", "state")}
        from spindrift.operators.generators import GENERATORS, Context

        def attribute(owner: str, attr: str):
            target, ref = project._owner(e, owner)
            return project.inline(target, attr, F.col("_subject") if ref is None else project._reference_index(e, ref, at, None))

        c = Context(n, f.type, entity, at, project.draws(entity, n, at), T.StructType([]), f.spec.constraints, attribute, {}, project.now, project.base, project.spark, values)
        return project._finished(f, GENERATORS[f.generator](f.options, c), entity, at, None).col
    return project.inline(entity, n, at).col


def _recurring(project: Project, entity: str, f: Any, at: Column) -> Column:
    """A scenario's window comes again each cycle, by the clock."""
    position = F.pmod(F.unix_timestamp(F.current_timestamp()), F.lit(CYCLE_SECONDS)) / CYCLE_SECONDS
    name = F.lit(opt(f.options, "normal")).cast("string")
    for s in reversed([s for s in project.scenarios if s.applies(entity)]):
        subject = F.col("_subject") if project.entities[entity].subject else at
        name = F.when(s.affects(subject, project.seed_of(entity), project.mode) & position.between(*s.window), F.lit(s.name)).otherwise(name)
    return name


@dataclass
class Stats:
    generated: int = 0
    delivered: int = 0
    failed: int = 0
    invalid: int = 0
    started: float = field(default_factory=time.monotonic)
    expected: float = 0.0
    by_entity: dict[str, int] = field(default_factory=dict)

    @property
    def mean_rate(self) -> float:
        return self.generated / max(1e-9, time.monotonic() - self.started)

    recent: list[tuple[float, int]] = field(default_factory=list)

    @property
    def current_rate(self) -> float:
        """Records a second over the last five seconds."""
        now = time.monotonic()
        self.recent = [(t, n) for t, n in self.recent if now - t <= 5]
        return sum(n for _, n in self.recent) / max(1e-9, min(5.0, now - self.started))

    @property
    def attainment(self) -> float:
        return self.generated / self.expected if self.expected else 1.0


class Live:
    """A paced stream. The state of subjects is carried from tick to tick on the driver, for those that had events, as a row of numbers each. validate: a policy for records that fail their checks."""

    def __init__(self, project: Project, rates: dict[str, str | float], sinks: list[Sink], start: dict[str, int] | None = None, on_error: str = "continue", follow_shape: bool = False, burst: float = 1.0, validate: str | None = None):
        self.validate = validate
        self.state: dict[str, dict[int, tuple]] = {e: {} for e in rates}
        self.project, self.follow = project, follow_shape
        self.target = {e: parse(r) for e, r in rates.items()}
        self.buckets = {e: Bucket(r, burst) for e, r in self.target.items()}
        self.next = {e: (start or {}).get(e, 0) for e in rates}
        self.out, self.stats = FanOut(sinks, on_error), Stats()
        self.epoch = 0

    def retarget(self, entity: str, rate: str | float) -> None:
        self.target[entity] = parse(rate)
        self.buckets[entity].retarget(self.target[entity])

    def tick(self, most: int | None = None, now: dt.datetime | None = None) -> int:
        """One micro-batch of what is due, at most `most` records in all."""
        sent = 0
        for e, b in self.buckets.items():
            if self.follow and self.project.timeline is not None:
                b.rate = self.target[e] * self.project.timeline.rate(now or dt.datetime.now())
            n = b.due(IN_FLIGHT if most is None else min(IN_FLIGHT, most - sent))
            if not n:
                continue
            a = self.next[e]
            spark = self.project.spark
            df = self._records(e, spark.range(a, a + n, 1, max(1, min(8, n // BATCH))).withColumnRenamed("id", "_index"))
            before = sum(s.failed for s in self.out.sinks)
            self.out(df.withColumn("_entity", F.lit(e)), self.epoch)
            self.epoch += 1
            self.next[e] += n
            sent += n
            self.stats.generated += n
            self.stats.recent.append((time.monotonic(), n))
            bad = sum(s.failed for s in self.out.sinks) - before
            self.stats.failed += bad
            self.stats.delivered += n * len(self.out.sinks) - bad
            self.stats.by_entity[e] = self.stats.by_entity.get(e, 0) + n
        self.stats.expected = sum(b.expected for b in self.buckets.values())
        return sent

    def _records(self, entity: str, indexes: DataFrame) -> DataFrame:
        """The records of one tick; moves the state of their subjects on."""
        p, e = self.project, self.project.entities[entity]
        names = list(p.state_variables(e))
        if names and e.subject:
            schema = ", ".join(["_subject long", "_seen long", *[f"`{n}` double" for n in names]])
            sim = e.spec.simulation
            subject = stream_subject(F.col("_index"), p.entities[e.subject].spec.count, p.draws(entity, "@subject", F.col("_index")), str(sim.get("distribution", "uniform")), float(sim.get("skew", 1.5)))
            mine = [r[0] for r in indexes.select(subject.cast("long")).distinct().collect()]  # of one tick
            past = self.state[entity]
            known = p.spark.createDataFrame([(s, *past[s]) for s in mine if s in past], schema)
            df = projection(p, entity, indexes, known=known, hidden=True)
            last = df.groupBy("_subject").agg((F.max("_ordinal") + 1).alias("seen"), F.max_by(F.struct(*[F.col(f"`state.{n}`").alias(n) for n in names]), "_ordinal").alias("s"))
            past |= {r._subject: (r.seen, *r.s) for r in last.collect()}
            df = df.select("_index", *e.fields)
        else:
            df = projection(p, entity, indexes)
        if self.validate:
            df = df.withColumn("_issues", validation.issues(p.checks(entity, df)))
            self.stats.invalid += df.where(F.exists("_issues", lambda i: i["severity"] == "error")).count()
            df = validation.enforce(df, "_issues", self.validate)
        return df

    def run(self, seconds: float | None = None, max_records: int | None = None, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> Stats:
        """Until the time or the number of records is reached, exactly."""
        end = None if seconds is None else time.monotonic() + seconds
        while (end is None or time.monotonic() < end) and (max_records is None or self.stats.generated < max_records):
            left = None if max_records is None else max_records - self.stats.generated
            self.tick(left)
            sleep(pause)
        return self.stats


def streaming(project: Project, entity: str, rate: str | float, sinks: list[Sink], checkpoint: str | None = None, start: int = 0, partitions: int = 4):
    """A streaming query over Spark's rate source; its offsets are the record indexes, so a restart goes on where it stopped."""
    n = max(1, round(parse(rate)))
    source = project.spark.readStream.format("rate").option("rowsPerSecond", n).option("numPartitions", partitions).load()
    out, indexes = FanOut(sinks), source.select((F.col("value") + start).alias("_index"))
    if project.state_variables(project.entities[entity]):
        carried = Live(project, {entity: rate}, sinks)
        writer = indexes.writeStream.foreachBatch(lambda batch, epoch: out(carried._records(entity, batch), epoch)).outputMode("append")
    else:
        writer = projection(project, entity, indexes).writeStream.foreachBatch(out).outputMode("append")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stateful(events: DataFrame, subject: str, change: str, initial: float, low: float | None = None, high: float | None = None):
    """A true fold for each subject of a stream, kept in Spark's state store."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = T.StructType([*events.schema.fields, T.StructField("state", T.DoubleType())])

    def fold(key, batches, state):
        (value,) = state.get if state.exists else (initial,)
        for pdf in batches:
            out = []
            for x in pdf[change].tolist():
                value += x or 0
                value = value if low is None else max(low, value)
                value = value if high is None else min(high, value)
                out.append(value)
            yield pd.DataFrame(pdf.assign(state=out))
        state.update((float(value),))

    return events.groupBy(subject).applyInPandasWithState(fold, schema, "value double", "append", GroupStateTimeout.NoTimeout)
