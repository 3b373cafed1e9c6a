"""The compiler: a project becomes one lazy DataFrame for each entity.

An entity is `spark.range` with one projection for each dependency layer. A parent's
column is the parent's own expression with its index substituted, so keys and small
closures need no join; only what is larger, or comes from Python, is joined by index."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import transforms as tf
from spindrift.functions.expressions import Value, kind_of, names_in
from spindrift.functions.hashing import FAST, Draws
from spindrift.functions.types import spark_type
from spindrift.operators import chaos, generators, patches, simulation, validation
from spindrift.operators.generators import Context, canonical, opt, template_fields
from spindrift.operators.relations import parent_index, read_parent, self_index
from spindrift.plans import graph
from spindrift.plans.recommend import output_type, recommend
from spindrift.plans.spec import EntitySpec, FieldSpec, ProjectSpec, SpecError

#: A parent's closure of more fields than this is joined, not substituted.
MOST_INLINED = 8
_PYTHON = {"llm", "image", "tts", "document"}
generators.GENERATORS.setdefault("reference", lambda o, c: c.fail("a reference is compiled with its project"))
generators.ALIASES.update(dict.fromkeys(("fk", "foreign_key", "belongs_to"), "reference"))


@dataclass
class CompiledField:
    spec: FieldSpec
    generator: str
    options: dict[str, Any]
    type: str
    needs: set[str] = field(default_factory=set)  # own fields
    parents: set[tuple[str, str]] = field(default_factory=set)  # (owner as written, field)
    reason: str = ""


@dataclass
class CompiledEntity:
    spec: EntitySpec
    fields: dict[str, CompiledField]
    layers: list[list[str]]
    subject: str | None = None

    @property
    def protected(self) -> set[str]:
        return {n for n, f in self.fields.items() if n == self.spec.primary_key or f.spec.unique or f.generator in ("reference", "subject", "scenario")}


class Project:
    def __init__(self, spec: ProjectSpec | dict[str, Any], spark: SparkSession | None = None, mode: str = FAST, now: dt.datetime | None = None, base: str = "."):
        self.spec = spec if isinstance(spec, ProjectSpec) else ProjectSpec.of(spec)
        self.spark, self.mode, self.now, self.base = spark, mode, now or dt.datetime(2026, 1, 1), base
        self.timeline = simulation.Timeline(self.spec.timeline) if self.spec.timeline else None
        self.scenarios = [simulation.Scenario(n, s or {}) for n, s in self.spec.scenarios.items()]
        self.entities: dict[str, CompiledEntity] = {}
        for e in self.spec.entities.values():
            self.entities[e.name] = self._entity(e)
        names = list(self.entities)
        needs = {n: self._entity_needs(n) for n in names}
        self.order = graph.order(names, needs)
        self._adopt_reference_types()

    # ------------------------------------------------------------ analysis
    def _entity(self, e: EntitySpec) -> CompiledEntity:
        sim = e.simulation or {}
        if sim and sim.get("subject") not in self.spec.entities:
            raise SpecError(f"{e.name}: the simulation's subject {sim.get('subject')!r} isn't an entity")
        fields = {}
        for f in e.fields.values():
            reason, options = "declared", dict(f.options)
            if f.generator is None:
                name, more, reason = recommend(f.name, f.type, f.constraints, f.name == e.primary_key, tuple(self.spec.entities), e.name)
                options = {**more, **options}
            else:
                name = f.generator
            name = canonical(name)
            fields[f.name] = CompiledField(f, name, options, f.type or output_type(name, options), reason=reason)
        entity = CompiledEntity(e, fields, [], sim.get("subject"))
        for c in fields.values():
            self._needs(entity, c)
        for a in e.assertions:
            for n in names_in(a)[0]:
                if n not in fields:
                    raise SpecError(f"{e.name}: the assertion {a!r} reads {n!r}, which isn't a field")
        entity.layers = graph.layers(list(fields), {n: c.needs for n, c in fields.items()})
        return entity

    def _needs(self, e: CompiledEntity, c: CompiledField) -> None:
        o, own = c.options, set(e.fields)
        names, pairs = set(c.spec.depends_on), set()
        sources: list[str] = []
        if c.generator == "expression":
            sources.append(str(opt(o, "expression", "expr", "formula", "value", default="")))
        elif c.generator in ("template", "document"):
            sources += template_fields(str(opt(o, "template", "format", "value", "pattern", default="")))
        elif c.generator == "composite":
            for s in opt(o, "steps", "generators", default=[]):
                if isinstance(s, dict):
                    body = s if "type" in s else next(iter(s.values()))
                    body = body if isinstance(body, dict) else {"value": body}
                    if "expression" in body or "expression" in s:
                        sources.append(str(body.get("expression", body.get("value", ""))))
                    if "template" in body:
                        sources += template_fields(str(body["template"]))
        for k in ("source", "offset_field", "name_field"):
            if isinstance(o.get(k), str) and c.generator in ("transform", "event_time", "tts", "uuid"):
                sources.append(o[k])
        for n in opt(o, "context", default=[]) if c.generator == "llm" else []:
            names.add(n)
        if c.generator == "state":
            for v in (e.spec.simulation or {}).get("state", {}).values():
                sources.append(str(v.get("update", "0")))
        for s in sources:
            try:
                n, p = names_in(s)
            except SyntaxError:
                raise SpecError(f"{e.spec.name}.{c.spec.name}: {s!r} is not an expression") from None
            names |= n
            pairs |= p
        for owner, _ in pairs:
            if owner in own:
                names.add(owner)
            else:
                names |= {n for n, f in e.fields.items() if f.generator == "reference" and self._target(f) == owner}
        state = set((e.spec.simulation or {}).get("state", {}))
        c.needs = {n for n in names if n in own and n != c.spec.name and not (c.generator == "state" and n in state)}
        c.parents = pairs

    @staticmethod
    def _target(f: CompiledField) -> str:
        t = str(opt(f.options, "entity", "target", "to", "references", "value", default=""))
        return t.split(".")[0]

    def _key_field(self, f: CompiledField) -> str:
        t = str(opt(f.options, "entity", "target", "to", "references", "value", default=""))
        given = opt(f.options, "field", "key") or (t.split(".")[1] if "." in t else None)
        parent = self.spec.entities.get(self._target(f))
        if parent is None:
            raise SpecError(f"{f.spec.name}: unknown entity {self._target(f)!r}")
        return given or parent.primary_key or next(iter(parent.fields))

    def _entity_needs(self, name: str) -> set[str]:
        e = self.entities[name]
        out = {self._target(f) for f in e.fields.values() if f.generator == "reference"} | ({e.subject} if e.subject else set())
        for r in self.spec.relationships:
            if str(r.get("from", "")).split(".")[0] == name and r.get("to"):
                out.add(str(r["to"]).split(".")[0])
        return out - {name}

    def _adopt_reference_types(self) -> None:
        for name in self.order:
            e = self.entities[name]
            for f in e.fields.values():
                if f.spec.type is None and f.generator in ("reference", "subject"):
                    parent = self.entities[self._target(f) if f.generator == "reference" else e.subject]
                    key = self._key_field(f) if f.generator == "reference" else f.options.get("field") or parent.spec.primary_key or next(iter(parent.fields))
                    f.type = parent.fields[key].type

    # ------------------------------------------------------------ expressions
    def seed_of(self, entity: str) -> Any:
        s = self.entities[entity].spec.seed
        return self.spec.seed if s is None else s

    def draws(self, entity: str, fieldname: str, index: Column, namespace: str | None = None) -> Draws:
        return Draws(self.seed_of(entity), entity, index, fieldname, self.mode, namespace)

    def _reference_index(self, e: CompiledEntity, f: CompiledField, index: Column, namespace: str | None) -> Column:
        target = self._target(f)
        n, d = self.entities[target].spec.count, self.draws(e.spec.name, f.spec.name, index, namespace)
        if target == e.spec.name:
            return self_index(index, n, d)
        if f.spec.unique:
            if e.spec.count > n:
                raise SpecError(f"{e.spec.name}.{f.spec.name}: {e.spec.count} rows can't have {n} different parents")
            return parent_index(index, n, d, "sequential")
        how = str(opt(f.options, "distribution", "mode", "strategy", default="skewed" if "skew" in f.options else "uniform"))
        return parent_index(index, n, d, how, float(opt(f.options, "skew", default=1.5)))

    def _closure(self, entity: str, name: str, seen: set[tuple[str, str]] | None = None) -> set[tuple[str, str]] | None:
        """The fields that a field's expression takes in; None if one of them can't be substituted."""
        seen = set() if seen is None else seen
        if (entity, name) in seen:
            return seen
        e = self.entities[entity]
        if name not in e.fields:
            raise SpecError(f"{entity} has no field {name!r}")
        f = e.fields[name]
        beta = f.generator == "distribution" and "beta" in str(f.options.get("distribution", f.options.get("kind")))
        if f.generator in _PYTHON or beta or e.subject or (self.spec.edge_cases > 0 and name not in e.protected):
            return None
        seen.add((entity, name))
        if len(seen) > MOST_INLINED:
            return None
        for n in f.needs:
            if self._closure(entity, n, seen) is None:
                return None
        if f.generator == "reference":
            target = self._target(f)
            if target == entity or self._closure(target, self._key_field(f), seen) is None:
                return None if target != entity else seen
        for owner, attr in f.parents:
            ref = self._owner(e, owner)
            if ref is None or self._closure(ref[0], attr, seen) is None:
                return None
        return seen

    def _owner(self, e: CompiledEntity, owner: str) -> tuple[str, CompiledField | None] | None:
        """(entity, reference field) of an owner's name: a reference field, else an entity by its last reference, else the subject."""
        if owner in e.fields and e.fields[owner].generator in ("reference", "subject"):
            f = e.fields[owner]
            return (self._target(f), f) if f.generator == "reference" else (e.subject, None)
        refs = [f for f in e.fields.values() if f.generator == "reference" and self._target(f) == owner]
        if refs:
            return owner, refs[-1]
        return (e.subject, None) if e.subject == owner or owner == "subject" and e.subject else None

    def inline(self, entity: str, name: str, index: Column, namespace: str | None = None) -> Value:
        """A field of any row as an expression of the row's index."""
        e, f = self.entities[entity], self.entities[entity].fields[name]
        values = {n: self.inline(entity, n, index, namespace) for n in f.needs}

        def attribute(owner: str, attr: str) -> Value:
            target, ref = self._owner(e, owner)
            return self.inline(target, attr, self._reference_index(e, ref, index, namespace), namespace)

        if f.generator == "reference":
            at = self._reference_index(e, f, index, namespace)
            x = self.inline(self._target(f), self._key_field(f), at, namespace).col
        else:
            c = Context(name, f.type, entity, index, self.draws(entity, name, index, namespace), T.StructType([]), f.spec.constraints, attribute, {}, self.now, self.base, self.spark, values)
            x = generators.GENERATORS[f.generator](f.options, c)
        return self._finished(f, x, entity, index, namespace)

    def _finished(self, f: CompiledField, x: Column, entity: str, index: Column, namespace: str | None) -> Value:
        """Cast, pipeline and null injection."""
        kind = spark_type(f.type, f.spec.constraints.get("precision"))
        if f.spec.transform:
            x, _ = tf.apply(x.cast(kind), kind, f.spec.transform)
        if isinstance(kind, T.DayTimeIntervalType):  # seconds, or an interval's own text
            text = x.cast("string")
            x = F.coalesce(F.make_dt_interval(secs=text.try_cast("decimal(18,6)")), text.try_cast(kind))
        elif not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            x = x.cast(kind)
        if f.spec.null_probability > 0:
            x = F.when(self.draws(entity, f.spec.name, index, namespace).u("null") >= f.spec.null_probability, x)
        return Value(x, kind_of(kind))

    # ------------------------------------------------------------ frames
    def frame(self, name: str, start: int = 0, count: int | None = None, namespace: str | None = None, hidden: bool = False, partitions: int | None = None) -> DataFrame:
        """The records of an entity, or of a range of their indexes, before damage and patches."""
        e, spark = self.entities[name], self.spark
        end = min(e.spec.count, start + (e.spec.count if count is None else count))
        sim: dict[str, Column] = {}
        if e.subject:
            df = self._events(e, start, end)
            index, q = F.col("_index"), simulation.quantile(F.col("_ordinal"), F.col("_total"))
            sim = simulation.scenario_columns(self.scenarios, name, F.col("_subject"), q, self.seed_of(name), self.mode)
            marks = {f"_{k.replace('.', '_')}": v for k, v in sim.items()}
            df = df.withColumns(marks)
            sim = {k: F.col(f"_{k.replace('.', '_')}") for k in sim}
        else:
            df = spark.range(start, max(start, end), 1, partitions).withColumnRenamed("id", "_index")
            index = F.col("_index")
        df, joined = self._with_indexes(e, df, index, namespace)
        edges = self._edge_plan(e, index)
        state_done = not (e.spec.simulation or {}).get("state")
        for layer in e.layers:
            if not state_done and any(e.fields[n].generator == "state" for n in layer):
                df, state_done = self._fold(e, df), True
                sim |= {c: F.col(f"`{c}`") for c in df.columns if c.startswith("state.")}
            df = self._join_parents(e, [e.fields[n] for n in layer], df, joined, namespace)
            cols = {}
            for n in layer:
                x = self._value(e, e.fields[n], df, index, sim, joined, namespace)
                if edges and n in edges[1]:
                    hit, at, case, names = *edges[0], sorted(edges[1])
                    x = chaos.with_case(x, spark_type(e.fields[n].type, e.fields[n].spec.constraints.get("precision")), edges[1][n], hit & (at == names.index(n)), case)
                cols[n] = x
            df = df.withColumns(cols)
        if e.subject:
            draws = lambda label: self.draws(name, label, index, namespace)
            df = simulation.overlay(df, self.scenarios, name, "_scenario_name", "_scenario_phase", draws)
        keep = [F.col(n) for n in e.fields]
        keep = [F.col("_index"), *([F.col(c) for c in df.columns if c in ("_subject", "_ordinal", "_total", "_scenario_name", "_scenario_phase")] if hidden else []), *keep]
        return df.select(*keep) if hidden else df.select(*keep[0:1], *keep[1:])

    def _events(self, e: CompiledEntity, start: int, end: int) -> DataFrame:
        sim, n = e.spec.simulation, self.entities[e.subject].spec.count
        subjects = self.spark.range(n).withColumnRenamed("id", "_s")
        allocated = simulation.allocate(subjects, "_s", n, e.spec.count, str(sim.get("distribution", "uniform")), float(sim.get("skew", 1.5)), int(sim.get("minimum", 0)))
        return simulation.events_of(allocated, "_s", start, end).select(F.col("index").alias("_index"), F.col("subject").alias("_subject"), F.col("ordinal").alias("_ordinal"), F.col("total").alias("_total"))

    def _with_indexes(self, e: CompiledEntity, df: DataFrame, index: Column, namespace: str | None) -> tuple[DataFrame, dict[tuple[str, str], str]]:
        refs = {f"_ref_{n}": self._reference_index(e, f, index, namespace) for n, f in e.fields.items() if f.generator == "reference"}
        return (df.withColumns(refs) if refs else df), {}

    def _parent_at(self, e: CompiledEntity, ref: CompiledField | None) -> Column:
        return F.col("_subject") if ref is None else F.col(f"_ref_{ref.spec.name}")

    def _wanted(self, e: CompiledEntity, f: CompiledField) -> list[tuple[str, str, CompiledField | None]]:
        out = []
        for owner, attr in sorted(f.parents):
            found = self._owner(e, owner)
            if found is None:
                raise SpecError(f"{e.spec.name}.{f.spec.name}: there is no parent {owner!r}")
            out.append((found[0], attr, found[1]))
        if f.generator == "reference":
            out.append((self._target(f), self._key_field(f), f))
        if f.generator == "subject":
            parent = self.entities[e.subject]
            out.append((e.subject, f.options.get("field") or parent.spec.primary_key or next(iter(parent.fields)), None))
        return out

    def _join_parents(self, e: CompiledEntity, fields: list[CompiledField], df: DataFrame, joined: dict, namespace: str | None) -> DataFrame:
        """Joins what can't be substituted: once for each reference, with only the columns that are read."""
        groups: dict[str, tuple[str, dict[str, str]]] = {}
        for f in fields:
            for target, attr, ref in self._wanted(e, f):
                slot = ref.spec.name if ref else "@subject"
                if (slot, attr) in joined or target == e.spec.name or self._closure(target, attr) is not None:
                    continue
                groups.setdefault(slot, (target, {}))[1][f"_p_{slot}_{attr}"] = attr
                joined[slot, attr] = f"_p_{slot}_{attr}"
        for slot, (target, columns) in groups.items():
            parent = self.frame(target, namespace=namespace)
            df = read_parent(df, "_subject" if slot == "@subject" else f"_ref_{slot}", parent, "_index", columns)
        return df

    def _read(self, e: CompiledEntity, target: str, attr: str, ref: CompiledField | None, joined: dict, namespace: str | None) -> Value:
        slot = ref.spec.name if ref else "@subject"
        if (slot, attr) in joined:
            f = self.entities[target].fields[attr]
            return Value(F.col(f"`{joined[slot, attr]}`"), kind_of(spark_type(f.type)))
        v = self.inline(target, attr, self._parent_at(e, ref), namespace)
        return Value(F.when(self._parent_at(e, ref).isNotNull(), v.col), v.kind)

    def _value(self, e: CompiledEntity, f: CompiledField, df: DataFrame, index: Column, sim: dict[str, Column], joined: dict, namespace: str | None) -> Column:
        name = e.spec.name

        def attribute(owner: str, attr: str) -> Value:
            target, ref = self._owner(e, owner) or (None, None)
            if target is None:
                raise SpecError(f"{name}.{f.spec.name}: there is no parent {owner!r}")
            return self._read(e, target, attr, ref, joined, namespace)

        if f.generator in ("reference", "subject"):
            if f.generator == "subject" and not e.subject:
                raise SpecError(f"{name}.{f.spec.name}: a subject needs a simulation")
            target, key, ref = self._wanted(e, f)[-1]
            x = self._read(e, target, key, ref, joined, namespace).col
        else:
            d = self.draws(name, f.spec.name, index, namespace)
            mine = dict(sim)
            if f.generator == "event_time" and self.timeline is not None:
                if str(opt(f.options, "spread", default="ordered")) == "ordered" and e.subject:
                    mine["time"] = self.timeline.ordered(F.col("_ordinal"), F.col("_total"), float(opt(f.options, "jitter", default=0.8)), d)
                else:
                    mine["time"] = mine["random_time"] = self.timeline.at(d.u("time"))
            fields = T.StructType([x for x in df.schema.fields if x.name in e.fields])
            c = Context(f.spec.name, f.type, name, index, d, fields, f.spec.constraints, attribute, mine, self.now, self.base, self.spark)
            x = generators.GENERATORS[f.generator](f.options, c)
        return self._finished(f, x, name, index, namespace).col

    def _edge_plan(self, e: CompiledEntity, index: Column):
        if self.spec.edge_cases <= 0:
            return None
        cases = {n: chaos.cases(f.type, f.spec.constraints, self.spec.edge_categories, f.options) for n, f in e.fields.items() if n not in e.protected and f.generator != "reference" and (not self.spec.edge_fields or n in self.spec.edge_fields)}
        cases = {n: c for n, c in cases.items() if c}
        return (chaos.edge_plan(e.spec.name, index, self.seed_of(e.spec.name), self.spec.edge_cases, {n: len(c) for n, c in cases.items()}, self.mode), cases) if cases else None

    @staticmethod
    def state_variables(e: CompiledEntity) -> dict[str, dict[str, Any]]:
        out = {}
        for n, v in ((e.spec.simulation or {}).get("state") or {}).items():
            v = dict(v) if isinstance(v, dict) else {"update": v}
            out[n] = v | {"initial": v.get("initial", v.get("start", 0))}
        return out

    def _fold(self, e: CompiledEntity, df: DataFrame) -> DataFrame:
        return simulation.fold(df, "_subject", "_ordinal", self.state_variables(e))

    # ------------------------------------------------------------ whole pipeline
    def records(self, name: str, start: int = 0, count: int | None = None, damage: bool = True, patch: bool = True) -> DataFrame:
        """The records as they are written: generated, damaged (with `_chaos`), patched."""
        e = self.entities[name]
        df = self.frame(name, start, count)
        rates = chaos.rates(self.spec.chaos)
        if damage and any(rates.values()):
            keep = {e.spec.primary_key} | {n for n, f in e.fields.items() if f.generator == "scenario"}
            df = chaos.damage(df, name, "_index", self.seed_of(name), self.spec.chaos, tuple(k for k in keep if k), self.mode)
        if patch and self.spec.patches:
            df = patches.apply(df, self.spec.patches, name)
        if self.spec.provenance != "none":
            df = df.withColumn("_provenance", self.provenance(name))
        return df

    def provenance(self, name: str) -> Column:
        e, mode = self.entities[name], self.spec.provenance
        items = {"project": self.spec.name, "schema": self.schema_hash()}
        if mode in ("record", "field", "full"):
            items |= {"entity": name, "seed": str(self.seed_of(name))}
        if mode in ("field", "full"):
            items |= {f"field.{n}": f.generator for n, f in e.fields.items()}
        parts = [x for k, v in items.items() for x in (F.lit(k), F.lit(v))]
        if mode in ("record", "field", "full"):
            parts += [F.lit("index"), F.col("_index").cast("string")]
        return F.create_map(*parts)

    def checks(self, name: str, df: DataFrame) -> list[validation.Check]:
        e, out = self.entities[name], []
        for n, f in e.fields.items():
            if n not in df.columns:
                continue
            kind = spark_type(f.type)
            _, structure = validation.structural(F.col(f"`{n}`"), n, f.type, f.spec.nullable or f.generator in ("null", "scenario", "reference"))
            out += structure + validation.constraints(F.col(f"`{n}`"), n, f.spec.constraints, isinstance(kind, T.StringType), isinstance(kind, T.ArrayType))
        log = "_chaos" if "_chaos" in df.columns else None
        out += validation.assertions(df, e.spec.assertions, log)
        asked = self.spec.quality.get("validators") or {}
        for v, options in (asked if isinstance(asked, dict) else dict.fromkeys(asked, {})).items():
            if v not in validation.VALIDATORS:
                raise SpecError(f"unknown validator {v!r}; known: {', '.join(sorted(validation.VALIDATORS))}")
            out += validation.VALIDATORS[v](df, options or {})
        policy = self.spec.privacy.get("policy")
        if policy:
            text = {n: F.col(f"`{n}`") for n, f in e.fields.items() if isinstance(spark_type(f.type), T.StringType)}
            exempt = [n for n, f in e.fields.items() if f.spec.privacy == "allow" or f.options.get("safe") is False]
            out += validation.privacy(text, self.spec.privacy.get("checks", list(validation.PRIVACY)), policy, exempt, [n for n, f in e.fields.items() if f.type in ("ip_address", "cidr")])
        return out

    def validated(self, name: str, policy: str = "report", **range_: Any) -> DataFrame:
        """Records with `_issues`, after the policy. Uniqueness is judged on what the policy leaves."""
        df = self.records(name, **range_)
        log = "_chaos" if "_chaos" in df.columns else None
        df = df.withColumn("_issues", validation.issues(self.checks(name, df), log))
        df = validation.enforce(df, "_issues", policy)
        unique = [n for n, f in self.entities[name].fields.items() if f.spec.unique or n == self.entities[name].spec.primary_key]
        copy = F.map_contains_key("_chaos", F.lit("@duplicate")) if log else F.lit(False)
        for n in unique:
            issue = F.array(F.struct(F.lit(n).alias("field"), F.lit("uniqueness").alias("category"), F.lit("repeated").alias("message"), F.lit("error").alias("severity")))
            df = df.withColumn("_r", validation.repeats(n, "_index")).withColumn("_issues", F.when(F.col("_r") & ~copy, F.concat("_issues", issue)).otherwise(F.col("_issues"))).drop("_r")
        return df

    def quality(self, name: str) -> DataFrame:
        return validation.statistics(self.validated(name), "_issues")

    def quality_report(self, name: str) -> DataFrame:
        """One row of shares from 0 to 1: schema and constraint validity, uniqueness, referential
        integrity over all references, the mean match of declared shares, and model answers
        that fit their field. A share of nothing is 1."""
        e, df = self.entities[name], self.frame(name)
        checked, broken = 0, 0
        if (r := self.integrity(name)) is not None:
            checked, broken = r.agg(F.sum("checked"), F.sum("broken")).first()
        matches, answered, written = [], 0, 0
        for n, f in e.fields.items():
            if f.generator == "weighted" and not f.spec.transform:
                d = validation.distribution(df.where(F.col(f"`{n}`").isNotNull()), n, {str(k): w for k, w in generators.weights_of(opt(f.options, "values", "choices", "weights", "options", default=f.spec.constraints.get("enum")))})
                if (row := d.first()) is not None and row.samples:
                    matches.append(1 - row.distance)
        models = [n for n, f in e.fields.items() if f.generator == "llm"]
        if models:
            fits = [F.count_if(F.col(f"`{n}`").isNotNull() & (F.length(F.col(f"`{n}`").cast("string")) > 0)) for n in models]
            got = df.agg(F.count(F.lit(1)), *fits).first()
            answered, written = got[0] * len(models), sum(got[1:])
        share = lambda bad, of: F.when(F.col(of) > 0, 1 - F.col(bad) / F.col(of)).otherwise(1.0)
        return self.quality(name).select(
            "records", share("n_structural", "records").alias("schema_validity"), share("n_constraint", "records").alias("constraint_validity"), share("n_uniqueness", "records").alias("uniqueness"),
            F.lit(1 - broken / checked if checked else 1.0).alias("referential_integrity"), F.lit(sum(matches) / len(matches) if matches else 1.0).alias("distribution_match"), F.lit(written / answered if answered else 1.0).alias("llm_parse_success"),
        )

    def integrity(self, name: str) -> DataFrame | None:
        """(field, checked, broken, integrity) of each reference."""
        e, out = self.entities[name], None
        df = self.frame(name)
        for n, f in e.fields.items():
            if f.generator == "reference":
                r = validation.integrity(df, n, self.frame(self._target(f)), self._key_field(f)).select(F.lit(n).alias("field"), "*")
                out = r if out is None else out.union(r)
        return out

    def scenario_report(self, name: str) -> DataFrame:
        """(scenario, phase, records, subjects) of a simulated entity."""
        return simulation.scenario_report(self.frame(name, hidden=True))

    def schema_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.spec.raw, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def estimate(self) -> dict[str, Any]:
        """Work ahead: records, values, model calls and a rough size, by entity and in all."""
        by = {}
        for n in self.order:
            e = self.entities[n]
            calls = sum(f.generator == "llm" for f in e.fields.values()) * e.spec.count
            by[n] = {"records": e.spec.count, "fields": len(e.fields), "values": e.spec.count * len(e.fields), "calls": calls, "bytes": e.spec.count * (20 + 18 * len(e.fields)), "joins": sum(t != n and self._closure(t, a) is None for f in e.fields.values() for t, a, _ in self._wanted(e, f))}
        return {"entities": by, "order": self.order, "records": sum(x["records"] for x in by.values()), "values": sum(x["values"] for x in by.values()), "bytes": sum(x["bytes"] for x in by.values())}
