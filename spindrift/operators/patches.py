"""Patch rules: filters and edits over any DataFrame, in authored order.

A rule has `where`, and either `set` (edits) or `drop`/`keep` (filters). An edit is a
transform pipeline if every step between bars is one, else an expression; anything but
text is a literal. Edits of a rule see those before them; dropped rows skip later rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spindrift.functions import transforms as tf
from spindrift.functions.expressions import columns_of, condition, Translator


class PatchError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    where: str | None = None
    set: dict[str, Any] = field(default_factory=dict)
    drop: bool = False
    keep: bool = False
    entity: str | None = None
    name: str = ""

    def __post_init__(self):
        if self.drop and self.keep:
            raise PatchError(f"rule {self.name or '?'}: drop and keep exclude each other")
        if (self.drop or self.keep) and self.set:
            raise PatchError(f"rule {self.name or '?'}: a filter can't set fields")
        if not (self.drop or self.keep or self.set):
            raise PatchError(f"rule {self.name or '?'}: nothing to do")
        if (self.drop or self.keep) and not self.where:
            raise PatchError(f"rule {self.name or '?'}: a filter needs a condition")

    @classmethod
    def of(cls, spec: dict[str, Any], number: int = 0) -> Rule:
        spec = dict(spec)
        drop, keep = spec.pop("drop", False), spec.pop("keep", False)
        where = spec.pop("where", None) or (drop if isinstance(drop, str) else keep if isinstance(keep, str) else None)
        known = {"set", "entity", "name"}
        if extra := set(spec) - known:
            raise PatchError(f"rule {number}: unknown keys {sorted(extra)}")
        return cls(where, dict(spec.get("set") or {}), bool(drop), bool(keep), spec.get("entity"), spec.get("name") or f"rule {number}")


def edited(df: DataFrame, name: str, value: Any, where: str = "") -> Column:
    """The new value of a field by one of the three spellings."""
    schema = df.schema
    if isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value) and all(tf.is_pipeline(v) for v in value):
        value = "|".join(value)
    if isinstance(value, str):
        if tf.is_pipeline(value):
            if name not in df.columns:
                raise PatchError(f"{where}: {name!r} isn't a field to transform")
            col, _ = tf.apply(F.col(f"`{name}`"), schema[name].dataType, value.split("|"))
            return col
        return Translator(columns_of(schema), None, where or name).value(value).col
    return F.lit(value) if not isinstance(value, (dict, list, tuple)) else F.from_json(F.lit(json.dumps(value)), schema[name].dataType)


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    cond = condition(rule.where, df.schema, rule.name) if rule.where else F.lit(True)
    if rule.drop:
        return df.where(~cond)
    if rule.keep:
        return df.where(cond)
    hit = "__hit"
    while hit in df.columns:
        hit += "_"
    # the condition is of the row as the rule found it, whatever its edits change
    out = df.withColumn(hit, cond) if len(rule.set) > 1 and rule.where else df
    test = F.col(hit) if hit in out.columns else cond
    for name, value in rule.set.items():
        new = edited(out.drop(hit), name, value, rule.name)
        if rule.where:
            old = F.col(f"`{name}`") if name in df.columns or name in out.columns else F.lit(None)
            new = F.when(test, new).otherwise(old)
        out = out.withColumn(name, new)
    return out.drop(hit)


def apply(df: DataFrame, rules: Iterable[Rule | dict[str, Any]], entity: str | None = None) -> DataFrame:
    for i, r in enumerate(rules, 1):
        r = r if isinstance(r, Rule) else Rule.of(r, i)
        if entity is None or r.entity in (None, entity):
            df = apply_rule(df, r)
    return df


def apply_counted(df: DataFrame, rules: Iterable[Rule | dict[str, Any]]) -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """As apply, with an observation for each rule: rows seen and rows hit, known after any action."""
    seen = []
    for i, r in enumerate(rules, 1):
        r = r if isinstance(r, Rule) else Rule.of(r, i)
        o = Observation(f"patch-{i}-{id(df)}")
        hit = condition(r.where, df.schema, r.name) if r.where else F.lit(True)
        df = apply_rule(df.observe(o, F.count(F.lit(1)).alias("seen"), F.count_if(hit).alias("hit")), r)
        seen.append((r.name, o))
    return df, seen
