"""Advice on a project: (rule, place, severity, message)."""

from __future__ import annotations

from typing import NamedTuple

from spindrift.operators.chaos import rates
from spindrift.operators.generators import pattern_parts, weights_of
from spindrift.plans.compiler import Project


class Finding(NamedTuple):
    rule: str
    where: str
    severity: str
    message: str


def lint(p: Project) -> list[Finding]:
    out: list[Finding] = []
    add = lambda *a: out.append(Finding(*a))
    damage = rates(p.spec.chaos)
    used_providers, n_media, n_llm = set(), 0, 0
    for name, e in p.entities.items():
        if not e.spec.fields or e.spec.count == 0:
            add("empty-entity", name, "warning", "it has no fields or no records")
        if not e.spec.primary_key and e.spec.fields:
            add("no-primary-key", name, "info", "references need a key")
        for n, f in e.fields.items():
            at, o, s = f"{name}.{n}", f.options, f.spec
            if f.generator == "llm":
                n_llm += e.spec.count
                if not (s.semantic or s.description or o.get("prompt")):
                    add("llm-without-semantics", at, "warning", "the model isn't told what to write")
            if f.generator in ("image", "tts", "document"):
                n_media += e.spec.count
            if (prov := o.get("provider")) and f.generator in ("llm", "image", "tts"):
                used_providers.add(prov)
                if prov not in p.spec.providers and prov not in ("mock", "procedural"):
                    add("missing-provider", at, "error", f"provider {prov!r} isn't declared")
            if f.generator == "weighted":
                w = [x for _, x in weights_of(o.get("values") or o.get("choices") or o.get("weights") or o.get("options") or s.constraints.get("enum"))]
                if w and max(w) / max(sum(w), 1e-12) > 0.995 and len(w) > 1:
                    add("unrealistic-distribution", at, "info", "one value has nearly all the weight")
            if f.type == "text" and f.generator == "llm" and not s.constraints.get("max_length") and not o.get("max_tokens"):
                add("unbounded-text", at, "info", "there is no length limit")
            if s.unique and f.generator == "weighted" or s.unique and f.generator == "lookup":
                add("unique-exhaustion", at, "error", "fewer values than records")
            if s.unique and f.generator == "pattern":
                room = 1
                for alphabet, k in pattern_parts(str(o.get("pattern", o.get("format", "")))):
                    room *= len(alphabet) ** k if k else 1
                if room < e.spec.count:
                    add("unique-exhaustion", at, "error", f"{room} values for {e.spec.count} records")
            if s.null_probability > 0.5:
                add("mostly-null", at, "info", "more than half are null")
            if f.generator == "reference":
                target = p.entities[p._target(f)]
                if target.spec.name == name:
                    add("self-reference", at, "info", "record 0 has no parent")
                if target.spec.count == 0:
                    add("reference-to-empty-entity", at, "error", "there are no parents")
                if s.unique and e.spec.count > target.spec.count:
                    add("unique-reference-overflow", at, "error", "more children than parents")
                key = target.fields[p._key_field(f)]
                if key.spec.name != target.spec.primary_key and not key.spec.unique:
                    add("reference-to-nonunique-key", at, "warning", "the referred field isn't a key")
                if "distribution" not in o and "skew" not in o and e.spec.count > 20 * max(1, target.spec.count):
                    add("uniform-reference", at, "info", "all parents have about as many children")
    if n_media > 1000:
        add("bulk-media", "project", "warning", f"{n_media} media files")
    if n_llm > 10_000:
        add("bulk-llm", "project", "warning", f"{n_llm} model calls")
    for prov in set(p.spec.providers) - used_providers:
        add("unused-provider", prov, "info", "no field asks for it")
    if damage["referential_anomalies"] > 0:
        add("chaos-referential", "chaos", "info", "references will break on purpose")
    if p.spec.chaos.get("preset") == "absolute":
        add("chaos-absolute", "chaos", "warning", "most records will be damaged")
    return out
