"""Project specifications from YAML, JSON or a mapping. Unknown keys are errors, except that
unknown keys of a field are options of its generator."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from spindrift.functions.types import TYPES


class SpecError(ValueError):
    pass


# Keys that belong to a field itself.
FIELD_KEYS = {"type", "semantic", "description", "generator", "nullable", "null_probability", "unique", "primary_key", "constraints", "depends_on", "context", "examples", "privacy", "tone", "locale", "recipe", "transform"}
CONSTRAINT_KEYS = {"min", "max", "min_length", "max_length", "pattern", "enum", "forbidden", "multiple_of", "precision"}
PROFILES = ("quick_mock", "balanced", "high_realism", "maximum_chaos")
PROVENANCE = ("none", "run", "record", "field", "full")
DEFAULT_COUNT, DEFAULT_NULLS = 100, 0.05


@dataclass
class FieldSpec:
    name: str
    type: str | None = None
    generator: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    nullable: bool = False
    null_probability: float = 0.0
    unique: bool = False
    primary_key: bool = False
    constraints: dict[str, Any] = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)
    semantic: str | None = None
    description: str | None = None
    privacy: str | None = None
    transform: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, name: str, raw: Any) -> FieldSpec:
        raw = {"type": raw} if isinstance(raw, str) else dict(raw or {})
        options = {k: raw.pop(k) for k in list(raw) if k not in FIELD_KEYS and k not in CONSTRAINT_KEYS}
        constraints = dict(raw.get("constraints") or {})
        if extra := set(constraints) - CONSTRAINT_KEYS:
            raise SpecError(f"{name}: unknown constraints {sorted(extra)}")
        g = raw.get("generator")
        for k in CONSTRAINT_KEYS & set(raw):
            if (k, g) != ("pattern", "pattern"):  # what a pattern generator fills in is no expression to match
                constraints.setdefault(k, raw[k])
            options.setdefault(k, raw[k])
        kind = None
        if isinstance(g, str):
            kind = g
        elif isinstance(g, dict):
            g = dict(g)
            if "type" in g:
                kind = g.pop("type")
                options |= g
            elif len(g) == 1:
                (kind, more), = g.items()
                options |= more if isinstance(more, dict) else {"value": more, "values": more}
            else:
                raise SpecError(f"{name}: a generator needs a type")
        t = raw.get("type")
        if t is not None and t not in TYPES:
            raise SpecError(f"{name}: unknown type {t!r}")
        p = raw.get("null_probability")
        nullable = bool(raw.get("nullable", p is not None and p > 0))
        transform = raw.get("transform") or []
        return cls(
            name, t, kind, options, nullable, float(p) if p is not None else DEFAULT_NULLS if nullable else 0.0, bool(raw.get("unique")), bool(raw.get("primary_key")), constraints,
            list(raw.get("depends_on") or []), raw.get("semantic"), raw.get("description"), raw.get("privacy"), transform.split("|") if isinstance(transform, str) else list(transform),
        )


@dataclass
class EntitySpec:
    name: str
    count: int = DEFAULT_COUNT
    fields: dict[str, FieldSpec] = field(default_factory=dict)
    primary_key: str | None = None
    seed: int | None = None
    assertions: list[str] = field(default_factory=list)
    simulation: dict[str, Any] | None = None

    @classmethod
    def of(cls, name: str, raw: dict[str, Any]) -> EntitySpec:
        known = {"count", "fields", "primary_key", "seed", "assertions", "simulation", "description"}
        if extra := set(raw) - known:
            raise SpecError(f"{name}: unknown keys {sorted(extra)}")
        fields = {k: FieldSpec.of(k, v) for k, v in (raw.get("fields") or {}).items()}
        key = raw.get("primary_key") or next((f.name for f in fields.values() if f.primary_key), None)
        if key and key not in fields:
            raise SpecError(f"{name}: the primary key {key!r} isn't a field")
        sim = raw.get("simulation")
        if sim and (extra := set(sim) - {"subject", "distribution", "skew", "minimum", "state", "ordered"}):
            raise SpecError(f"{name}: unknown simulation keys {sorted(extra)}")
        assertions = [a if isinstance(a, str) else a.get("expression", a.get("assert")) for a in raw.get("assertions") or []]
        return cls(name, int(raw.get("count", DEFAULT_COUNT)), fields, key, raw.get("seed"), assertions, sim)


@dataclass
class ProjectSpec:
    name: str = "project"
    seed: int | str = 0
    profile: str = "balanced"
    provenance: str = "none"
    version: str = "1"
    entities: dict[str, EntitySpec] = field(default_factory=dict)
    relationships: list[dict[str, Any]] = field(default_factory=list)
    timeline: dict[str, Any] | None = None
    scenarios: dict[str, dict[str, Any]] = field(default_factory=dict)
    chaos: dict[str, Any] = field(default_factory=dict)
    patches: list[dict[str, Any]] = field(default_factory=list)
    outputs: dict[str, Any] = field(default_factory=dict)
    quality: dict[str, Any] = field(default_factory=dict)
    privacy: dict[str, Any] = field(default_factory=dict)
    providers: dict[str, Any] = field(default_factory=dict)
    edge_cases: float = 0.0
    edge_categories: list[str] | None = None
    edge_fields: list[str] | None = None
    raw: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any], folder: str | None = None) -> ProjectSpec:
        from spindrift.plans.recipes import expand

        raw = dict(expand(raw, folder))
        meta = raw.pop("project", {}) or {}
        meta = {"name": meta} if isinstance(meta, str) else dict(meta)
        for k in ("name", "seed", "profile", "provenance", "version", "locale"):
            if k in raw:
                meta.setdefault(k, raw.pop(k))
        known = {"entities", "relationships", "timeline", "scenarios", "chaos", "patches", "outputs", "quality", "privacy", "providers", "edge_cases", "recipes", "requires"}
        if extra := set(raw) - known:
            raise SpecError(f"unknown keys {sorted(extra)}")
        profile, provenance = meta.get("profile", "balanced"), meta.get("provenance", "none")
        if profile not in PROFILES or provenance not in PROVENANCE:
            raise SpecError(f"unknown profile or provenance: {profile!r}, {provenance!r}")
        chaos = raw.get("chaos") or {}
        chaos = {"preset": chaos} if isinstance(chaos, str) else dict(chaos)
        edges = raw.get("edge_cases") or 0
        chosen = edges if isinstance(edges, dict) else {}
        edges = float(edges.get("fraction", 0.05)) if isinstance(edges, dict) else float(edges)
        if profile == "maximum_chaos":
            chaos.setdefault("preset", "hostile_qa")
            edges = edges or 0.05
        scenarios = raw.get("scenarios") or {}
        scenarios = {s["name"]: s for s in scenarios} if isinstance(scenarios, list) else dict(scenarios)
        return cls(
            meta.get("name", "project"), meta.get("seed", 0), profile, provenance, str(meta.get("version", "1")), {k: EntitySpec.of(k, v or {}) for k, v in (raw.get("entities") or {}).items()},
            list(raw.get("relationships") or []), raw.get("timeline"), scenarios, chaos, list(raw.get("patches") or []), dict(raw.get("outputs") or {}), dict(raw.get("quality") or {}), dict(raw.get("privacy") or {}), dict(raw.get("providers") or {}), edges, chosen.get("categories"), chosen.get("fields"), raw,
        )


def load(path: str) -> ProjectSpec:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return ProjectSpec.of(json.loads(text), os.path.dirname(os.path.abspath(path)))
    import yaml

    return ProjectSpec.of(yaml.safe_load(text) or {}, os.path.dirname(os.path.abspath(path)))
