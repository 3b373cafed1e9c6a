"""Plug-ins: packages that add to the registries under a manifest that is checked both ways.

A plug-in is an object with `manifest` (a mapping: name, version, provides: category ->
names) and `register(host)`, found by the entry-point group GROUP or handed to `load`. What
it registers without having declared it is refused, what it declares and does not register
is missing; a built-in name is never replaced. A plug-in that raises is reported, the
others load."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from spindrift.functions import transforms
from spindrift.operators import enrichment, generators, simulation, validation
from spindrift.sources import files

GROUP = "spindrift.plugins"
#: The registry that each category adds to.
CATEGORIES: dict[str, dict[str, Any]] = {
    "generators": generators.GENERATORS,
    "validators": validation.VALIDATORS,
    "transforms": transforms.OPERATIONS,
    "outputs": files.WRITERS,
    "language_models": enrichment.LANGUAGE_MODELS,
    "images": enrichment.IMAGES,
    "speech": enrichment.SPEECH,
    "scenarios": simulation.SCENARIOS,
}


class PluginError(ValueError):
    pass


@dataclass
class Manifest:
    name: str
    version: str = "0"
    description: str = ""
    provides: dict[str, list[str]] = field(default_factory=dict)
    registered: list[tuple[str, str]] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    error: str = ""

    @classmethod
    def of(cls, raw: Any) -> Manifest:
        if not isinstance(raw, dict) or not raw.get("name"):
            raise PluginError("a manifest needs a name")
        provides = raw.get("provides") or {}
        if extra := set(provides) - set(CATEGORIES):
            raise PluginError(f"{raw['name']}: unknown categories {sorted(extra)}; known: {', '.join(CATEGORIES)}")
        return cls(str(raw["name"]), str(raw.get("version", "0")), str(raw.get("description", "")), {c: [n] if isinstance(n, str) else list(n) for c, n in provides.items()})

    @property
    def ok(self) -> bool:
        return not (self.refused or self.missing or self.error)


class Host:
    """What a plug-in registers with; one method for each category's contract."""

    def __init__(self, manifest: Manifest):
        self.manifest = manifest

    def _add(self, category: str, name: str, thing: Any) -> bool:
        m = self.manifest
        if name not in m.provides.get(category, []):
            m.refused.append(f"{category}: {name!r} is not in the manifest")
        elif name in CATEGORIES[category]:
            m.refused.append(f"{category}: {name!r} is there already")
        elif category != "scenarios" and not callable(thing) or category == "scenarios" and not isinstance(thing, dict):
            m.refused.append(f"{category}: {name!r} is not what the category takes")
        else:
            CATEGORIES[category][name] = thing
            m.registered.append((category, name))
            return True
        return False

    def generator(self, name: str, make: Callable) -> bool:
        """make(options, context) -> Column"""
        return self._add("generators", name, make)

    def validator(self, name: str, make: Callable) -> bool:
        """make(frame, options) -> list of Check"""
        return self._add("validators", name, make)

    def transform(self, name: str, make: Callable) -> bool:
        """make(column, type, argument) -> Column"""
        return self._add("transforms", name, make)

    def output(self, name: str, write: Callable) -> bool:
        """write(frame, path, mode, options)"""
        return self._add("outputs", name, write)

    def language_model(self, name: str, answer: Callable) -> bool:
        """answer(prompt, context, seed, most words), columns -> Column"""
        return self._add("language_models", name, answer)

    def image(self, name: str, draw: Callable) -> bool:
        """draw(seed, width, height), columns -> Column of bytes"""
        return self._add("images", name, draw)

    def speech(self, name: str, speak: Callable) -> bool:
        """speak(text, rate), columns -> Column of bytes"""
        return self._add("speech", name, speak)

    def scenario(self, name: str, spec: dict[str, Any]) -> bool:
        """A scenario that projects take up with `use: name`"""
        return self._add("scenarios", name, spec)


def load(plugins: Iterable[Any] | None = None) -> list[Manifest]:
    """The manifests of the plug-ins, after loading; without any given, of those installed."""
    out = []
    if plugins is None:
        from importlib.metadata import entry_points

        plugins = [lambda e=e: e.load() for e in entry_points(group=GROUP)]
    else:
        plugins = [lambda p=p: p for p in plugins]
    for get in plugins:
        manifest = Manifest("unknown")
        try:
            p = get()
            p = p() if isinstance(p, type) else p
            manifest = Manifest.of(p.manifest)
            p.register(Host(manifest))
        except Exception as e:  # a plug-in's own fault must not keep others from loading
            manifest.error = f"{type(e).__name__}: {e}"
        done = set(manifest.registered)
        manifest.missing = [f"{c}: {n}" for c, names in manifest.provides.items() for n in names if (c, n) not in done and not any(f"{c}: {n!r}" in r for r in manifest.refused)]
        out.append(manifest)
    return out


def unload(manifest: Manifest) -> None:
    for category, name in manifest.registered:
        CATEGORIES[category].pop(name, None)
    manifest.registered = []
