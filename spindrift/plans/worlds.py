"""Worlds: a named seed, schema hash and populations in a JSON file, shared between projects."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from spindrift.plans.compiler import Project


class WorldConflict(ValueError):
    pass


@dataclass
class World:
    name: str
    seed: int | str
    schema: str = ""
    populations: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, project: Project, name: str) -> World:
        return cls(name, project.spec.seed, project.schema_hash(), {n: e.spec.count for n, e in project.entities.items()})

    def save(self, path: str) -> None:
        with open(path + ".partial", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
        os.replace(path + ".partial", path)

    @classmethod
    def load(cls, path: str) -> World:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def conflicts(self, project: Project) -> list[str]:
        out = [] if self.seed == project.spec.seed else [f"seed {project.spec.seed!r} is not {self.seed!r}"]
        out += [f"{n}: {project.entities[n].spec.count} records are not {k}" for n, k in self.populations.items() if n in project.entities and project.entities[n].spec.count != k]
        return out

    def check(self, project: Project) -> None:
        if found := self.conflicts(project):
            raise WorldConflict("; ".join(found))
