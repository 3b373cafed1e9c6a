"""Dependency order: topological with ties in declaration order, as layers, with cycles named."""

from __future__ import annotations


class CycleError(ValueError):
    pass


def layers(nodes: list[str], needs: dict[str, set[str]]) -> list[list[str]]:
    """Nodes whose needs are met by the layers before them; unknown needs are ignored."""
    known, done, out = set(nodes), set(), []
    left = list(nodes)
    while left:
        ready = [n for n in left if (needs.get(n, set()) & known) <= done]
        if not ready:
            raise CycleError("dependency cycle: " + " -> ".join(_cycle(left, needs)))
        out.append(ready)
        done |= set(ready)
        left = [n for n in left if n not in done]
    return out


def _cycle(nodes: list[str], needs: dict[str, set[str]]) -> list[str]:
    path, at = [], nodes[0]
    while at not in path:
        path.append(at)
        at = next(n for n in nodes if n in needs.get(at, set()))
    return [*path[path.index(at) :], at]


def order(nodes: list[str], needs: dict[str, set[str]]) -> list[str]:
    return [n for layer in layers(nodes, needs) for n in layer]
