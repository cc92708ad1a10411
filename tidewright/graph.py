"""Order of tables along their references. Few nodes, so plain Python on the driver."""

from __future__ import annotations

from collections.abc import Iterable


def waves(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Nodes in waves: each after all that it depends on; edges are (node, what it depends on).

    A cycle is broken at its alphabetically first node. Loops and edges to unknown nodes don't count.
    """
    left = set(nodes)
    needs = {n: {p for c, p in edges if c == n and p in left and p != n} for n in left}
    out: list[list[str]] = []
    while left:
        ready = sorted(n for n in left if not needs[n] & left) or [min(left)]
        out.append(ready)
        left -= set(ready)
    return out


def topological(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    return [n for wave in waves(nodes, list(edges)) for n in wave]
