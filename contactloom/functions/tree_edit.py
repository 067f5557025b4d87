"""Edit scripts between nested schemas, by a constrained tree edit distance.

Trees are unordered. A node may only be matched with a node whose parent is matched with its
parent's match; then the children of two matched nodes are paired by a least-cost assignment, which
gives the distance in polynomial time. Afterwards a subtree deleted in one place and added unchanged
in another is one move."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Node:
    """identity: what the field is; written: how it is written; kind: its type."""

    identity: str
    kind: str = "struct"
    written: str = ""
    children: tuple["Node", ...] = field(default=())

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    """op: added, removed, renamed, retyped or moved; path: identities from the root's child down."""

    op: str
    path: tuple[str, ...]
    old: str | None = None
    new: str | None = None


def assignment(cost: np.ndarray) -> np.ndarray:
    """For a square cost matrix the column of each row in an assignment of least total cost, by
    shortest augmenting paths with potentials."""
    n = len(cost)
    row_pot, col_pot = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0] = i
        col, dist = 0, np.full(n + 1, np.inf)
        via, done = np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[col]:
            done[col] = True
            row = match[col]
            slack = cost[row - 1] - row_pot[row] - col_pot[1:]
            better = ~done[1:] & (slack < dist[1:])
            dist[1:][better] = slack[better]
            via[1:][better] = col
            following = 1 + int(np.argmin(np.where(done[1:], np.inf, dist[1:])))
            step = dist[following]
            row_pot[match[done]] += step
            col_pot[done] -= step
            dist[~done] -= step
            col = following
        while col:
            match[col] = match[via[col]]
            col = via[col]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


@lru_cache(maxsize=1 << 16)
def unlike(a: str, b: str) -> float:
    """Cost of taking b for a renamed a: 0 for names that differ in case and signs only, 4 for names without
    a common letter; names less than half alike cost more than a removal and an addition."""
    plain = ["".join(c for c in x.lower() if c.isalnum()) or x for x in (a, b)]
    return 4.0 * (1.0 - SequenceMatcher(None, *plain, autojunk=False).ratio())


class Differ:
    """rename_across: cost of matching nodes of different identity as one renamed node, a number or a
    function of both identities. With a dictionary of names, identities are certain, so by default such a
    match costs more than a removal and an addition and is never made; where names are only what is
    written, a function such as unlike lets the least-cost assignment decide what was renamed to what."""

    def __init__(self, rename_across: float | Callable[[str, str], float] = 3.0, rename: float = 1.0, retype: float = 1.0):
        self.rename_across, self.rename, self.retype = rename_across, rename, retype

    def distance(self, a: Node, b: Node) -> float:
        return self._label(a, b) + self._pair(a.children, b.children)[0]

    def _label(self, a: Node, b: Node) -> float:
        if a.identity == b.identity:
            across = self.rename * (a.written != b.written)
        else:
            across = self.rename_across(a.identity, b.identity) if callable(self.rename_across) else self.rename_across
        return across + self.retype * (a.kind != b.kind)

    def _pair(self, old: tuple[Node, ...], new: tuple[Node, ...]):
        """Least cost of turning old into new, and the pairs (i, j) kept. Where matching across
        identities cannot pay, nodes of equal identity are paired at once."""
        pairs: list[tuple[int, int]] = []
        cost = 0.0
        rest_old, rest_new = list(range(len(old))), list(range(len(new)))
        if not callable(self.rename_across) and self.rename_across >= 2:
            at: dict[str, list[int]] = {}
            for j in rest_new:
                at.setdefault(new[j].identity, []).append(j)
            certain = {k: v[0] for k, v in at.items() if len(v) == 1 and sum(o.identity == k for o in old) == 1}
            for i in list(rest_old):
                if (j := certain.get(old[i].identity)) is not None:
                    d = self.distance(old[i], new[j])
                    if d <= old[i].size() + new[j].size():
                        pairs.append((i, j))
                        cost += d
                        rest_old.remove(i)
                        rest_new.remove(j)
        n, m = len(rest_old), len(rest_new)
        if n and m:
            table = np.zeros((n + m, n + m))
            for x, i in enumerate(rest_old):
                for y, j in enumerate(rest_new):
                    table[x, y] = self.distance(old[i], new[j])
                table[x, m:] = old[i].size()
            for y, j in enumerate(rest_new):
                table[n:, y] = new[j].size()
            chosen = assignment(table)
            cost += float(table[np.arange(n + m), chosen].sum())
            pairs += [(rest_old[x], rest_new[chosen[x]]) for x in range(n) if chosen[x] < m]
        else:
            cost += sum(old[i].size() for i in rest_old) + sum(new[j].size() for j in rest_new)
        return cost, pairs

    def script(self, old: Node, new: Node) -> list[Edit]:
        removed: list[tuple[tuple[str, ...], Node]] = []
        added: list[tuple[tuple[str, ...], Node]] = []
        out: list[Edit] = []
        self._walk(old, new, (), out, removed, added)
        for path, node in list(removed):
            for other in added:
                if other[1] == node and other[0][:-1] != path[:-1]:
                    out.append(Edit("moved", other[0], "/".join(path), "/".join(other[0])))
                    removed.remove((path, node))
                    added.remove(other)
                    break
        out += [Edit("removed", p, n.written, None) for p, n in removed]
        out += [Edit("added", p, None, n.written) for p, n in added]
        return out

    def _walk(self, a: Node, b: Node, path: tuple[str, ...], out, removed, added) -> None:
        _, pairs = self._pair(a.children, b.children)
        kept_a, kept_b = {i for i, _ in pairs}, {j for _, j in pairs}
        for i, j in pairs:
            x, y = a.children[i], b.children[j]
            at = (*path, y.identity)
            if x.identity != y.identity or x.written != y.written:
                out.append(Edit("renamed", at, x.written, y.written))
            if x.kind != y.kind:
                out.append(Edit("retyped", at, x.kind, y.kind))
            self._walk(x, y, at, out, removed, added)
        removed += [((*path, x.identity), x) for i, x in enumerate(a.children) if i not in kept_a]
        added += [((*path, y.identity), y) for j, y in enumerate(b.children) if j not in kept_b]


def from_spark_type(name: str, kind) -> Node:
    """The tree of a Spark type; arrays and maps are nodes with their element, key and value below."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return Node(name, "struct", name, tuple(from_spark_type(f.name, f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return Node(name, "array", name, (from_spark_type("element", kind.elementType),))
    if isinstance(kind, T.MapType):
        return Node(name, "map", name, (from_spark_type("key", kind.keyType), from_spark_type("value", kind.valueType)))
    return Node(name, kind.simpleString(), name)
