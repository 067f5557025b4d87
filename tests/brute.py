"""Slow but plain versions of operators, for tests."""

from __future__ import annotations


def components(nodes, linked):
    """{node: least node of its component} for a test of whether two nodes are linked."""
    nodes = sorted(nodes)
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}
