import random

import pytest
from brute import components

from contactloom.llm.groups import hash_to_min, read_groups
from contactloom.llm.neardup import contact_groups
from contactloom.runtime import Scratch

CONTACTS = "pair_no long, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string"


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min_against_brute_force(frame, spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)]
    edges += edges[:5] + [(5, None), (None, 6), (7, 7)]
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {r.vertex: r.root for r in hash_to_min(frame(edges, "a long, b long"), "a", "b", Scratch(spark, "t")).collect()}
    assert got == components(nodes, lambda a, b: (a, b) in linked)


def test_hot_vertex_is_spread(frame, spark):
    """A star of more rows than a hot key may have in one task."""
    got = hash_to_min(frame([(0, i) for i in range(1, 1500)], "a long, b long"), "a", "b", Scratch(spark, "t"))
    assert got.filter("root = 0").count() == 1500


def test_read_groups(frame):
    rows = [
        ("b", "a"), ("c", "x"), ("d", "x"), ("e", ""), ("f", "."), ("g", None), ("h", "gone"), (".", "a"), (None, "a"), ("", "a"),
        ("a", None), ("b", "a"), ("i", "i"), ("k", "l1"), ("l", "l2"), ("l1", "l2"),
    ]
    out = sorted(map(tuple, read_groups(frame([(r, p, 1) for r, p in rows], "readid string, parent_readid string, group_id int")).collect()))
    assert out == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("k", "k"), ("l", "k"), ("l1", "k")]
    assert read_groups(frame([], "readid string, parent_readid string")).count() == 0
    assert read_groups(frame([("a", None)], "readid string, parent_readid string")).count() == 0


def test_contact_groups_against_brute_force(frame):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        c = [rng.choice(["chr1", "chr1", "chr2", "!"]) for _ in range(2)]
        p = [rng.choice([rng.randrange(50), 1024 + rng.randrange(-6, 6), 65536 + rng.randrange(-4, 4)]) for _ in range(2)]
        s = [rng.choice("++-") for _ in range(2)]
        rows.append((1000 - i, c[0], p[0], s[0], c[1], p[1], s[1]))
    rows += [(5000 + i, "chr9", 77, "+", "chr9", 99, "-") for i in range(1200)] + [(7000, "chr9", 99, "-", "chr9", 77, "+")]
    odd = [(8000, None, 1, "+", "chr1", 1, "+"), (8001, "chr1", None, "+", "chr1", 1, "+"), (None, "chr1", 1, "+", "chr1", 1, "+")]

    def near(a, b):
        ends = lambda r: ((r[1], r[3], r[2]), (r[4], r[6], r[5]))
        (a1, a2), other = ends(a), ends(b)
        ok = lambda x, y: x[:2] == y[:2] and abs(x[2] - y[2]) <= 3
        return any(ok(a1, b1) and ok(a2, b2) for b1, b2 in (other, other[::-1]))

    mapped = [r for r in rows[:260] if "!" not in (r[1], r[4])]
    by = {r[0]: r for r in mapped}
    label = components(by, lambda a, b: near(by[a], by[b]))
    sizes = {v: list(label.values()).count(v) for v in label.values()}
    want = {k: v for k, v in label.items() if sizes[v] > 1} | {5000 + i: 5000 for i in range(1200)} | {7000: 5000}
    out = contact_groups(frame(rows + odd, CONTACTS)).collect()
    assert {r.pair_no: r.group_no for r in out} == want and len(out) == len(want)
    assert contact_groups(frame([], CONTACTS)).count() == 0
