import itertools
import random

import pytest
from pyspark.sql import functions as F

from contactloom.functions.tree_edit import Differ, Edit, Node, assignment, from_spark_type
from contactloom.operators.bad_rows import LineCheck
from contactloom.operators.components import contract
from contactloom.operators.frequency import ValueFrequencies
from contactloom.operators.hierarchy import descendants, hierarchy
from contactloom.operators.schema_drift import schema_changes, unify
from contactloom.runtime import Scratch, join_unique, lag_over_ranges

HEADERS = (
    "file_id long, file_name string, series string, genome_assembly string, shape string, columns_line string, type_casts string, "
    "quoting string, created_at timestamp, received_at timestamp"
)
EIGHT = "readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type"


@pytest.fixture
def headers(frame, spark):
    def make(*rows):
        """rows: (file_id, series, day, columns, casts, quoting)"""
        from datetime import datetime

        full = [(i, "f", s, None, "", c, t, q, datetime(2024, 1, d), None) for i, s, d, c, t, q in rows]
        return frame(full, HEADERS)

    return make


@pytest.fixture
def names(frame):
    rows = [("chr1", "chrom1"), ("chrom1", "chrom1"), ("mq1", "mapq1"), ("mapq1", "mapq1")]
    return frame(rows, "written_as string, field_name string")


# --- schema drift --------------------------------------------------------------------------------


def test_changes_of_a_series(headers, names):
    df = headers(
        (1, "s", 1, f"#columns: {EIGHT} mapq1", None, "none"), (2, "s", 2, f"#columns:{EIGHT.replace('chrom1', 'chr1')} mq1 x", "mq1:float", "none"),
        (3, "s", 3, None, None, "none"), (3, "s", 3, None, None, "none"), (4, "t", 1, "", "", "none"), (5, "s", 4, f"#columns: {EIGHT[::1]}", "chr1:int", "none"),
        (6, None, 1, f"#columns: {EIGHT} y", None, "none"), (7, None, 2, f"#columns: {EIGHT}", None, "none"), (None, "s", 9, "z", None, "none"),
    )
    got = sorted((r.file_id, r.field_name, r.change_kind) for r in schema_changes(df, names).collect())
    assert got == [
        (2, "chrom1", "renamed"), (2, "mapq1", "renamed"), (2, "mapq1", "retyped"), (2, "x", "added"),
        (3, "chrom1", "renamed"), (3, "mapq1", "removed"), (3, "x", "removed"), (5, "chrom1", "retyped"), (7, "y", "removed"),
    ]


def test_changes_of_no_files(headers, names, frame):
    assert schema_changes(frame([], HEADERS), names).count() == 0


def test_lag_over_ranges_is_lag(frame, spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i) for i in range(300)]
    out = lag_over_ranges(frame(rows, "p string, o long"), ["p"], ["o"], ["o"], Scratch(spark, "t")).collect()
    before: dict = {}
    want = {}
    for p, o in rows:
        want[o] = before.get(p)
        before[p] = o
    assert {r.o: r.prev_o for r in out} == want and all(r.has_prev == (r.prev_o is not None) for r in out)


def brute_distance(a, b, differ):
    """Least cost over all matchings of children."""
    best = None
    size = max(len(a.children), len(b.children))
    for perm in itertools.permutations(range(size)):
        cost = 0
        for i, j in enumerate(perm):
            if i < len(a.children) and j < len(b.children):
                x, y = a.children[i], b.children[j]
                cost += min(differ._label(x, y) + brute_distance(x, y, differ), x.size() + y.size())
            elif i < len(a.children):
                cost += a.children[i].size()
            elif j < len(b.children):
                cost += b.children[j].size()
        best = cost if best is None else min(best, cost)
    return best or 0


@pytest.mark.parametrize("across", [1.0, 3.0])
def test_tree_distance_against_brute_force(across):
    rng = random.Random(7)
    differ = Differ(rename_across=across)

    def tree(depth):
        kids = [] if depth == 0 else [tree(depth - 1) for _ in range(rng.randrange(4))]
        unique = {k.identity: k for k in kids}
        return Node(rng.choice("abcde"), rng.choice(["int", "str"]), rng.choice("xy"), tuple(unique.values()))

    for _ in range(60):
        a, b = tree(2), tree(2)
        assert differ._pair(a.children, b.children)[0] == pytest.approx(brute_distance(a, b, differ))


def test_assignment_is_least():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in range(1, 6):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, n)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert cost[np.arange(n), assignment(cost)].sum() == best


def test_script_with_moves_and_renames():
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    old = StructType([StructField("a", LongType()), StructField("m", StructType([StructField("x", StringType()), StructField("y", LongType())]))])
    new = StructType([StructField("a", StringType()), StructField("m", StructType([StructField("y", LongType())])), StructField("x", StringType())])
    script = Differ().script(from_spark_type("", old), from_spark_type("", new))
    assert set(script) == {Edit("retyped", ("a",), "bigint", "string"), Edit("moved", ("x",), "m/x", "x")}
    fuzzy = Differ(rename_across=1.0).script(Node("", children=(Node("u", "int", "u"),)), Node("", children=(Node("v", "int", "v"),)))
    assert fuzzy == [Edit("renamed", ("v",), "u", "v")]


# --- bad rows ------------------------------------------------------------------------------------

GOOD = "q9\tchr1\t5\tchr2\t7\t+\t-\tUU"


def check(frame, headers, names, lines, columns=None, casts=None, quoting="none"):
    sizes = frame([("chr1", 100, 1), ("chr2", 50, 2), ("a\tb", 9, 3)], "chrom string, chrom_len long, chrom_rank int")
    df = frame([(1, i, t) for i, t in enumerate(lines)], "file_id long, line_no int, line_text string")
    return LineCheck(df, headers((1, "s", 1, columns, casts, quoting)), names, sizes)


CASES = {
    GOOD: None, "": "field_count", None: "field_count", GOOD + "\tx": "field_count", GOOD[:-3]: "field_count", GOOD.replace("q9", ""): "bad_value",
    GOOD.replace("chr1", "chr3"): "bad_value", GOOD.replace("\t5\t", "\t101\t"): "bad_value", GOOD.replace("\t5\t", "\t0\t"): "bad_value",
    GOOD.replace("chr1\t5", "!\t0"): None, GOOD.replace("chr1\t5", "!\t5"): "bad_value", GOOD.replace("\t5\t", "\t" + "0" * 17 + "5\t"): None,
    GOOD.replace("\t5\t", "\t" + "0" * 18 + "5\t"): "bad_value", GOOD.replace("\t+\t", "\t*\t"): "bad_value", GOOD.replace("UU", "UA"): "bad_value",
    GOOD.replace("UU", "DD"): None, GOOD.replace("q9", '"r1'): None, GOOD.replace("\t5\t", "\t5 \t"): "bad_value", GOOD + "\n": "bad_value",
}


def test_lines_without_quoting(frame, headers, names):
    lines = list(CASES)
    out = {r.line_no: r.reason for r in check(frame, headers, names, lines).errors().collect()}
    assert [out.get(i) for i in range(len(lines))] == list(CASES.values())


def test_quoting(frame, headers, names):
    cases = {
        GOOD: None, GOOD.replace("q9", '"r1'): "broken_quoting", GOOD.replace("q9", '"r""1"'): None, GOOD.replace("q9", '"r1"x'): "broken_quoting",
        GOOD.replace("q9", 'r"1"'): None, GOOD.replace("q9", '"a\tb"'): None, GOOD.replace("chr1", '"chr1"'): None, GOOD.replace("q9", '""'): "bad_value",
        GOOD.replace("chr1", '"a\tb"'): None, GOOD.replace("UU", '"UU'): "broken_quoting", "\t" + GOOD: "field_count", GOOD.replace("q9", '"' + "x\t" * 50_000 + '"'): None,
    }
    lines = list(cases)
    c = check(frame, headers, names, lines, quoting="double")
    out = {r.line_no: r.reason for r in c.errors().collect()}
    assert [out.get(i) for i in range(len(lines))] == list(cases.values())
    clean = {r.line_no: r.cells for r in c.clean().collect()}
    assert clean[2][0] == 'r"1' and clean[4][0] == 'r"1"' and clean[8][1] == "a\tb" and set(clean) == {i for i, v in enumerate(cases.values()) if v is None}


def test_typed_extra_fields_and_other_orders(frame, headers, names):
    columns = "#columns: mq1 pair_type readID chr1 pos1 chrom2 pos2 strand1 strand2 f"
    line = "{}\tUU\tr\tchr1\t5\tchr2\t7\t+\t-{}"
    cases = {line.format("-3", ""): None, line.format("x", ""): "bad_value", line.format("3", "\t1.5"): None, line.format("3", "\t.5"): "bad_value", line.format("3", "\t-2"): None, line.format("", "\t1"): "bad_value"}
    c = check(frame, headers, names, list(cases), columns, "f:float;pos1:str")
    out = {r.line_no: r.reason for r in c.errors().collect()}
    assert [out.get(i) for i in range(len(cases))] == list(cases.values())
    table = {r.line_no: r for r in unify(c.clean(), c.files).collect()}
    assert (table[2].readid, table[2].chrom1, table[2].pos1, table[2].extras) == ("r", "chr1", 5, {"mapq1": "3", "f": "1.5"})
    assert table[0].extras == {"mapq1": "-3"}


def test_repeated_lines_come_once_and_unknown_files_are_held_to_the_standard(frame, headers, names):
    c = check(frame, headers, names, [GOOD, "x"])
    c2 = LineCheck(
        frame([(1, 1, "x"), (1, 1, "x"), (9, 1, GOOD), (9, 2, "y"), (None, 1, "x"), (9, 1, GOOD)], "file_id long, line_no int, line_text string"),
        headers((1, "s", 1, None, None, None)), names, frame([("chr1", 100, 1), ("chr2", 50, 2)], "chrom string, chrom_len long, chrom_rank int"),
    )
    assert sorted(map(tuple, c2.errors().collect())) == [(1, 1, "field_count"), (9, 2, "field_count")]
    assert c2.clean().count() == 1 and c.clean().count() == 1


# --- hierarchy -----------------------------------------------------------------------------------


def brute_tree(rows):
    ids = {(f, i) for f, i, _ in rows if i}
    parent = {}
    for f, i, p in rows:
        if i:
            parent[f, i] = min(x for x in (parent.get((f, i)), p or None) if x) if (parent.get((f, i)) or p) else None
    out = {}
    for f, i in ids:
        path, at = [i], i
        while (p := parent[f, at]) and (f, p) in ids and len(path) <= len(ids):
            path.insert(0, p)
            at = p
        out[f, i] = None if len(path) > len(ids) else path
    return out


def test_hierarchies_against_brute_force(frame):
    rng = random.Random(11)
    rows = [(f, f"n{i}", rng.choice([f"n{rng.randrange(30)}", f"n{max(0, i - 1)}", None, "", "gone"])) for f in range(6) for i in range(30)]
    rows += [(9, f"c{i}", f"c{i - 1}") for i in range(60)] + rows[:5] + [(1, None, "n1"), (1, "", "n1"), (None, "n1", None), (7, "self", "self")]
    want = brute_tree([r for r in rows if r[0] is not None])
    tree = hierarchy(frame(rows, "f long, id string, pp string"), ["f"], "id", "pp")
    got = {(r.f, r.node): (r.root, r.depth, r.path) for r in tree.collect()}
    assert got == {k: (p[0], len(p) - 1, p) if p else (None, -1, []) for k, p in want.items()}
    below = descendants(tree, ["f"])
    assert below.count() == sum(len(p) - 1 for p in want.values() if p)
    assert below.filter("f = 9 and ancestor = 'c0'").agg(F.max("distance")).first()[0] == 59


def test_hierarchy_of_nothing(frame):
    assert hierarchy(frame([], "f long, id string, pp string"), ["f"], "id", "pp").count() == 0


# --- skew ----------------------------------------------------------------------------------------


def test_frequencies_against_brute_force(frame):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice([rng.randrange(-50, 50), rng.randrange(10**9), None, 7])) for _ in range(600)] + [(None, 3), ("nulls", None)]
    v = ValueFrequencies(frame(rows, "k string, v long"), ["k"], F.col("v"))
    by: dict = {}
    for k, x in rows:
        by.setdefault(k, []).append(x)
    mode = lambda xs: min(set(xs), key=lambda x: (-xs.count(x), x)) if xs else None
    want = {k: (len(xs), len([x for x in xs if x is not None]), len({x for x in xs if x is not None}), mode([x for x in xs if x is not None])) for k, xs in by.items()}
    assert {r.k: (r.n, r.n_values, r.n_distinct, r.mode) for r in v.summary().collect()} == want
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.share): r.percentile for r in v.percentiles(shares).collect()}
    import math

    for k, xs in by.items():
        xs = sorted(x for x in xs if x is not None)
        for s in shares:
            assert got.get((k, s)) == (xs[max(0, math.ceil(s * len(xs)) - 1)] if xs else None)
    assert sorted(r.k for r in v.shares_above(0.5).collect()) == ["hot"]


def test_frequencies_of_text_and_nothing(frame):
    v = ValueFrequencies(frame([("a", "x"), ("a", "y"), ("a", "y"), ("b", None)], "k string, v string"), ["k"], F.col("v"))
    assert {r.k: r.mode for r in v.summary().collect()} == {"a": "y", "b": None}
    empty = ValueFrequencies(frame([], "k string, v long"), ["k"], F.col("v"))
    assert empty.summary().count() == 0 and empty.percentiles([0.5]).count() == 0 and empty.shares_above(0.1).count() == 0


def test_join_with_hot_keys_is_a_join(frame):
    left = frame([("h", i) for i in range(3000)] + [("x", 1), (None, 2), ("y", 3)], "k string, n long")
    right = frame([("h", "H"), ("x", "X")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, join_unique(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_components(frame, spark):
    from brute import components

    rng = random.Random(9)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(60)} | {(100 + i, 101 + i) for i in range(50)}
    linked = edges | {(b, a) for a, b in edges}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = components(nodes, lambda a, b: (a, b) in linked)
    got = {r.vertex: r.root for r in contract(frame(list(edges), "a long, b long"), Scratch(spark, "t")).collect()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert groups(got) == groups(want)
    assert contract(frame([], "a long, b long"), Scratch(spark, "t")).count() == 0
