from datetime import datetime

import pytest

from contactloom.functions.tree_edit import Edit
from contactloom.operators.bad_rows import LineCheck
from contactloom.operators.schema_drift import compile_script, unify

EIGHT = "readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type"
GOOD = "q9\tchr1\t5\tchr2\t7\t+\t-\tUU"


@pytest.fixture
def check(frame):
    files = [(1, "mapq1 a b c", "b:int c:int"), (2, "mq1 a b", "mq1:float b:int"), (3, "b c", "c:str;b:int"), (4, "a a", None)]
    headers = frame(
        [(i, "s", f"#columns: {EIGHT} {more}", casts, "none", datetime(2024, 1, i), None) for i, more, casts in files],
        "file_id long, series string, columns_line string, type_casts string, quoting string, created_at timestamp, received_at timestamp",
    )
    names = frame([("mq1", "mapq1"), ("mapq1", "mapq1")], "written_as string, field_name string")
    lines = [(1, 1, f"{GOOD}\t07\t5\t9\t12"), (2, 1, f"{GOOD}\t1.50\tx\t-3"), (3, 1, f"{GOOD}\t4\tz"), (3, 2, f"{GOOD}\tno\tz"), (2, 2, GOOD), (4, 1, f"{GOOD}\tu\tv")]
    sizes = frame([("chr1", 100, 1), ("chr2", 50, 2)], "chrom string, chrom_len long, chrom_rank int")
    return LineCheck(frame(lines, "file_id long, line_no int, line_text string"), headers, names, sizes)


def rows(df):
    return {(r.file_id, r.line_no): (r.ints, r.floats, r.texts) for r in df.collect()}


def test_unified_values_have_one_type_for_each_field(check):
    out = unify(check.clean(), check.files)
    assert rows(out) == {
        (1, 1): ({"b": 9}, {"mapq1": 7.0}, {"a": "5", "c": "12"}), (2, 1): ({"b": -3}, {"mapq1": 1.5}, {"a": "x"}),
        (3, 1): ({"b": 4}, {}, {"c": "z"}), (2, 2): ({}, {}, {}), (4, 1): ({}, {}, {"a": "u"}),
    }
    first = out.filter("file_id = 1").first()
    assert (first.pos1, first.extras) == (5, {"mapq1": "07", "a": "5", "b": "9", "c": "12"})


def test_valid_rows_have_the_types_of_their_file(check):
    out = check.rows()
    assert rows(out) == {
        (1, 1): ({"mapq1": 7, "b": 9, "c": 12}, {}, {"a": "5"}), (2, 1): ({"b": -3}, {"mapq1": 1.5}, {"a": "x"}),
        (3, 1): ({"b": 4}, {}, {"c": "z"}), (2, 2): ({}, {}, {}), (4, 1): ({}, {}, {"a": "u"}),
    }
    assert {r.readid for r in out.collect()} == {"q9"}


def test_edit_scripts_are_compiled_to_projections():
    fields = [dict(idx=i, field=f, written=w, type=t) for i, (f, w, t) in enumerate([("a", "A", "int"), ("b", "b", "int"), ("c", "c", "str"), ("b", "b", "int")])]
    script = [Edit("renamed", ("a",), "A", "a"), Edit("retyped", ("b",), "int", "float"), Edit("removed", ("c",), "c"), Edit("added", ("d",), None, "d")]
    assert compile_script(script, fields) == [(0, "a", "A", "int"), (1, "b", "b", "float")]
    assert compile_script([], fields) == [(0, "a", "A", "int"), (1, "b", "b", "int"), (2, "c", "c", "str")]


def test_the_table_follows_the_scripts(check, monkeypatch):
    """With scripts that remove everything but the read name, nothing else is read."""
    from contactloom.functions import tree_edit
    from contactloom.operators import schema_drift
    from contactloom.runtime import Scratch

    fields = schema_drift.projections(check.files, Scratch(check.files.sparkSession, "t")).filter("file_id = 2").first().fields
    assert [(f.field, f.written, f.type) for f in fields][8:] == [("mapq1", "mq1", "float"), ("a", "a", "str"), ("b", "b", "int")]
    monkeypatch.setattr(tree_edit.Differ, "script", lambda self, a, b: [Edit("removed", (c.identity,), c.written) for c in a.children if c.identity != "readID"])
    batch = schema_drift.pa.RecordBatch.from_pylist([{"file_id": 1, "fields": [dict(f.asDict(), unified=f.type) for f in fields]}])
    assert [[s["field"] for s in r["fields"]] for r in next(schema_drift._projections([batch])).to_pylist()] == [["readID"]]


def test_renamed_fields_without_a_dictionary(frame):
    from contactloom.operators.schema_drift import schema_changes

    rows = [
        (1, "s", 1, "#columns: readID chrom1 pos1 mapq1 mapq2 walk_pair_index", None), (2, "s", 2, "#columns: read_id chrom1 POS_1 mapq_2 mapq_1 cigar1", "POS_1:int"),
        (3, "t", 1, "#columns: alpha beta", None), (4, "t", 2, "#columns: zzz beta", None),
    ]
    headers = frame(
        [(i, s, at, at, line, casts, "none") for i, s, at, line, casts in rows],
        "file_id long, series string, created_at int, received_at int, columns_line string, type_casts string, quoting string",
    )
    got = sorted((r.file_id, r.change_kind, r.old, r.new) for r in schema_changes(headers, None).collect() if r.change_kind != "retyped")
    assert got == [
        (2, "added", None, "cigar1"), (2, "removed", "walk_pair_index", None), (2, "renamed", "mapq1", "mapq_1"), (2, "renamed", "mapq2", "mapq_2"),
        (2, "renamed", "pos1", "POS_1"), (2, "renamed", "readID", "read_id"), (4, "added", None, "zzz"), (4, "removed", "alpha", None),
    ]
