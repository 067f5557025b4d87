"""Header schemas that drift between the files of a series: one set of fields, and every change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.tree_edit import Differ, Edit, Node, unlike
from contactloom.runtime import Scratch, join_unique, lag_over_ranges
from contactloom.schema import PAIRS_COLUMNS, POSITION_COLUMNS

#: Rows of the name dictionary, and files whose schemas are broadcast.
NAMES_LIMIT, FILES_LIMIT = 100_000, 20_000
FIELD = "idx int, field string, written string, type string"


def file_schemas(headers: DataFrame, field_names: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_id, series, created_at, quoting, fields) once for each file, fields being an array of
    (idx, field, written, type) in the header's order.

    columns_line is '#columns:' and names separated by white space; null or empty means the eight
    pairs columns. A name is the field that field_names gives, else a field of its own name. A field
    without an entry in type_casts is int if it is a position or a mapping quality, else str; of
    several entries the last counts. Repeated rows count once; of different rows for one file_id the
    least by created_at, received_at and text; rows without file_id are left out."""
    row = F.struct("created_at", "received_at", "series", "columns_line", "type_casts", "quoting")
    files = headers.filter("file_id is not null").groupBy("file_id").agg(F.min(row).alias("r")).select("file_id", "r.*")
    files = scratch.write(files)
    names = field_names.select("written_as", "field_name").filter("written_as is not null").dropDuplicates(["written_as"])
    dictionary = F.broadcast(names) if names.count() <= NAMES_LIMIT else None

    def as_field(df: DataFrame, written: str) -> DataFrame:
        df = df.withColumn("written_as", F.col(written))
        out = df.join(dictionary, "written_as", "left") if dictionary is not None else join_unique(df, names, ["written_as"], "left")
        return out.withColumn("field", F.coalesce("field_name", written)).drop("written_as", "field_name")

    listed = F.filter(F.split(F.regexp_replace("columns_line", r"^\s*#columns:", ""), r"\s+"), lambda x: x != "")
    standard = F.array(*[F.lit(c) for c in PAIRS_COLUMNS])
    columns = F.when(F.size(listed) > 0, listed).otherwise(standard)
    cells = as_field(files.select("file_id", F.posexplode(columns).alias("idx", "written")), "written")
    token = files.select("file_id", F.posexplode(F.split("type_casts", "[ ,;]+")).alias("at", "token")).filter(F.col("token").contains(":"))
    entries = token.select(
        "file_id", "at", F.regexp_extract("token", "^(.*):([^:]*)$", 1).alias("name"), F.regexp_extract("token", "^(.*):([^:]*)$", 2).alias("type")
    )
    types = as_field(entries, "name").groupBy("file_id", "field").agg(F.max_by("type", "at").alias("type"))
    default = F.when(F.col("field").isin(*POSITION_COLUMNS, "mapq1", "mapq2"), "int").otherwise("str")
    typed = cells.join(types, ["file_id", "field"], "left").withColumn("type", F.coalesce("type", default))
    fields = typed.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "field", "written", "type"))).alias("fields"))
    return files.select("file_id", "series", "created_at", "quoting").join(fields, "file_id")


def schema_tree(fields: list[dict]) -> Node:
    """Of fields given twice in a header the first counts."""
    first: dict[str, Node] = {}
    for f in fields:
        first.setdefault(f["field"], Node(f["field"], f["type"], f["written"]))
    return Node("", children=tuple(first.values()))


def _scripts(known: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ() if known else Differ(unlike)
        for batch in batches:
            rows = []
            for file_id, old, new in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for e in differ.script(schema_tree(old), schema_tree(new)):
                    rows.append((file_id, e.path[-1], e.op, e.old, e.new))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file_id", "field_name", "change_kind", "old", "new"]
            )

    return run


def schema_changes(headers: DataFrame, field_names: DataFrame | None) -> DataFrame:
    """(file_id, field_name, change_kind, old, new): the least-cost edit script that turns the schema
    of the file before it in its series, by created_at, into a file's own. The first file of a series
    has no changes, the order of columns is no change. Files without series form one series.
    Without field_names nothing says which names are one field; then names that are much alike are
    matched as renamed where that makes the script cheapest."""
    scratch = Scratch(headers.sparkSession, "drift")
    known = field_names is not None
    if field_names is None:
        field_names = headers.sparkSession.createDataFrame([], "written_as string, field_name string")
    files = file_schemas(headers, field_names, scratch)
    pairs = lag_over_ranges(files, ["series"], ["created_at", "file_id"], ["fields"], scratch).filter("has_prev")
    return pairs.select(F.col("file_id").cast("long"), "prev_fields", "fields").mapInArrow(
        _scripts(known), "file_id long, field_name string, change_kind string, old string, new string"
    )


def unified_types(files: DataFrame) -> DataFrame:
    """(field, type): one type for each field over all files, str if any file has str for it or types
    other than numbers differ, float before int."""
    each = files.select(F.explode("fields").alias("f")).groupBy("f.field").agg(
        F.max(F.when(F.col("f.type") == "int", 0).when(F.col("f.type") == "float", 1).otherwise(2)).alias("rank")
    )
    return each.select("field", F.when(F.col("rank") == 0, "int").when(F.col("rank") == 1, "float").otherwise("str").alias("type"))


#: Maps of typed values and the Spark type of each; types other than numbers are kept as text.
TYPED = {"ints": ("int", "long"), "floats": ("float", "double"), "texts": (None, "string")}


def typed_rows(placed: DataFrame) -> DataFrame:
    """Rows (file_id, line_no, cells, fields) as a table of fixed columns.

    The eight pairs columns come out as columns of the format's types whatever a file declares:
    positions as numbers where they are numbers, the others as text. Every further field has its text
    in the map extras, by field name, and its value in one of the maps ints, floats and texts, as the
    type in fields says. A cell that is no value of a number type, or that a short line lacks, is not in
    the map; of fields given twice in a header the first counts."""
    names = F.transform("fields", lambda f: f["field"])

    def cell(name: str):
        idx = F.filter("fields", lambda f: f["field"] == name)
        return F.when(F.size(idx) > 0, F.get("cells", F.get(idx, F.lit(0))["idx"]))

    out = {c.lower(): cell(c) for c in PAIRS_COLUMNS}
    for c in POSITION_COLUMNS:
        out[c] = out[c].try_cast("long")
    more = F.filter(
        "fields", lambda f, i: ~f["field"].isin(*PAIRS_COLUMNS) & (f["idx"] < F.size("cells")) & (F.array_position(names, f["field"]) == i + 1)
    )

    def values(fields, kind: str):
        entries = F.transform(fields, lambda f: F.struct(f["field"].alias("key"), F.get(F.col("cells"), f["idx"]).try_cast(kind).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    def of(own: str | None):
        return F.filter(more, lambda f: f["type"] == own if own else ~f["type"].isin("int", "float"))

    out["extras"] = values(more, "string")
    for name, (own, kind) in TYPED.items():
        out[name] = values(of(own), kind)
    return placed.select("file_id", "line_no", *[v.alias(k) for k, v in out.items()])


def join_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines with what files has for their file_id, nulls for unknown files. A file may hold most lines,
    so beyond FILES_LIMIT files the join treats hot files apart."""
    if files.count() <= FILES_LIMIT:
        return lines.join(F.broadcast(files), "file_id", "left")
    return join_unique(lines, files, ["file_id"], "left")


def place(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines (file_id, line_no, cells) with the fields of their file; lines of unknown files have the
    eight pairs columns in order."""
    standard = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("field"), F.lit(c).alias("written"), F.lit("str").alias("type")) for i, c in enumerate(PAIRS_COLUMNS)])
    placed = join_files(lines.select("file_id", "line_no", "cells"), files.select("file_id", "fields"))
    return placed.withColumn("fields", F.coalesce("fields", standard))


def compile_script(script: list[Edit], fields: list[dict]) -> list[tuple[int, str, str, str]]:
    """The projection (idx, field, written, type) that an edit script from a file's fields makes of
    its cells: renamed says which written name a field is read from, retyped what it is cast to; a
    removed field is not read, and an added one has no cell and stays null."""
    at: dict[str, int] = {}
    source: dict[str, str] = {}
    kind: dict[str, str] = {}
    for f in fields:
        at.setdefault(f["written"], f["idx"])
        source.setdefault(f["field"], f["written"])
        kind.setdefault(f["field"], f["type"])
    for e in script:
        field = e.path[-1]
        if e.op == "renamed":
            source[field] = e.old
        elif e.op == "retyped":
            kind[field] = e.new
        elif e.op == "removed":
            source.pop(field)
    return sorted((at[w], k, w, kind[k]) for k, w in source.items())


def _projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    differ = Differ()
    step = pa.struct([("idx", pa.int32()), ("field", pa.string()), ("written", pa.string()), ("type", pa.string())])
    for batch in batches:
        ids, out = batch.column(0), []
        for fields in batch.column(1).to_pylist():
            kinds = {f["field"]: f["unified"] for f in fields}
            one = Node("", children=tuple(Node(k, t, k) for k, t in kinds.items()))
            steps = compile_script(differ.script(schema_tree(fields), one), fields)
            out.append([dict(zip(step.names, x)) for x in steps])
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(step))], names=["file_id", "fields"])


def projections(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_id, fields): the projection of each file into the one schema of all files, compiled from
    the least-cost edit script that turns the file's schema into it (its part with the file's own
    fields; what a file lacks would be added, and is null)."""
    each = files.select(F.col("file_id").cast("long"), F.explode("fields").alias("f")).select("file_id", "f.*")
    types = scratch.write(unified_types(files).withColumnRenamed("type", "unified"))
    typed = join_unique(each, types, ["field"])
    row = F.struct("idx", "field", "written", "type", "unified")
    return typed.groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("fields")).mapInArrow(
        _projections, "file_id long, fields array<struct<idx: int, field: string, written: string, type: string>>"
    )


def unify(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines (file_id, line_no, cells array<string>) of all files as one table, see typed_rows: each
    file's edit script to the one schema is compiled to a projection that is applied to its lines. Each
    field has the type that unified_types gives it over all files, so it is in the same map throughout."""
    scratch = Scratch(lines.sparkSession, "unify")
    return typed_rows(place(lines, scratch.write(projections(files, scratch))))
