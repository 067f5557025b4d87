"""Body lines that do not fit their file's header, apart from the rest and with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.schema_drift import file_schemas, join_files, place, typed_rows
from contactloom.runtime import Scratch
from contactloom.schema import PAIRS_COLUMNS

#: Possessive, so that long fields are read in a loop and not by recursion.
QUOTED, PLAIN = r'"[^"]*+(?:""[^"]*+)*+"', r'(?!")[^\t]*+'
LINE = rf"\A(?:{QUOTED}|{PLAIN})(?:\t(?:{QUOTED}|{PLAIN}))*+\z"
CELL = rf"\G\t({QUOTED}|{PLAIN})"
#: Rows of chromsizes up to which they are broadcast.
CHROMS_LIMIT = 100_000

# The rule table: which rule a cell is held to, by the field it is in or else by the field's type.
RULES = [
    ("field", "readID", "not_empty"), ("field", "chrom1", "chrom"), ("field", "chrom2", "chrom"),
    ("field", "pos1", "position"), ("field", "pos2", "position"), ("field", "strand1", "strand"),
    ("field", "strand2", "strand"), ("field", "pair_type", "pair_type"),
    ("type", "int", "int"), ("type", "float", "float"),
]


def split_cells(line: Column, quoting: Column) -> tuple[Column, Column]:
    """The cells of a line, and whether its quoting is broken. Under 'double' a field that begins
    with a quote runs to its closing quote, "" inside standing for one; any other quote is ordinary."""
    double = F.coalesce(quoting == "double", F.lit(False))
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(CELL), F.lit(1))
    cleaned = F.transform(
        raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    )
    plain = F.split(line, "\t", -1)
    has_quote = double & F.contains(line, F.lit('"'))
    return F.when(has_quote, cleaned).otherwise(plain), has_quote & ~line.rlike(LINE)


def _valid(rule: Column, value: Column, chrom: Column, length: Column) -> Column:
    whole = value.rlike(r"\A[0-9]{1,18}\z")
    pos = value.try_cast("long")
    placed = F.when(chrom == "!", pos == 0).when(length.isNotNull(), pos.between(1, length)).otherwise(F.lit(True))
    return (
        F.when(rule == "not_empty", value != "")
        .when(rule == "chrom", (value == "!") | length.isNotNull())
        .when(rule == "position", whole & F.when(whole, placed).otherwise(False))
        .when(rule == "strand", value.isin("+", "-"))
        .when(rule == "pair_type", value.rlike(r"\A(?:DD|[NMURXW]{2})\z"))
        .when(rule == "int", value.rlike(r"\A-?[0-9]{1,18}\z"))
        .when(rule == "float", value.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?\z"))
        .otherwise(F.lit(True))
    )


class LineCheck:
    """lines (file_id, line_no, line_text) held against headers (see file_schemas) and chromsizes.

    A null text counts as an empty line; lines of a file without a header are held against the eight
    pairs columns without quoting; lines without file_id or line_no are left out. A line that is
    loaded several times comes out once."""

    def __init__(self, lines: DataFrame, headers: DataFrame, field_names: DataFrame, chromsizes: DataFrame):
        spark = lines.sparkSession
        self.scratch = Scratch(spark, "lines")
        self.files = self.scratch.write(file_schemas(headers, field_names, self.scratch))
        at = lambda name: F.array_position(F.transform("fields", lambda f: f["field"]), name).cast("int")
        rules = self.files.select(
            "file_id", "quoting", F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["type"].alias("type"))).alias("fields")
        )
        lines = lines.select("file_id", "line_no", F.coalesce("line_text", F.lit("")).alias("line_text")).dropna()
        standard = F.array(
            *[F.struct(F.lit(c).alias("field"), F.lit("int" if c.startswith("pos") else "str").alias("type")) for c in PAIRS_COLUMNS]
        )
        held = join_files(lines, rules).withColumn("fields", F.coalesce("fields", standard))
        cells, broken = split_cells(F.col("line_text"), F.col("quoting"))
        held = held.select(
            "file_id", "line_no", "fields", broken.alias("broken"), cells.alias("cells"), at("chrom1").alias("at1"), at("chrom2").alias("at2"),
            F.array_max(F.array(*[at(c) for c in PAIRS_COLUMNS])).alias("least"),
        )
        n = F.size("cells")
        miscounted = (n > F.size("fields")) | (n < F.col("least"))
        self.lines = held.withColumn(
            "reason", F.when(F.col("broken"), "broken_quoting").when(miscounted, "field_count")
        ).drop("broken", "least")
        sizes = chromsizes.select(F.col("chrom").alias("ctx"), F.col("chrom_len").alias("len")).dropna().dropDuplicates(["ctx"])
        self.sizes = F.broadcast(sizes) if sizes.count() <= CHROMS_LIMIT else sizes
        self.rules = F.broadcast(spark.createDataFrame(RULES, "level string, name string, rule string"))

    def errors(self) -> DataFrame:
        """(file_id, line_no, reason): every bad line once.

        Lines are exploded into (line, field, value) where they lie; the rule table says what each
        cell is held to; only failing cells are shuffled, to be aggregated by line."""
        # a cell goes with its own field only, not with its line's other cells
        one = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("type"), F.lit("").alias("value")))
        fields = F.transform(
            F.slice("fields", 1, F.size("cells")), lambda f, i: F.struct(f["field"].alias("field"), f["type"].alias("type"), F.get("cells", i).alias("value"))
        )
        cells = self.lines.select(
            "file_id", "line_no", "reason", F.get("cells", F.col("at1") - 1).alias("c1"), F.get("cells", F.col("at2") - 1).alias("c2"),
            F.explode(F.when(F.col("reason").isNull(), fields).otherwise(one)).alias("f"),
        )
        ctx = F.when(F.col("f.field").isin("chrom1", "pos1"), F.col("c1")).when(F.col("f.field").isin("chrom2", "pos2"), F.col("c2"))
        cells = cells.select("file_id", "line_no", "reason", "f.field", "f.type", "f.value", ctx.alias("ctx"))
        by_field = self.rules.filter("level = 'field'").select(F.col("name").alias("field"), F.col("rule").alias("own_rule"))
        by_type = self.rules.filter("level = 'type'").select(F.col("name").alias("type"), F.col("rule").alias("type_rule"))
        ruled = cells.join(F.broadcast(by_field), "field", "left").join(F.broadcast(by_type), "type", "left")
        sized = ruled.join(self.sizes, "ctx", "left")
        ok = _valid(F.coalesce("own_rule", "type_rule"), F.col("value"), F.col("ctx"), F.col("len"))
        failing = sized.filter(F.col("reason").isNotNull() | ~F.coalesce(ok, F.lit(False)))
        return failing.groupBy("file_id", "line_no").agg(F.min(F.coalesce("reason", F.lit("bad_value"))).alias("reason"))

    def clean(self) -> DataFrame:
        """(file_id, line_no, cells) of all other lines, each once. The split lines are written, as they are
        read for the errors and for what is left."""
        if not hasattr(self.lines, "_scratch_path"):
            self.lines = self.scratch.write(self.lines)
        bad = self.errors().select("file_id", "line_no")
        return self.lines.select("file_id", "line_no", "cells").join(bad, ["file_id", "line_no"], "left_anti").dropDuplicates(["file_id", "line_no"])

    def rows(self) -> DataFrame:
        """The clean lines as rows whose values have the types of their own file, see typed_rows."""
        return typed_rows(place(self.clean(), self.files))
