"""Sorting, merging and other operators over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.header import HeaderError, PairsHeader, merge_headers
from contactloom.schema import INT_COLUMNS
from contactloom.table import PairsTable

SORT_COLUMNS = ["chrom1", "chrom2", "pos1", "pos2", "pair_type"]


def sort_keys(df: DataFrame, columns: Sequence[str] = SORT_COLUMNS, extra: Sequence[str] = ()):
    """Columns in the order they are sorted by: text by bytes, numbers by value. A position column
    under another name sorts as text, unless it is a number in the table. _ord keeps ties stable."""
    tie = ["_ord"] if "_ord" in df.columns else []
    return [F.col(c).asc_nulls_first() for c in [*columns, *extra, *tie]]


def sort_pairs(df: DataFrame, columns: Sequence[str] = SORT_COLUMNS, extra: Sequence[str] = ()) -> DataFrame:
    """Rows in order by chromosomes, positions, pair type and further columns: a range partitioning
    and sorts within ranges, which spill by themselves. Nulls come first."""
    return df.orderBy(*sort_keys(df, columns, extra))


def sort_table(table: PairsTable, columns: Sequence[str] = SORT_COLUMNS, extra: Sequence[str] = ()) -> PairsTable:
    kinds = dict(table.df.dtypes)
    as_text = {c: F.col(c).cast("string") for c in [*columns, *extra] if c not in INT_COLUMNS and kinds[c] in ("int", "bigint")}
    df = table.df
    if as_text:
        df = df.withColumns({f"_by_{c}": v for c, v in as_text.items()})
    by = lambda c: f"_by_{c}" if c in as_text else c
    out = sort_pairs(df, [by(c) for c in columns], [by(c) for c in extra]).drop(*[f"_by_{c}" for c in as_text])
    return PairsTable(out, table.header.mark_sorted() if not table.header.is_empty() else table.header)


def union_pairs(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables. The tables must have the same columns; the input order is that of the
    tables, and of each one's rows."""
    names = [[c for c in t.columns if not c.startswith("_")] for t in tables]
    if any(n != names[0] for n in names):
        raise HeaderError("the tables have different columns")
    if all("_ord" in t.columns for t in tables):
        tables = [t.withColumn("_ord", F.struct(F.lit(i).alias("t"), F.col("_ord").alias("o"))) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_tables(
    tables: Sequence[PairsTable], concatenate: bool = False, keep_first_header: bool = False, force: bool = False
) -> PairsTable:
    """Rows of several tables in sorted order (or as they are, with concatenate) under one header.
    A single table comes back untouched."""
    if len(tables) == 1:
        return tables[0]
    header: PairsHeader = merge_headers([t.header for t in tables], force, keep_first_header)
    rows = union_pairs([t.df for t in tables])
    if concatenate:
        return PairsTable(rows, header.unmark_sorted())
    return PairsTable(sort_pairs(rows), header.mark_sorted())
