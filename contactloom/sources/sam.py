"""SAM text as a table of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources.pairs_text import _files, head_lines

#: The eleven fixed fields of a SAM line.
FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(lines, header): the SAM lines (value, _ord) of a file, folder or glob, and the first file's
    header lines. Lines that begin with '@' and a two-letter record name are header."""
    files = _files(spark, path)
    lines = spark.read.text(files).select("value", F.monotonically_increasing_id().alias("_ord"))
    return lines.filter(~F.col("value").rlike(r"\A@[A-Za-z]{2}(?:\t|\z)") & (F.col("value") != "")), head_lines(spark, files[0], "@")


def sam_chroms(header: list[str]) -> dict[str, int]:
    out = {}
    for line in header:
        if line.startswith("@SQ"):
            parts = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            out[parts["SN"]] = int(parts.get("LN", 0))
    return out


def sam_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """SAM lines as typed columns; tags is the array of the optional fields as they are written."""
    cells = F.split(line, "\t", -1)
    kinds = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}
    typed = [(F.get("_cells", F.lit(i)).try_cast(kinds[c]) if c in kinds else F.get("_cells", F.lit(i))).alias(c) for i, c in enumerate(FIELDS)]
    rest = F.slice("_cells", len(FIELDS) + 1, F.greatest(F.size("_cells") - len(FIELDS), F.lit(0)))
    return lines.withColumn("_cells", cells).select(*typed, rest.alias("tags"), F.col(line).alias("sam"), "_ord")


def tag(tags: Column, name: str) -> Column:
    """Value of an optional field, '' if it is missing."""
    found = F.filter(tags, lambda t: t.startswith(f"{name}:"))
    return F.coalesce(F.regexp_extract(F.get(found, F.lit(0)), r"\A..:.:([\s\S]*)\z", 1), F.lit(""))
