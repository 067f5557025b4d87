"""Readers and writers of pairs text files and of the small tables that operators take."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.header import PairsHeader, chrom_order
from contactloom.schema import FIELD_SEP, INT_COLUMNS, PAIRS_COLUMNS
from contactloom.sources.streams import write_bytes, write_lines
from contactloom.table import PairsTable

BED3 = "chrom string, start long, end long"


def _files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    out = []
    for s in found:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [x.getPath().toString() for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def check_codec(path: str) -> None:
    """lz4 frames have no Hadoop codec, so files of that kind are turned down instead of misread."""
    if path.endswith(".lz4"):
        raise ValueError(f"{path}: lz4 frames are not readable here; use gzip, bzip2, zstd or no compression, or give the program that unpacks it")


def head_lines(spark: SparkSession, path: str, prefix: str = "#") -> list[str]:
    """The leading lines of a file that begin with prefix, read on the driver and no further."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8")
    )
    out = []
    try:
        while (line := reader.readLine()) is not None and line.startswith(prefix):
            out.append(line)
    finally:
        reader.close()
    return out


def read_pairs(
    spark: SparkSession, path: str, casts: Mapping[str, str] | None = None, columns: Sequence[str] | None = None, order: bool = True
) -> PairsTable:
    """A pairs or pairsam file, folder or glob as a table whose columns the header names.

    Only the leading '#' lines are header; a later line that begins with '#' is a row. Text is not
    unquoted and '!' stays text. Rows with fewer fields than columns have nulls at their end; further
    fields are dropped. With several files the first one's header counts and its columns hold for
    all. _ord numbers the rows in their order in the input; _width is a row's number of fields."""
    for f in (files := _files(spark, path)):
        check_codec(f)
    header = PairsHeader.parse(head_lines(spark, files[0]))
    names = list(columns or header.columns())
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_ord")
    )
    if not header.is_empty():
        # header lines are the first of their file: none of them may come after a row
        first_row = lines.filter(~F.col("value").startswith("#")).groupBy("_file").agg(F.min("_ord").alias("_first"))
        lines = lines.join(F.broadcast(first_row), "_file").filter(F.col("_ord") >= F.col("_first"))
    cells = F.split("value", FIELD_SEP, -1)
    kinds = {c: "bigint" for c in INT_COLUMNS} | dict(casts or {})
    lines = lines.withColumn("_cells", cells)
    out = [
        (F.get("_cells", F.lit(i)).try_cast(kinds[c]) if c in kinds else F.get("_cells", F.lit(i))).alias(c) for i, c in enumerate(names)
    ]
    extra = [F.col("_ord")] if order else []
    return PairsTable(lines.select(*out, F.size("_cells").alias("_width"), *extra), header)


def to_lines(df: DataFrame) -> DataFrame:
    """Rows as text lines, nulls as empty fields; a null tail that the input did not have is left off."""
    names = [c for c in df.columns if not c.startswith("_")]
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    if "_width" in df.columns:
        cells = F.slice(cells, 1, F.greatest(F.col("_width"), F.lit(0)))
    return df.select(F.array_join(cells, FIELD_SEP).alias("value"), *[c for c in df.columns if c == "_ord"])


def write_pairs(table: PairsTable, path: str, compression: str | None = None, single: bool = False, command: str | None = None) -> None:
    """The rows as text part files in the folder path, and the header as the file _header beside
    them. single: one ordinary file with the header on top, or standard output if path is '-'; its
    parts are written side by side and put together by the file system (see write_lines)."""
    lines = to_lines(table.df)
    if single:
        write_lines(lines, path, table.header.text(), command)
        return
    lines.select("value").write.mode("overwrite").options(**({"compression": compression} if compression else {})).text(path)
    write_bytes(table.df.sparkSession, f"{path}/_header", table.header.text().encode())


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file; comment lines are left out."""
    return spark.read.csv(path, sep="\t", comment="#", schema=BED3)


def read_chromsizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Chromosome sizes, in order; a table of a genome, so it is held by the driver."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, length long").coalesce(1).collect()
    return {r.chrom: r.length for r in rows}


def read_chrom_list(spark: SparkSession, path: str, sam_chroms: Sequence[str] | None = None) -> list[str]:
    rows = spark.read.csv(path, sep="\t", schema="chrom string").coalesce(1).collect()
    return chrom_order([r.chrom for r in rows], sam_chroms)


def read_view(spark: SparkSession, path: str) -> DataFrame:
    """A table of regions with a header row: chrom, start, end and perhaps name."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def pairs_schema(columns: Sequence[str] = PAIRS_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType() if c in INT_COLUMNS else T.StringType()) for c in columns])
