"""Pair operators on streams of text lines.

Operators that look at one row at a time take a streaming DataFrame as they are. Counts are kept by
complete aggregation: the state is the groups of the statistics, which are bounded by pair types,
chromosomes, strands and bins. Exact copies are dropped within a watermark, so that state is bounded
by time; near copies need the batch operator, whose clusters can change with every later row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.rowwise import is_mapped
from contactloom.operators.stats import CIS_THRESHOLDS
from contactloom.schema import DUPLICATE, FIELD_SEP, INT_COLUMNS, PAIRS_COLUMNS


def read_pairs_stream(spark: SparkSession, path: str, columns: Sequence[str] = PAIRS_COLUMNS, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of the text files that come into a folder; lines that begin with '#' are left out, so the
    names of reads in such a stream must not begin with it."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    cells = F.split("value", FIELD_SEP, -1)
    out = [(F.get(cells, F.lit(i)).try_cast("bigint") if c in INT_COLUMNS else F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return reader.text(path).filter(~F.col("value").startswith("#")).select(*out)


def running_counts(df: DataFrame) -> DataFrame:
    """The main counts by pair type, for outputMode('complete')."""
    mapped = is_mapped()
    dup = mapped & (F.col("pair_type") == DUPLICATE)
    live = mapped & ~dup
    cis = live & (F.col("chrom1") == F.col("chrom2"))
    far: dict[str, Column] = {k: F.count_if(cis & (F.abs(F.col("pos1") - F.col("pos2")) >= v)) for k, v in CIS_THRESHOLDS.items()}
    return df.groupBy("pair_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("total_mapped"), F.count_if(dup).alias("total_dups"),
        F.count_if(cis).alias("cis"), F.count_if(live & ~cis).alias("trans"), *[v.alias(k) for k, v in far.items()],
    )


def drop_exact_copies(df: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """The first of mapped rows alike in chromosomes, positions and strands within the watermark."""
    keys = ["chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2"]
    return df.filter(is_mapped()).withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def contacts_by_time(df: DataFrame, event_time: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mapped pairs by window of time and pair type, late rows counted up to the watermark."""
    return (
        df.filter(is_mapped()).withWatermark(event_time, late)
        .groupBy(F.window(event_time, width), "pair_type").agg(F.count(F.lit(1)).alias("n"))
    )
