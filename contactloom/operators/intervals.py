"""Positions looked up in intervals: restriction fragments and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.runtime import join_unique
from contactloom.schema import UNMAPPED_CHROM

#: Rows of an interval table, after it is cut to buckets, up to which it is broadcast.
BROADCAST_ROWS = 2_000_000


def _bucketed(intervals: DataFrame) -> tuple[DataFrame, int]:
    """Intervals (chrom, lo, hi, ...) exploded over buckets about twice their mean length, so that a
    bucket holds a few of them whatever their number; the table grows by half at most."""
    n, total = intervals.agg(F.count(F.lit(1)), F.sum(F.col("hi") - F.col("lo"))).first()
    width = 1 << max(4, int(2 * (total or 1) / max(1, n)).bit_length())
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    return intervals.filter("hi > lo").withColumn("_bucket", F.explode(F.sequence(first, last))), width


def locate(df: DataFrame, chrom: str, pos: Column, intervals: DataFrame, name: str) -> DataFrame:
    """df with the struct column name: the interval [lo, hi) of its chromosome that pos lies in, null
    if there is none. Intervals of a chromosome must not overlap.

    An equality of chromosome and bucket leaves a few intervals to compare, by a broadcast hash join
    if the table is small enough. Beyond that both sides are shuffled by chromosome and bucket, the
    rows first reduced to their distinct positions, so no hot place makes a task long."""
    table, width = _bucketed(intervals)
    fields = F.struct(*[F.col(c) for c in intervals.columns if c != "chrom"]).alias("_hit")
    table = table.select(F.col("chrom").alias("_chrom"), "_bucket", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), fields)
    at = df.withColumn("_pos", pos).withColumn("_b", F.floor(F.col("_pos") / width))
    on = (F.col(chrom) == F.col("_chrom")) & (F.col("_b") == F.col("_bucket")) & (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))
    extra = ["_chrom", "_bucket", "_lo", "_hi", "_hit", "_pos", "_b"]
    if table.count() <= BROADCAST_ROWS:
        return at.join(F.broadcast(table), on, "left").withColumn(name, F.col("_hit")).drop(*extra)
    places = at.select(F.col(chrom).alias("_c"), "_pos", "_b").distinct()
    hits = places.join(
        table, (F.col("_c") == F.col("_chrom")) & (F.col("_b") == F.col("_bucket")) & (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))
    ).select(F.col("_c").alias("_k"), "_pos", F.col("_hit").alias(name))
    keyed = at.withColumn("_k", F.col(chrom))
    return join_unique(keyed, hits, ["_k", "_pos"], "left").drop("_k", "_pos", "_b")


def fragment_table(bed: DataFrame) -> DataFrame:
    """(chrom, lo, hi, idx, frag_start, frag_end): fragments between the ends of the BED rows, which
    count from 1; the first fragment of a chromosome starts at 0. Null rows are left out."""
    w = W.partitionBy("chrom").orderBy("start", "end")
    edge = bed.select("chrom", "start", "end").dropna()
    start = F.coalesce(F.lag(F.col("end") + 1).over(w), F.lit(0)).cast("long")
    return edge.select(
        "chrom", start.alias("lo"), (F.col("end") + 1).cast("long").alias("hi"), (F.row_number().over(w) - 1).cast("long").alias("idx")
    ).withColumns({"frag_start": F.col("lo"), "frag_end": F.col("hi")})


def restrict(df: DataFrame, bed: DataFrame) -> DataFrame:
    """df with rfrag, rfrag_start and rfrag_end of both sides: the restriction fragment a position
    lies in, positions outside being put to the first or last fragment. Unmapped sides and those on a
    chromosome without fragments have -1, 0, 0."""
    fragments = fragment_table(bed)
    bounds = fragments.groupBy("chrom").agg(F.min("lo").alias("_least"), F.max("hi").alias("_most"))
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    for i in (1, 2):
        c, p = f"chrom{i}", f"pos{i}"
        df = df.join(bounds.withColumnRenamed("chrom", "_bc"), F.col(c) == F.col("_bc"), "left").drop("_bc")
        inside = F.greatest(F.col("_least"), F.least(F.col("_most") - 1, F.col(p).cast("long")))
        df = locate(df, c, F.when(F.col(c) != UNMAPPED_CHROM, inside), fragments, f"_frag{i}").drop("_least", "_most")
    named = (("rfrag", "idx", -1), ("rfrag_start", "frag_start", 0), ("rfrag_end", "frag_end", 0))
    return df.withColumns(
        {f"{n}{i}": F.coalesce(F.col(f"_frag{i}")[f], F.lit(d)).cast("long") for i in (1, 2) for n, f, d in named}
    ).drop("_frag1", "_frag2")


def assign_regions(df: DataFrame, regions: DataFrame, sides: Sequence[int] = (1, 2)) -> DataFrame:
    """df with start and end of the region [start, end) of each side, -1 where there is none."""
    table = regions.select("chrom", F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi")).dropna()
    for i in sides:
        df = locate(df, f"chrom{i}", F.col(f"pos{i}").cast("long"), table, f"_reg{i}")
        df = df.withColumns({f"start{i}": F.coalesce(F.col(f"_reg{i}.lo"), F.lit(-1)).cast("long"), f"end{i}": F.coalesce(F.col(f"_reg{i}.hi"), F.lit(-1)).cast("long")}).drop(f"_reg{i}")
    return df


def fragment_classes(df: DataFrame, near: int = 1) -> DataFrame:
    """df with class: how a cis pair's fragments relate. Neighbouring fragments facing each other
    are dangling ends, facing apart self-circles, alike mirrored; all other pairs are regular."""
    close = (F.col("chrom1") == F.col("chrom2")) & (F.col("rfrag1") >= 0) & (F.abs(F.col("rfrag1") - F.col("rfrag2")) <= near)
    strands = F.concat("strand1", "strand2")
    return df.withColumn(
        "class",
        F.when(close & (strands == "+-"), "dangling_end").when(close & (strands == "-+"), "self_circle")
        .when(close, "mirror").otherwise("regular"),
    )


def fragment_end_distances(df: DataFrame) -> DataFrame:
    """df with the distances of each position to the two ends of its fragment."""
    return df.withColumns(
        {f"dist_{e}{i}": (F.col(f"pos{i}") - F.col(f"rfrag_start{i}") if e == "start" else F.col(f"rfrag_end{i}") - F.col(f"pos{i}")) for i in (1, 2) for e in ("start", "end")}
    )
