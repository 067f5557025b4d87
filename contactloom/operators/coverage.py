"""Filtering of pairs by how many other pairs' ends are near theirs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.operators.rowwise import is_mapped, mark_as_dup
from contactloom.runtime import Scratch, hot_limit, join_unique
from contactloom.schema import DUPLICATE, HIGH_COVERAGE, UNMAPPED_CHROM

ENDS = ("chrom1", "pos1", "chrom2", "pos2")


def end_coverage(df: DataFrame, max_dist: int, scratch: Scratch, columns: Sequence[str] = ENDS) -> DataFrame:
    """(chrom, pos, n): for each position that an end lies at, the ends within max_dist, itself
    included.

    Ends are first counted by position. A chromosome is cut into blocks, to which the positions near
    a border of the neighbouring blocks are copied, so the range window sorts a block's distinct
    positions and never a chromosome."""
    sides = [F.struct(F.col(c).alias("chrom"), F.col(p).cast("long").alias("pos")) for c, p in (columns[:2], columns[2:])]
    ends = df.select(F.explode(F.array(*sides)).alias("e")).select("e.*")
    counted = ends.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("here"))
    width = max(1 << 16, 8 * max_dist)
    block = lambda c: F.floor(c / width)
    blocks = F.array_distinct(F.array(*[block(F.col("pos") + d) for d in (0, -max_dist, max_dist)]))
    placed = counted.select("chrom", "pos", "here", F.explode(blocks).alias("block"))
    w = W.partitionBy("chrom", "block").orderBy("pos").rangeBetween(-max_dist, max_dist)
    near = placed.withColumn("n", F.sum("here").over(w)).filter(F.col("block") == block(F.col("pos")))
    return scratch.write(near.select("chrom", "pos", "n", "here"))


def pair_coverage(df: DataFrame, max_dist: int = 500, method: str = "max", columns: Sequence[str] = ENDS, unmapped: str = UNMAPPED_CHROM) -> DataFrame:
    """Mapped pairs with _coverage: of both ends the greater number of ends near them, or (sum) the
    sum of both numbers less one. Rows with a null chromosome or position count as unmapped."""
    scratch = Scratch(df.sparkSession, "coverage")
    out = df.filter(_mapped(columns, unmapped))
    near = end_coverage(out, max_dist, scratch, columns)
    hot = _hot_ends(near)
    for i, (c, p) in enumerate((columns[:2], columns[2:]), 1):
        side = near.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("n").alias(f"_n{i}"))
        keyed = out.withColumns({"_c": F.col(c), "_p": F.col(p).cast("long")})
        out = join_unique(keyed, side, ["_c", "_p"], hot=hot).drop("_c", "_p")
    value = {"max": F.greatest("_n1", "_n2"), "sum": F.col("_n1") + F.col("_n2") - 1}[method]
    return out.withColumn("_coverage", value).drop("_n1", "_n2")


def _mapped(columns: Sequence[str], unmapped: str):
    c1, p1, c2, p2 = columns
    return is_mapped(c1, c2, unmapped) & F.col(p1).isNotNull() & F.col(p2).isNotNull()


def _hot_ends(near: DataFrame) -> DataFrame:
    """Positions with more ends of their own than hot_limit allows for a row's two ends."""
    ends = near.agg(F.sum("here")).first()[0] or 0
    return near.filter(F.col("here") > hot_limit(ends // 2)).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"))


def filter_by_coverage(
    df: DataFrame, max_cov: int = 8, max_dist: int = 500, method: str = "max", mark_multi: bool = False, mark: str = HIGH_COVERAGE,
    columns: Sequence[str] = ENDS, unmapped: str = UNMAPPED_CHROM,
) -> dict[str, DataFrame]:
    """{lowcov, highcov, unmapped}: mapped pairs up to max_cov and above it, and unmapped pairs.
    mark_multi: pairs of highcov get mark as their pair_type, and the duplicate bit in SAM entries
    if mark is DD."""
    covered = pair_coverage(df, max_dist, method, columns, unmapped)
    high = covered.filter(F.col("_coverage") > max_cov).drop("_coverage")
    if mark_multi:
        high = mark_as_dup(high) if mark == DUPLICATE else high.withColumn("pair_type", F.lit(mark))
    rest = df.filter(~_mapped(columns, unmapped))
    return {"lowcov": covered.filter(F.col("_coverage") <= max_cov).drop("_coverage"), "highcov": high, "unmapped": rest}
