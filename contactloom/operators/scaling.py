"""Contact frequency against distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.bins import OPEN_END, bin_index, edge_at, geometric_edges
from contactloom.operators.intervals import assign_regions
from contactloom.runtime import Scratch

REGION = ["chrom", "start", "end"]
REGIONS = [f"{c}{i}" for i in (1, 2) for c in REGION]
STRANDS = ["strand1", "strand2"]
#: Regions up to which the second sides of a dense table are broadcast.
DENSE_REGIONS = 100_000


def with_regions(df: DataFrame, regions: DataFrame | None, chromsizes: DataFrame | None = None) -> DataFrame:
    """Start and end of each side's region: those of regions, else whole chromosomes by chromsizes
    (chrom, length), else 0 and -1."""
    if regions is not None:
        return assign_regions(df, regions)
    for i in (1, 2):
        if chromsizes is None:
            df = df.withColumns({f"start{i}": F.lit(0).cast("long"), f"end{i}": F.lit(-1).cast("long")})
        else:
            sizes = chromsizes.select(F.col("chrom").alias(f"chrom{i}"), F.col("length").cast("long").alias(f"end{i}"))
            df = df.join(F.broadcast(sizes) if sizes.count() < 1_000_000 else sizes, f"chrom{i}", "left")
            df = df.withColumns({f"start{i}": F.when(F.col(f"end{i}").isNull(), -1).otherwise(0).cast("long"), f"end{i}": F.coalesce(f"end{i}", F.lit(-1)).cast("long")})
    return df


def cis_area(length: Column, lo: Column, hi: Column) -> Column:
    """Pairs of bases of a region of that length whose distance is from lo up to hi."""
    near, far = (F.greatest(length - d, F.lit(0)).cast("long") for d in (lo, hi))
    return (near * near - far * far).cast("double") * 0.5


class Scaling:
    """Pairs by region, strands and distance bin.

    A pair within one region counts under its distance bin; distances below the first and from the
    last edge on count nowhere. A pair between regions, single-sided ones included, counts under its
    two regions. Pairs with a side outside all regions are left out unless keep_unassigned. Both
    tables come from one aggregation whose groups are as many as regions, strands and bins allow.
    Dense tables are over all regions given, or all chromosomes of chromsizes, else over those that
    occur. filter_f: takes the pairs and gives those that count."""

    def __init__(
        self, df: DataFrame, regions: DataFrame | None = None, chromsizes: DataFrame | None = None,
        dist_range: tuple[int, int] = (1, 1_000_000_000), per_decade: int = 8, keep_unassigned: bool = False,
        filter_f: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.edges = geometric_edges(*dist_range, per_decade)
        df = df if filter_f is None else filter_f(df)
        rows = with_regions(df, regions, chromsizes)
        if not keep_unassigned:
            rows = rows.filter((F.col("start1") >= 0) & (F.col("start2") >= 0))
        same = reduce(lambda a, b: a & b, [F.col(f"{c}1").eqNullSafe(F.col(f"{c}2")) for c in REGION])
        dist = F.abs(F.col("pos1").cast("long") - F.col("pos2").cast("long"))
        index = F.when(same, bin_index(self.edges, dist))
        self.groups = rows.groupBy(*REGIONS, *STRANDS, index.alias("_bin")).agg(F.count(F.lit(1)).alias("n_pairs"))
        self.view = None
        if regions is not None:
            self.view = regions.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
        elif chromsizes is not None:
            self.view = chromsizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end")).dropna()

    def once(self) -> "Scaling":
        """The same with the groups written, for several tables from one scan of the pairs."""
        if not hasattr(self.groups, "_scratch_path"):
            self.groups = Scratch(self.groups.sparkSession, "scaling").write(self.groups)
        return self

    def every_region(self) -> DataFrame:
        """(chrom, start, end) of the view and of whatever occurs outside it."""
        seen = [self.groups.select(*[F.col(f"{c}{i}").alias(c) for c in REGION]) for i in (1, 2)]
        regions = seen[0].unionByName(seen[1])
        return (regions if self.view is None else regions.unionByName(self.view)).distinct()

    def cis(self, dense: bool = False) -> DataFrame:
        """(regions, strands, min_dist, max_dist, n_pairs, n_bp2). dense: also bins without pairs, of
        every region."""
        inside = (F.col("_bin") > 0) & (F.col("_bin") < len(self.edges))
        found = self.groups.filter(inside)
        if dense:
            found = self.once().groups.filter(inside)
            every = self.every_region().select(*[F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in REGION])
            for c in STRANDS:
                every = every.withColumn(c, F.explode(F.array(F.lit("+"), F.lit("-"))))
            every = every.withColumn("_bin", F.explode(F.sequence(F.lit(1), F.lit(len(self.edges) - 1))))
            found = every.join(found, [*REGIONS, *STRANDS, "_bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))
        lo, hi = edge_at(self.edges, F.col("_bin") - 1), edge_at(self.edges, F.col("_bin"))
        out = found.withColumns({"min_dist": lo, "max_dist": hi})
        area = cis_area(F.col("end1") - F.col("start1"), F.col("min_dist"), F.col("max_dist"))
        return out.withColumn("n_bp2", area).select(*REGIONS, *STRANDS, "min_dist", "max_dist", "n_pairs", "n_bp2")

    def trans(self, dense: bool = False) -> DataFrame:
        """(regions, strands, n_pairs, n_bp2). dense: all ordered pairs of different regions."""
        found = self.groups.filter("_bin is null").drop("_bin")
        if dense:
            found = self.once().groups.filter("_bin is null").drop("_bin")
            regions = Scratch(found.sparkSession, "regions").write(self.every_region())
            second = regions.select(*[F.col(c).alias(f"{c}2") for c in REGION])
            if regions.count() <= DENSE_REGIONS:
                second = F.broadcast(second)
            different = ~reduce(lambda a, b: a & b, [F.col(f"{c}1").eqNullSafe(F.col(f"{c}2")) for c in REGION])
            # the table asked for has a row for each two regions, so this join is its result
            every = regions.select(*[F.col(c).alias(f"{c}1") for c in REGION]).join(second, different)
            for c in STRANDS:
                every = every.withColumn(c, F.explode(F.array(F.lit("+"), F.lit("-"))))
            found = every.join(found, [*REGIONS, *STRANDS], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))
        area = ((F.col("end1") - F.col("start1")) * (F.col("end2") - F.col("start2"))).cast("double")
        return found.withColumn("n_bp2", area).select(*REGIONS, *STRANDS, "n_pairs", "n_bp2")

    def table(self, dense: bool = False) -> DataFrame:
        """Both tables below each other; distances are null between regions."""
        return self.cis(dense).unionByName(self.trans(dense), allowMissingColumns=True)


def area_sum() -> Column:
    """Sum of areas, which are whole or half numbers, the same in whatever order they are added."""
    return F.sum((F.col("n_bp2") * 2).cast("decimal(38,0)")).cast("double") / 2


def by_strands(cis: DataFrame) -> DataFrame:
    """P(s) of each strand combination over all regions."""
    return cis.groupBy(*STRANDS, "min_dist", "max_dist").agg(
        F.sum("n_pairs").alias("n_pairs"), area_sum().alias("n_bp2")
    ).withColumn("density", F.when(F.col("n_bp2") > 0, F.col("n_pairs") / F.col("n_bp2")))


def mean_trans_density(trans: DataFrame) -> DataFrame:
    return trans.agg((F.sum("n_pairs") / F.sum("n_bp2")).alias("trans_density"))


def normalised(profile: DataFrame, by: Sequence[str] = (), lo: int = 1000, hi: int | None = None) -> DataFrame:
    """profile (min_dist, n_pairs, n_bp2 and columns by) with its density, and the density divided
    by the mean one from lo to hi, so that it is 1 there."""
    hi = OPEN_END if hi is None else hi
    rows = profile.withColumn("density", F.when(F.col("n_bp2") > 0, F.col("n_pairs") / F.col("n_bp2")))
    unit = rows.filter(F.col("min_dist").between(lo, hi)).groupBy(*by).agg((F.sum("n_pairs") / F.sum("n_bp2")).alias("_unit"))
    joined = rows.join(unit, list(by), "left") if by else rows.join(F.broadcast(unit.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left").drop("_one")
    return joined.withColumn("relative_density", F.col("density") / F.col("_unit")).drop("_unit")


def read_scaling(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)
