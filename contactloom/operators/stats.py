"""Quality statistics of a pairs table, for any number of filters in one pass."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.bins import bin_index, edge_at, stats_edges
from contactloom.functions.complexity import estimate_complexity
from contactloom.operators.rowwise import condition
from contactloom.runtime import Scratch
from contactloom.schema import DUPLICATE, UNMAPPED_CHROM

# Fixed names and thresholds of the statistics.
COUNTS = [
    "total", "total_unmapped", "total_single_sided_mapped", "total_mapped", "total_dups", "total_nodups", "cis", "trans",
]
CIS_THRESHOLDS = {f"cis_{k}kb+": k * 1000 for k in (1, 2, 4, 10, 20, 40)}
STRANDS = ["++", "--", "-+", "+-"]
NO_FILTER = "no_filter"
CHROMSIZES, DISTANCES = "chromsizes/", "dist_freq/"


def _with_filters(df: DataFrame, filters: Mapping[str, str] | None, **options) -> DataFrame:
    """Each row once for every filter it meets, with the filter's name."""
    tests = {NO_FILTER: None} if not filters else filters
    names = [F.when(condition(df, text, **options), F.lit(n)) if text else F.lit(n) for n, text in tests.items()]
    return df.withColumn("filter", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def _flags(df: DataFrame) -> DataFrame:
    c1, c2 = (F.coalesce(F.col(f"chrom{i}"), F.lit(UNMAPPED_CHROM)) != UNMAPPED_CHROM for i in (1, 2))
    dup = F.col("duplicate").cast("boolean") if "duplicate" in df.columns else F.col("pair_type") == DUPLICATE
    mapped = c1 & c2
    return df.withColumns(
        {
            "_m1": c1, "_m2": c2, "_dup": mapped & F.coalesce(dup, F.lit(False)),
            "_cis": F.col("chrom1") == F.col("chrom2"), "_dist": F.abs(F.col("pos2").cast("long") - F.col("pos1").cast("long")),
        }
    )


class PairStats:
    """All counts as one long table (filter, key, value), keys with parts joined by '/'.

    Rows are read once for all of long(): they are grouped by filter and everything that any count depends on (mapping,
    pair type, chromosomes, strands, distance bin), which partial aggregation keeps small, and all
    counts are sums over those groups. A row whose chromosome is null counts as unmapped there. A
    duplicate is a mapped row whose column duplicate is true or, without that column, of type DD."""

    def __init__(self, df: DataFrame, filters: Mapping[str, str] | None = None, per_decade: int = 8, chrom_subset: Sequence[str] | None = None, **options):
        if chrom_subset is not None:
            df = df.filter(F.col("chrom1").isin(*chrom_subset) & F.col("chrom2").isin(*chrom_subset))
        self.edges = stats_edges(per_decade)
        rows = _flags(_with_filters(df, filters, **options))
        live = F.col("_m1") & F.col("_m2") & ~F.col("_dup")
        cis = live & F.col("_cis")
        limits = F.lit(0)
        for k in CIS_THRESHOLDS.values():
            limits = limits + (F.col("_dist") >= k).cast("int")
        self.scratch: Scratch | None = None
        self.groups = rows.groupBy(
            "filter", "_m1", "_m2", "_dup", "pair_type",
            F.when(live, F.col("chrom1")).alias("c1"), F.when(live, F.col("chrom2")).alias("c2"),
            F.when(cis, F.concat("strand1", "strand2")).alias("strands"),
            F.when(cis, bin_index(self.edges, F.col("_dist"))).alias("bin"),
            F.when(cis, limits).alias("far"),
        ).agg(F.count(F.lit(1)).alias("n"))

    def once(self) -> "PairStats":
        """The same with the groups written, so that several results are computed from one scan of the rows."""
        if self.scratch is None:
            self.scratch = Scratch(self.groups.sparkSession, "stats")
            self.groups = self.scratch.write(self.groups)
        return self

    def counts(self) -> DataFrame:
        """(filter, key, value) of the main counts and of cis pairs above each distance."""
        m1, m2, dup = F.col("_m1"), F.col("_m2"), F.col("_dup")
        live, cis = m1 & m2 & ~dup, F.col("bin").isNotNull()
        tests = dict(
            zip(COUNTS, [F.lit(True), ~m1 & ~m2, m1 != m2, m1 & m2, dup, live, live & cis, live & ~cis])
        ) | {name: F.coalesce(F.col("far") > i, F.lit(False)) for i, name in enumerate(CIS_THRESHOLDS)}
        sums = self.groups.groupBy("filter").agg(*[F.sum(F.when(t, F.col("n")).otherwise(0)).alias(k) for k, t in tests.items()])
        return sums.unpivot("filter", list(tests), "key", "value")

    def pair_types(self) -> DataFrame:
        return self.groups.groupBy("filter", "pair_type").agg(F.sum("n").alias("value"))

    def chrom_freq(self) -> DataFrame:
        live = self.groups.filter("c1 is not null and c2 is not null")
        return live.groupBy("filter", F.col("c1").alias("chrom1"), F.col("c2").alias("chrom2")).agg(F.sum("n").alias("value"))

    def dist_freq(self, dense: bool = True) -> DataFrame:
        """(filter, strands, min_dist, value): cis pairs by strands and distance bin; dense: with 0 for
        bins without pairs."""
        near = self.groups.filter("bin is not null").withColumn("min_dist", edge_at(self.edges, F.col("bin") - 1))
        found = near.groupBy("filter", "strands", "min_dist").agg(F.sum("n").alias("value"))
        if not dense:
            return found
        cells = F.explode(F.array(*[F.lit(e).cast("long") for e in self.edges]))
        grid = (
            self.groups.select("filter").distinct()
            .withColumn("strands", F.explode(F.array(*map(F.lit, STRANDS))))
            .withColumn("min_dist", cells)
        )
        return grid.join(found, ["filter", "strands", "min_dist"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))

    def long(self) -> DataFrame:
        """Everything above as (filter, key, value); a missing pair type is written as '.'."""
        self.once()
        labels = [f"{a}-{b}" for a, b in zip(self.edges, self.edges[1:])] + [f"{self.edges[-1]}+"]
        label = F.create_map(*[x for e, t in zip(self.edges, labels) for x in (F.lit(e).cast("long"), F.lit(t))])
        return (
            self.counts()
            .unionByName(self.pair_types().select("filter", F.concat(F.lit("pair_types/"), F.coalesce("pair_type", F.lit("."))).alias("key"), "value"))
            .unionByName(self.chrom_freq().select("filter", F.concat_ws("/", F.lit("chrom_freq"), "chrom1", "chrom2").alias("key"), "value"))
            .unionByName(
                self.dist_freq().select("filter", F.concat_ws("/", F.lit("dist_freq"), label[F.col("min_dist")], "strands").alias("key"), "value")
            )
        )


def merge_stats(tables: Sequence[DataFrame]) -> DataFrame:
    """Counts of several long tables added up; sizes of chromosomes, which must be the same wherever a table
    has any, are kept. Summaries are computed from the result (see summaries), never added."""
    out = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(i)))
    out = out.filter(~F.col("key").startswith("summary/") & (F.col("key") != "dups_by_tile_median"))
    size = F.col("key").startswith(CHROMSIZES)
    sizes = out.filter(size)
    have = sizes.groupBy("filter").agg(F.count_distinct("_t").alias("tables"))
    each = sizes.groupBy("filter", "key").agg(F.count_distinct("_t").alias("n"), F.count_distinct("value").alias("values"))
    if not each.join(have, "filter").filter("n <> tables or values > 1").isEmpty():
        raise ValueError("the tables have different sizes of chromosomes")
    return out.groupBy("filter", "key").agg(F.when(F.first(size), F.first("value")).otherwise(F.sum("value")).alias("value"))


def summary(counts: DataFrame) -> DataFrame:
    """(filter, frac_cis, frac_cis_Nkb+, frac_dups) of a table of counts (filter, key, value); a share
    of nothing is 0."""
    wide = counts.filter(F.col("key").isin(*COUNTS, *CIS_THRESHOLDS)).groupBy("filter").agg(
        *[F.coalesce(F.sum(F.when(F.col("key") == k, F.col("value"))), F.lit(0)).alias(k) for k in [*COUNTS, *CIS_THRESHOLDS]]
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(f"`{a}`") / F.col(b)).otherwise(0.0)
    return wide.select(
        "filter",
        *[share(k, "total_nodups").alias(f"frac_{k}") for k in ["cis", *CIS_THRESHOLDS]],
        share("total_dups", "total_mapped").alias("frac_dups"),
    )


def complexity(n_mapped: int, n_dups: int, n_optical: int = 0) -> float:
    return estimate_complexity(n_mapped, n_dups, n_optical)


def convergence(dist_freq: Mapping[str, Sequence[float]], edges: Sequence[int], threshold: float = 0.05) -> dict:
    """The distance from which on the four strand combinations are equally frequent, up to threshold
    of their mean, with the pairs below and above. dist_freq: counts by bin for each combination, a
    table of a few hundred numbers. The combination that deviates at the farthest bin decides, the
    first in the order ++ -- -+ +- of several; a deviation in the first bin alone doesn't count."""
    table = np.array([list(dist_freq[s]) for s in STRANDS], float)
    mean = table.mean(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.nan_to_num(np.abs(table - mean) / mean) > threshold
    farthest = [int(np.nonzero(row)[0].max()) if row.any() else 0 for row in off]
    best = max(farthest)
    strands = STRANDS[farthest.index(best)] if best > 0 else "??"
    distance = 0 if best == 0 else (int(edges[best + 1]) if best + 1 < len(edges) else math.inf)
    below, above = table[:, : best + 1].sum(axis=1), table[:, best + 1 :].sum(axis=1)
    return {
        "convergence_dist": distance,
        "strands_w_max_convergence_dist": strands,
        "convergence_rel_diff_threshold": threshold,
        "n_cis_pairs_below_convergence_dist": dict(zip(STRANDS, below.tolist())),
        "n_cis_pairs_below_convergence_dist_all_strands": float(below.sum()),
        "n_cis_pairs_above_convergence_dist_all_strands": float(above.sum()),
    }


def convergence_table(dist_freq: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(filter, convergence_bin, strands) by the same rule, computed from dist_freq without leaving Spark."""
    mean = dist_freq.groupBy("filter", "min_dist").agg((F.sum("value") / F.lit(len(STRANDS))).alias("mean"))
    rank = F.create_map(*[x for i, s in enumerate(STRANDS) for x in (F.lit(s), F.lit(i))])[F.col("strands")]
    off = dist_freq.join(mean, ["filter", "min_dist"]).filter(
        (F.col("mean") > 0) & (F.abs(F.col("value") - F.col("mean")) / F.col("mean") > threshold) & (F.col("min_dist") > 0)
    )
    best = off.groupBy("filter").agg(F.max(F.struct("min_dist", (-rank).alias("r"), "strands")).alias("b"))
    every = dist_freq.select("filter").distinct()
    return every.join(best, "filter", "left").select(
        "filter", F.coalesce("b.min_dist", F.lit(0)).alias("convergence_bin"), F.coalesce("b.strands", F.lit("??")).alias("strands")
    )


def tile(read_id: str):
    """Fields 3 to 5 of an Illumina read name."""
    return F.array_join(F.slice(F.split(F.col(read_id), ":"), 3, 3), ":")


def tile_duplicates(dups: DataFrame, read_id: str = "readID", parent: str = "parent_readID", regex: str | None = None) -> DataFrame:
    """(tile, parent_tile, dup_count) of duplicates, the two tiles of a pair in order. regex: three or
    more groups, the first three of which name the tile."""
    name = lambda c: tile(c) if regex is None else F.concat_ws(":", *[F.regexp_extract(c, regex, i) for i in (1, 2, 3)])
    a, b = name(read_id), name(parent)
    return dups.groupBy(F.least(a, b).alias("tile"), F.greatest(a, b).alias("parent_tile")).agg(F.count(F.lit(1)).alias("dup_count"))


def tile_summary(tiles: DataFrame, n_mapped: int, n_dups: int) -> dict:
    """Duplicates that tiles share by chance or optics (median count times pairs of tiles), and the
    complexity without them."""
    n, median = tiles.agg(F.count(F.lit(1)), F.median("dup_count")).first()
    by_tile = round((median or 0) * n)
    return {"dups_by_tile_median": by_tile, "complexity_dups_by_tile_median": complexity(n_mapped, n_dups, n_dups - by_tile)}


def summaries(long: DataFrame, tiles: DataFrame | None = None) -> dict[str, dict[str, object]]:
    """{filter: {key: value}} of everything that is computed from a long table of counts: shares, naive
    complexity, the convergence of strands with its pairs and their shares, and with tiles (see
    tile_duplicates) what they give for all rows. A share of nothing is 0. A few hundred numbers of each
    filter are collected. A table without distances has no convergence."""
    counts: dict[str, dict[str, float]] = {}
    needed = F.col("key").isin(*COUNTS, *CIS_THRESHOLDS) | F.col("key").startswith(DISTANCES)
    for r in long.filter(needed).collect():
        counts.setdefault(r["filter"], {})[r["key"]] = r["value"]
    out: dict[str, dict[str, object]] = {}
    for row in summary(long).collect():
        name = row["filter"]
        own = counts[name]
        got = {f"summary/{k}": v for k, v in row.asDict().items() if k != "filter"}
        got["summary/complexity_naive"] = complexity(own.get("total_mapped", 0), own.get("total_dups", 0))
        freq = {tuple(k.removeprefix(DISTANCES).rsplit("/", 1)): v for k, v in own.items() if k.startswith(DISTANCES)}
        edges = {int(label.rstrip("+").split("-")[0]): label for label, _ in freq}
        if edges:
            labels = [edges[e] for e in sorted(edges)]
            got |= _convergence_keys(convergence({x: [freq.get((b, x), 0) for b in labels] for x in STRANDS}, sorted(edges)), own)
        if tiles is not None and name == NO_FILTER and not tiles.isEmpty():
            t = tile_summary(tiles, own["total_mapped"], own["total_dups"])
            got |= {"dups_by_tile_median": t["dups_by_tile_median"], "summary/complexity_dups_by_tile_median": t["complexity_dups_by_tile_median"]}
        out[name] = got
    return out


def _convergence_keys(near: dict, own: Mapping[str, float]) -> dict[str, object]:
    at = "summary/dist_freq_convergence/"
    below = near.pop("n_cis_pairs_below_convergence_dist")
    got = {f"{at}{k}": v for k, v in near.items()} | {f"{at}n_cis_pairs_below_convergence_dist/{x}": v for x, v in below.items()}
    for norm in ("cis", "total_mapped", "total_nodups"):
        n = own.get(norm, 0)
        got |= {f"{at}frac_{norm}_in_cis_below_convergence_dist/{x}": v / n if n else 0.0 for x, v in below.items()}
        for side in ("below", "above"):
            v = near[f"n_cis_pairs_{side}_convergence_dist_all_strands"]
            got[f"{at}frac_{norm}_in_cis_{side}_convergence_dist_all_strands"] = v / n if n else 0.0
    return got


def full_summary(s: PairStats, tiles: DataFrame | None = None) -> dict[str, dict[str, object]]:
    return summaries(s.long(), tiles)
