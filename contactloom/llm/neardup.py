"""Near-duplicate contacts by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.grid import block_numbers, stars
from contactloom.llm.groups import hash_to_min
from contactloom.runtime import Scratch, hot_limit, join_unique

#: Width of a block of positions that is compared in one place, and points to a task.
BLOCK, POINTS_PER_TASK = 1024, 50_000
SIDE = ["ca", "sa", "cb", "sb"]
POINT = [*SIDE, "pa", "pb"]


def canonical(pairs: DataFrame, unmapped: str = "!") -> DataFrame:
    """Rows with both sides mapped, sides in the order of (chrom, strand, pos).

    If chrom and strand differ between the sides, that order alone decides which sides can match. If
    they are equal, both ways of matching two rows are possible, and with the positions sorted the
    straight way is within the tolerance whenever either is."""
    s1, s2 = (
        F.struct(F.col(f"chrom{i}").alias("c"), F.col(f"strand{i}").alias("s"), F.col(f"pos{i}").alias("p")) for i in (1, 2)
    )
    need = [f"{k}{i}" for k in ("chrom", "pos", "strand") for i in (1, 2)]
    ends = pairs.select("pair_no", *need).dropna().filter((F.col("chrom1") != unmapped) & (F.col("chrom2") != unmapped))
    low, high = F.least(s1, s2), F.greatest(s1, s2)
    return ends.select(
        "pair_no",
        low["c"].alias("ca"), low["s"].alias("sa"), high["c"].alias("cb"), high["s"].alias("sb"),
        low["p"].cast("long").alias("pa"), high["p"].cast("long").alias("pb"),
    )


def ring_candidates(block: np.ndarray, p: np.ndarray, q: np.ndarray, quota: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, viable): pairs of points of one block with an equal segment, and whether their ring has a
    viable chain there.

    Both positions of a point in thermometer code (a bit for each threshold below it) make one binary
    vector, whose Hamming distance is the sum of the differences of the positions; points that match
    are at most 2 * quota apart. The thresholds are dealt to segments = 2 * quota + 1 segments in turn,
    so segment r of a position is told by floor((position + r) / segments), and by how much two of
    these numbers differ is by how many bits the segments do. There are more segments than differing
    bits; so, with a budget of 2 * quota / segments for each, some segment begins a chain whose first l
    segments, for every l, differ in no more than l times that budget: not at all for l = 1, by l - 1
    bits at most for longer ones. Candidates are points with an equal first segment; those without such
    a chain from it on are left before any full check."""
    segments = 2 * quota + 1
    # segment by segment, so that of the segments' numbers only two are in memory
    for r in range(segments):
        x, y = (p + r) // segments, (q + r) // segments
        cell = block_numbers(y, x, block)
        order = np.argsort(cell, kind="stable")
        cell, at, step = cell[order], np.arange(len(order)), 1
        while len(at := at[at + step < len(cell)]) and len(at := at[cell[at] == cell[at + step]]):
            i, j = order[at], order[at + step]
            viable, bits = np.ones(len(i), bool), np.zeros(len(i), np.int64)
            for l in range(2, segments + 1):
                k = r + l - 1
                for z in (p, q):
                    bits += np.abs((z[i] + k) // segments - (z[j] + k) // segments)
                viable &= bits <= l - 1
            yield i, j, viable
            step += 1


def ring_edges(batch: pa.Table, quota: int) -> pa.Table:
    """Links between points of the same block whose positions differ by at most quota each, joined to
    links with the least point of what they connect. Candidates come from ring_candidates; those with a
    viable chain get the full check. Points are distinct, so a segment's cell holds at most
    (2 * quota + 1)**2 of them whatever a contact's copies number."""
    side = batch["side"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ba, bb, p, q, rep = (batch[c].to_numpy() for c in ("ba", "bb", "pa", "pb", "rep"))
    p, q = p - ba * BLOCK + quota, q - bb * BLOCK + quota
    out = [(np.empty(0, np.int64),) * 2]
    for i, j, viable in ring_candidates(block_numbers(bb, ba, side), p, q, quota):
        i, j = i[viable], j[viable]
        full = (np.abs(p[i] - p[j]) <= quota) & (np.abs(q[i] - q[j]) <= quota)
        out.append((rep[i[full]], rep[j[full]]))
    a, b = stars(*(np.concatenate(x) for x in zip(*out)))
    return pa.table({"a": a, "b": b})


def contact_groups(pairs: DataFrame, tolerance: int = 3) -> DataFrame:
    """(pair_no, group_no) for each row of a group of at least two rows that record the same contact
    within tolerance on each side, sides exchanged or not, directly or through other rows.

    Equal contacts are one point before anything is compared, so a contact that holds a third of all
    rows is a single point. A point is sent to the block of its positions and, near a border, to the
    one before, so that any two close points meet; no block is compared with another. Rows with a
    null in chrom, pos or strand count as unmapped and, like rows with a null pair_no, have no group."""
    spark = pairs.sparkSession
    scratch = Scratch(spark, "contacts")
    rows = canonical(pairs)
    points = scratch.write(rows.groupBy(*POINT).agg(F.min("pair_no").alias("rep"), F.count(F.lit(1)).alias("n")))
    size = points.agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    tasks = max(1, size["points"] // POINTS_PER_TASK, min(spark.sparkContext.defaultParallelism, size["points"] // 5000))
    blocks = lambda c: F.array_distinct(F.array(F.floor(c / BLOCK), F.floor((c - tolerance) / BLOCK)))
    placed = (
        points.select(F.concat_ws("\t", *SIDE).alias("side"), "pa", "pb", "rep")
        .withColumn("ba", F.explode(blocks(F.col("pa"))))
        .withColumn("bb", F.explode(blocks(F.col("pb"))))
        .withColumn("task", F.pmod(F.xxhash64("side", "ba", "bb"), F.lit(tasks)))
    )
    edges = scratch.write(
        placed.groupBy("task").applyInArrow(lambda t: ring_edges(t, tolerance), "a long, b long").distinct()
    )
    roots = hash_to_min(edges, "a", "b", scratch).withColumnsRenamed({"vertex": "rep", "root": "group_no"})
    grouped = scratch.write(
        points.join(roots, "rep", "left")
        .filter((F.col("n") > 1) | F.col("group_no").isNotNull())
        .select(*POINT, "n", F.coalesce("group_no", "rep").alias("group_no"))
    )
    limit = hot_limit(size["rows"])
    hot = grouped.filter(F.col("n") > limit).select(*POINT) if (size["most"] or 0) > limit else []
    return join_unique(rows, grouped.drop("n"), POINT, hot=hot).select("pair_no", "group_no")
