"""Duplicate pairs: the same contact up to a few bases, found exactly and without windows over a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.grid import block_numbers, cell_candidates, greedy_leaders, stars, within
from contactloom.operators.components import contract
from contactloom.operators.rowwise import is_mapped, mark_as_dup
from contactloom.runtime import Scratch, hot_limit, join_unique

#: Width of a block of positions that is compared in one place, and points to a task.
BLOCK, POINTS_PER_TASK = 4096, 100_000
ENDS = ("chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2")


def _links(batch: pa.Table, reach: int, method: str) -> pa.Table:
    key = batch["key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ba, bb, p, q, pid = (batch[c].to_numpy() for c in ("ba", "bb", "pa", "pb", "pid"))
    block = block_numbers(bb, ba, key)
    out = [(np.empty(0, np.int64),) * 2]
    # positions count from their block, so that the cells of a task fit a number
    p0, q0 = p - ba * BLOCK, q - bb * BLOCK
    for i, j in cell_candidates(block, p0, q0, reach):
        near = within(p0[i] - p0[j], q0[i] - q0[j], reach, method)
        out.append((pid[i[near]], pid[j[near]]))
    a, b = stars(*(np.concatenate(x) for x in zip(*out)))
    return pa.table({"a": a, "b": b})


def _placed(points: DataFrame, reach: int, tasks: int, *more: str) -> DataFrame:
    """Points (key, _pa, _pb) in the blocks of their positions and, near a border, in the block before, so
    that any two within reach meet in the block of the lesser of either position."""
    blocks = lambda c: F.array_distinct(F.array(F.floor(c / BLOCK), F.floor((c - reach) / BLOCK)))
    return (
        points.select("key", F.col("_pa").alias("pa"), F.col("_pb").alias("pb"), *more)
        .withColumn("ba", F.explode(blocks(F.col("pa"))))
        .withColumn("bb", F.explode(blocks(F.col("pb"))))
        .withColumn("task", F.pmod(F.xxhash64("key", "ba", "bb"), F.lit(tasks)))
    )


def _offsets(batch: pa.Table, reach: int) -> pa.Table:
    key = batch["key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ba, bb, p, q, n = (batch[c].to_numpy() for c in ("ba", "bb", "pa", "pb", "n"))
    counts = np.zeros((reach + 1, reach + 1), np.int64)
    for i, j in cell_candidates(block_numbers(bb, ba, key), p - ba * BLOCK, q - bb * BLOCK, reach):
        near = within(p[i] - p[j], q[i] - q[j], reach, "max")
        # of the blocks in which a pair meets it counts in one
        near &= (np.minimum(p[i], p[j]) // BLOCK == ba[i]) & (np.minimum(q[i], q[j]) // BLOCK == bb[i])
        i, j = i[near], j[near]
        np.add.at(counts, (np.abs(p[i] - p[j]), np.abs(q[i] - q[j])), n[i] * n[j])
    own = (p // BLOCK == ba) & (q // BLOCK == bb)
    counts[0, 0] += int((n[own] * (n[own] - 1) // 2).sum())
    d1, d2 = np.nonzero(counts)
    return pa.table({"d1": d1.astype(np.int64), "d2": d2.astype(np.int64), "n": counts[d1, d2]})


def neighbour_offsets(df: DataFrame, reach: int = 3, columns: Sequence[str] = ENDS, unmapped: str = "!") -> DataFrame:
    """(d1, d2, n): how many pairs of mapped rows with equal chromosomes and strands lie d1 and d2 apart on
    their sides, of all that are at most reach apart on both. Rows alike are one point with a count, and
    only counts leave a block, so no pair is ever a row. Rows with a null in these columns count as unmapped."""
    c1, p1, c2, p2, s1, s2 = columns
    scratch = Scratch(df.sparkSession, "offsets")
    rows = df.filter(is_mapped(c1, c2, unmapped)).dropna(subset=list(columns))
    key = F.concat_ws("\1", c1, c2, s1, s2).alias("key")
    points = scratch.write(rows.groupBy(key, F.col(p1).cast("long").alias("_pa"), F.col(p2).cast("long").alias("_pb")).agg(F.count(F.lit(1)).alias("n")))
    tasks = max(1, points.count() // POINTS_PER_TASK, df.sparkSession.sparkContext.defaultParallelism)
    counts = _placed(points, reach, tasks, "n").groupBy("task").applyInArrow(lambda t: _offsets(t, reach), "d1 long, d2 long, n long")
    return counts.groupBy("d1", "d2").agg(F.sum("n").alias("n"))


class Dedup:
    """Clusters of mapped pairs that agree in chromosomes, strands and extra columns and whose
    positions differ by at most max_mismatch on each side (method max) or in sum (method sum).

    backend 'transitive': a cluster is all pairs linked directly or through others, and its first pair
    by order is kept. backend 'greedy': pairs in order; one that is still there removes all later ones
    near it, without chains.

    order: columns that order the input; the default is the read order (_ord), else positions, type
    and name of the pair. extra_pairs: pairs of columns (a, b) that must agree, a of one pair with a
    of the other and b with b. Rows with a null chromosome, position or strand count as unmapped and
    are never duplicates. Rows alike in all of order have an arbitrary but fixed order: mapped rows are
    written once with a row number, and everything else is computed from what was written.

    Equal contacts are one point with a count before anything else, so a contact that holds a third
    of all rows is one point. Points are compared within blocks of positions, and a point near a
    border also in the block before it. No step groups, sorts or windows a chromosome."""

    def __init__(
        self, df: DataFrame, max_mismatch: int = 3, method: str = "max", backend: str = "transitive",
        order: Sequence[str] | None = None, extra_pairs: Sequence[tuple[str, str]] = (), read_id: str = "readID",
        columns: Sequence[str] = ENDS, unmapped: str = "!",
    ):
        c1, p1, c2, p2, s1, s2 = columns
        self.df, self.read_id = df, read_id
        present = F.col(p1).isNotNull() & F.col(p2).isNotNull() & F.col(s1).isNotNull() & F.col(s2).isNotNull()
        self.mapped = is_mapped(c1, c2, unmapped) & present
        if order is None:
            order = ["_ord"] if "_ord" in df.columns else [c for c in (p1, p2, "pair_type", read_id) if c in df.columns]
        keys = [c1, c2, s1, s2, *[c for pair in extra_pairs for c in pair]]
        self.point = [f"_k{i}" for i in range(len(keys))] + ["_pa", "_pb"]
        placed = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)}
        placed |= {"_pa": F.col(p1).cast("long"), "_pb": F.col(p2).cast("long")}
        self.scratch = Scratch(df.sparkSession, "dedup")
        rows = df.filter(self.mapped).withColumns({**placed, "_row": F.monotonically_increasing_id()})
        first = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_row").alias("row"), F.col(read_id).alias("id"))
        self.rows = self.scratch.write(rows).withColumn("_first", first)
        self.clusters = self._clusters(max_mismatch, method, backend)

    def _clusters(self, reach: int, method: str, backend: str) -> DataFrame:
        """(point, _kept): for points of several rows or near others, the first row of the cluster."""
        points = self.rows.groupBy(*self.point).agg(F.min("_first").alias("first"), F.count(F.lit(1)).alias("n"))
        points = self.scratch.write(points.withColumn("pid", F.monotonically_increasing_id()))
        size = points.agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        self.hot_above = hot_limit(size["rows"]) if (size["most"] or 0) > hot_limit(size["rows"]) else None
        if reach == 0:
            return points.filter("n > 1").select(*self.point, "n", F.col("first").alias("_kept"))
        spark = self.df.sparkSession
        tasks = max(1, size["points"] // POINTS_PER_TASK, min(spark.sparkContext.defaultParallelism, size["points"] // 5000))
        placed = _placed(points.withColumn("key", F.concat_ws("\1", *self.point[:-2])), reach, tasks, "pid")
        links = placed.groupBy("task").applyInArrow(lambda t: _links(t, reach, method), "a long, b long")
        roots = contract(links, self.scratch).withColumnRenamed("vertex", "pid")
        joined = self.scratch.write(points.join(roots, "pid", "left").filter("n > 1 or root is not null"))
        joined = joined.withColumn("root", F.coalesce("root", "pid"))
        if backend == "greedy":
            return self._greedy(joined, reach, method, tasks)
        kept = joined.groupBy("root").agg(F.min("first").alias("_kept"))
        return self.scratch.write(joined.join(kept, "root").select(*self.point, "n", "_kept"))

    def _greedy(self, joined: DataFrame, reach: int, method: str, tasks: int) -> DataFrame:
        """A leader removes points of its component only, so components are gone through one by one,
        several to a task, their distinct points in order."""

        def run(batch):
            batch = batch.sort_values(["root", "_pa", "_pb"], kind="stable")  # no two points of a component are equal
            leader = np.empty(len(batch), np.int64)
            root, p, q, pid = (batch[c].to_numpy() for c in ("root", "_pa", "_pb", "pid"))
            cuts = np.r_[0, np.nonzero(root[1:] != root[:-1])[0] + 1, len(root)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                leader[a:b] = pid[a:b][greedy_leaders(p[a:b], q[a:b], reach, method)]
            return batch[["pid"]].assign(leader=leader)

        led = joined.select("root", "_pa", "_pb", "pid", F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"))
        leaders = led.groupBy("task").applyInPandas(run, "pid long, leader long")
        firsts = joined.select(F.col("pid").alias("leader"), F.col("first").alias("_kept"))
        return self.scratch.write(joined.join(leaders, "pid").join(firsts, "leader").select(*self.point, "n", "_kept"))

    def marked(self) -> DataFrame:
        """All mapped pairs with duplicate (true for all but the kept one of a cluster) and
        parent_readID (the kept one's name; a pair's own name if it is kept or alone)."""
        hot = self.clusters.filter(F.col("n") > self.hot_above).select(*self.point) if self.hot_above else []
        out = join_unique(self.rows, self.clusters.drop("n"), self.point, "left", hot=hot)
        out = out.withColumn("duplicate", F.coalesce(F.col("_row") != F.col("_kept.row"), F.lit(False)))
        parent = F.coalesce(F.col("_kept.id"), F.col(self.read_id))
        return out.withColumn("parent_readID", parent).drop(*self.point, "_first", "_row", "_kept")

    def split(self, mark_dups: bool = True, keep_parent_id: bool = False) -> dict[str, DataFrame]:
        """{dedup, dups, unmapped}. mark_dups: duplicates get pair type DD, in SAM entries too.
        keep_parent_id: dups keep parent_readID."""
        marked = self.marked()
        dups = marked.filter("duplicate").drop("duplicate")
        if mark_dups:
            dups = mark_as_dup(dups)
        return {
            "dedup": marked.filter("not duplicate").drop("duplicate", "parent_readID"),
            "dups": dups if keep_parent_id else dups.drop("parent_readID"),
            "unmapped": self.df.filter(~self.mapped),
        }
