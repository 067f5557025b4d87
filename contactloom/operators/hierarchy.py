"""Parent-child rows as full hierarchies: root, depth, path and descendants, loops told apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.runtime import Scratch, hot_limit, join_unique


def hierarchy(rows: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """(keys, node, root, depth, path array) once for each node, by joins of a frontier that starts
    from the roots.

    A node whose parent is null, empty or no node of the same keys is a root of depth 0. Every other
    node waits on an ancestor, at first its parent, and knows the path from it. In a round it is joined
    with that ancestor's row: if the ancestor is reached, so is the node, by the ancestor's path and its
    own; else it waits on what the ancestor waits on, which doubles the band of levels that the next
    round reaches, so that a chain of n levels takes log n rounds of one join each. When a round reaches
    nothing, what is left never gets to a root: those nodes have a null root, depth -1 and an empty path.
    A repeated row counts once; of different parents of a node the least counts (a null or empty one
    only if there is no other); rows with a null or empty node, or a null key, are left out."""
    keys = list(keys)
    scratch = Scratch(rows.sparkSession, "tree")
    named = F.when(F.col(parent) != "", F.col(parent))
    nodes = scratch.write(
        rows.select(*keys, F.col(node).alias("node"), named.alias("anc"))
        .filter((F.col("node") != "") & F.col("node").isNotNull())
        .dropna(subset=keys)
        .groupBy(*keys, "node")
        .agg(F.min("anc").alias("anc"))
    )
    on = [*keys, "anc"]
    below = [*keys, "node", "anc", F.array("node").alias("path")]
    ids = nodes.select(*keys, F.col("node").alias("anc"), F.lit(True).alias("known"))
    first = join_unique(nodes, ids, on, "left", hot=_hot(nodes, on, nodes.count())).withColumn("anc", F.when(F.col("known"), F.col("anc")))
    state = scratch.write(first.select(*below))
    written = [state]
    # all rounds' tables are one scan; what a round reached is in its table, what waits in the last
    reached = lambda: scratch.read(written).filter("anc is null")
    waiting = state.filter("anc is not null")
    left = waiting.count()
    while left:
        above = reached().unionByName(waiting).select(*keys, F.col("node").alias("anc"), F.col("anc").alias("higher"), F.col("path").alias("above"))
        hot = _hot(waiting, on, left) if left > hot_limit(left) else []
        step = join_unique(waiting, above, on, hot=hot).select(
            *keys, "node", F.col("higher").alias("anc"), F.concat("above", "path").alias("path")
        )
        state = scratch.write(step)
        written.append(state)
        waiting, before = state.filter("anc is not null"), left
        left = waiting.count()
        if left == before:
            break
    looped = waiting.select(
        *keys, "node", F.lit(None).cast("string").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path")
    )
    found = reached().select(*keys, "node", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth"), "path")
    return found.unionByName(looped)


def _hot(rows: DataFrame, on: Sequence[str], n: int) -> DataFrame:
    """Keys with more of n rows than hot_limit allows."""
    counts = rows.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > hot_limit(n)).select(*on)


def descendants(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ancestor, descendant, distance) for each node and each node above it, from the paths."""
    each = tree.select(*keys, "node", "depth", F.posexplode("path").alias("at", "ancestor")).filter(F.col("at") < F.col("depth"))
    return each.select(*keys, "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
