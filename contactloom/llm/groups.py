"""Pairwise matches consolidated into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.runtime import Scratch, hot_limit, join_unique


def hash_to_min(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Connected components of the links (a, b): one row (vertex, root) for each linked vertex,
    root being the least vertex of its component.

    Every vertex v holds a cluster set C(v), at first itself and its neighbours. In a round v sends
    C(v) to its least member m and {m} to every member; the messages a vertex gets are its next set.
    A set is kept as rows (v, u), never as one value, so the large set of a large component's least
    vertex is spread over tasks. The rounds end when every vertex other than the least of its own
    set holds a single member; the sets then are stars around the roots.

    Links with a null end are no links; repeated links and links of a vertex with itself change
    nothing; without links the result is empty. Rounds grow with the logarithm of the diameter."""
    kind = edges.schema[a].dataType
    links = edges.select(F.col(a).alias("x"), F.col(b).cast(kind).alias("y")).dropna().filter("x <> y")
    state = scratch.write(
        links.select(
            F.explode(
                F.array(
                    *[F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v, u in ("xy", "yx", "xx", "yy")]
                )
            ).alias("r")
        )
        .select("r.*")
        .distinct()
    )
    while True:
        mins = scratch.write(state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        size = mins.agg(
            F.sum("n").alias("n"),
            F.max("n").alias("most"),
            F.count_if((F.col("m") < F.col("v")) & (F.col("n") > 1)).alias("open"),
        ).first()
        if not size["open"]:
            break
        limit = hot_limit(size["n"])
        hot = mins.filter(F.col("n") > limit).select("v") if size["most"] > limit else []
        sent = (
            join_unique(state, mins.select("v", "m"), ["v"], hot=hot)
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
                    )
                ).alias("r")
            )
            .select("r.*")
            .distinct()
        )
        following = scratch.write(sent)
        scratch.drop(state, mins)
        state = following
    scratch.drop(state)
    return mins.select(F.col("v").alias("vertex"), F.col("m").alias("root"))


def real_id(c: str):
    """An id is any text but null, empty or a single point."""
    return F.col(c).isNotNull() & ~F.col(c).isin("", ".")


def read_groups(pairs: DataFrame, read: str = "readid", parent: str = "parent_readid") -> DataFrame:
    """(readid, group_id) for every read tied to another read of the table through parent links,
    directly or through ids that are no read of any row.

    Vertices are marked by whether they occur as a read, with those first in order, so the root of a
    component with a read in it is its least read and no second grouping is needed. A read alone in
    its component has no row. Null, empty and '.' ids link nothing; extra columns don't matter."""
    scratch = Scratch(pairs.sparkSession, "groups")
    ids = pairs.select(F.col(read).alias("r"), F.col(parent).alias("p"))
    links = ids.filter(real_id("r") & real_id("p") & (F.col("r") != F.col("p"))).distinct()
    links = scratch.write(links)
    reads = ids.select(F.col("r").alias("p")).filter(real_id("p")).distinct()
    parents = links.select("p").distinct()
    known = parents.join(reads, "p", "left_semi").withColumn("known", F.lit(True))
    marked = join_unique(links, known, ["p"], "left").select(
        F.concat(F.lit("0"), "r").alias("a"),
        F.concat(F.when(F.col("known"), F.lit("0")).otherwise(F.lit("1")), "p").alias("b"),
    )
    rooted = hash_to_min(marked, "a", "b", scratch)
    member = rooted.filter(F.col("vertex").startswith("0") & (F.col("vertex") != F.col("root")))
    strip = lambda c: F.substring(F.col(c), 2, 2**31 - 1)
    others = member.select(strip("vertex").alias("readid"), strip("root").alias("group_id"))
    roots = member.select(strip("root").alias("readid")).distinct().withColumn("group_id", F.col("readid"))
    return others.unionByName(roots)
