"""Per-key results of skewed tables by value-frequency compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.runtime import Scratch, hot_limit, join_unique

#: Bits of the value that one pass of the percentile selection settles.
RADIX = 14


def unordered(a: str, b: str) -> tuple[Column, Column]:
    """The lesser and the greater of two columns; both null if either is."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


class ValueFrequencies:
    """df compressed to (keys, value, n). Rows are first grouped by key and value, which partial
    aggregation shrinks before the shuffle and which spreads a hot key over its values; everything per
    key is then computed from the weighted values. A null in a key is a key of its own; null values
    count as rows but not as values."""

    def __init__(self, df: DataFrame, keys: Sequence[str], value: Column):
        self.keys = list(keys)
        self.scratch = Scratch(df.sparkSession, "frequency")
        self.freq = self.scratch.write(
            df.select(*self.keys, value.alias("value")).groupBy(*self.keys, "value").agg(F.count(F.lit(1)).alias("n"))
        )

    def rows(self) -> int:
        return self.freq.agg(F.sum("n")).first()[0] or 0

    def totals(self) -> DataFrame:
        return self.freq.groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def shares_above(self, share: float) -> DataFrame:
        """Keys without nulls that hold more than share of all rows, with their n."""
        return self.totals().dropna(subset=self.keys).filter(F.col("n") > F.lit(share) * F.lit(self.rows()))

    def summary(self) -> DataFrame:
        """(keys, n, n_values, n_distinct, mode): mode is the most frequent value, of equally
        frequent ones the least; null for a key without values."""
        w = F.when(F.col("value").isNotNull(), F.struct(F.col("n"), (-F.col("value")).alias("m"))) if self._numeric() else None
        best = F.max(w)["m"] if w is not None else None
        out = self.freq.groupBy(*self.keys).agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
            F.count("value").alias("n_distinct"),
            (-best if best is not None else F.min_by("value", F.struct(-F.col("n"), "value"))).alias("mode"),
        )
        return out

    def _numeric(self) -> bool:
        return self.freq.schema["value"].dataType.simpleString() in ("int", "bigint")

    def percentiles(self, shares: Sequence[float]) -> DataFrame:
        """(keys, share, percentile): the least value that at least share of a key's values do not
        exceed; exact, for whole-number values. Keys without values have no row.

        The values' leading bits are settled in passes: a pass adds up the weights by the next RADIX
        bits and keeps, for each key and share, the part in which the rank falls. So no task sorts a
        key's values, only at most 2**RADIX part sums."""
        freq = self.freq.filter("value is not null").select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("value").cast("long").alias("value"), "n"
        )
        names = [f"_k{i}" for i in range(len(self.keys))]
        key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        freq = self.scratch.write(freq.withColumn("key", key))
        lo, hi = freq.agg(F.min("value"), F.max("value")).first()
        bits = max(1, *(abs(x).bit_length() + 1 for x in (lo or 0, hi or 0)))
        passes = -(-bits // RADIX)
        count = freq.groupBy("key", *names).agg(F.sum("n").alias("total"))
        ranks = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(p)))).cast("long").alias("rank"), F.lit(None).cast("long").alias("prefix")) for p in shares])
        targets = self.scratch.write(count.select("key", *names, ranks.alias("targets")))
        values = freq.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        limit = hot_limit(freq.count())
        hot = [] if values.filter(F.col("_n") > limit).isEmpty() else values.filter(F.col("_n") > limit).select("key")
        for k in reversed(range(passes)):
            shift = k * RADIX
            joined = join_unique(freq.select("key", "value", "n"), targets.select("key", "targets"), ["key"], hot=hot)
            each = joined.select("key", "value", "n", F.explode("targets").alias("t")).filter(
                F.col("t.prefix").isNull() | (F.shiftright("value", shift + RADIX) == F.col("t.prefix"))
            )
            sums = each.groupBy("key", "t.share", "t.rank", F.shiftright("value", shift).alias("part")).agg(F.sum("n").alias("n"))
            w = W.partitionBy("key", "share").orderBy("part")
            reached = sums.withColumn("upto", F.sum("n").over(w)).filter(
                (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
            )
            found = reached.groupBy("key").agg(
                F.collect_list(F.struct("share", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("part").alias("prefix"))).alias("targets")
            )  # one entry for each share
            following = self.scratch.write(targets.drop("targets").join(found, "key"))
            targets = following
        return targets.select(*[F.col(n).alias(k) for n, k in zip(names, self.keys)], F.explode("targets").alias("t")).select(
            *self.keys, F.col("t.share").alias("share"), F.col("t.prefix").alias("percentile")
        )
