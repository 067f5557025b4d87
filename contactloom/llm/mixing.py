"""Sources mixed to target shares by fitting a budget of tokens."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.runtime import Scratch, join_unique

#: Tokens left to the first dynamic programme, and rows of one length that are ranked in one place.
EXACT_BUDGET, RANKED_ROWS = 1 << 16, 4096


def blank_tokens(text: str = "text") -> Column:
    """Number of longest runs of characters other than blank, tab, CR and LF. Null text has none."""
    marked = F.regexp_replace(F.col(text), "[^ \\t\\r\\n]++[ \\t\\r\\n]*+", "x")
    return F.coalesce(F.length(F.ltrim(F.translate(marked, "\t\r\n", "   "))), F.lit(0)).cast("long")


def bpe_tokens(ranks_file: str, pattern: str, text: str = "text") -> Column:
    """Number of tokens by a byte-pair vocabulary file (lines of base64 token and rank)."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda x: len(enc.encode_ordinary(x)) if isinstance(x, str) else 0)

    return count(F.col(text))


def fit_budget(sizes: list[tuple[int, int]], budget: int, exact: int = EXACT_BUDGET) -> dict[int, int]:
    """How many records of each size to take, so that their sum is as near to budget as it can be
    without exceeding it. sizes: (size, records). Zero-sized records are never taken.

    A share of each size's records, in proportion, fills the budget but for a remainder; sizes from
    the largest on bring the remainder under exact; there the bounded knapsack is solved by dynamic
    programming. If that leaves a gap, part of what was taken may have been wrong: it is solved again
    with 16 times as much left to the programme, in the end with the whole budget. The result is the
    optimum whatever exact is; a smaller one saves memory where the budget can be reached early."""
    sizes = sorted((s, n) for s, n in sizes if s > 0 and n > 0)
    total = sum(s * n for s, n in sizes)
    if budget >= total:
        return dict(sizes)
    if budget <= 0:
        return {}
    unit = math.gcd(*(s for s, _ in sizes))
    sizes, total, budget = [(s // unit, n) for s, n in sizes], total // unit, budget // unit
    while True:
        take = {s: n * max(0, budget - exact) // total for s, n in sizes}
        left = budget - sum(s * n for s, n in take.items())
        for s, n in reversed(sizes):
            if left <= exact:
                break
            more = min(n - take[s], (left - exact + s - 1) // s, left // s)
            take[s] += more
            left -= more * s
        chosen, gap = _knapsack([(s, n - take[s]) for s, n in sizes], left)
        if not gap or exact >= budget:
            return {s * unit: n + chosen.get(s, 0) for s, n in take.items()}
        exact = max(1, exact) * 16


def _knapsack(sizes: list[tuple[int, int]], budget: int) -> tuple[dict[int, int], int]:
    """How many of each size have the largest sum within budget, and what of it is left over.

    Reachable sums are kept as the bits of one integer, and for each sum the part by which it was
    first reached, so memory is a few bytes for each token of budget whatever the number of sizes."""
    parts: list[tuple[int, int]] = []
    for s, n in sizes:
        free, k = min(n, budget // s), 1
        while free > 0:
            k = min(k, free)
            parts.append((s, k))
            free -= k
            k *= 2
    mask = (1 << (budget + 1)) - 1
    reach, by = 1, np.full(budget + 1, -1, np.int32)
    for i, (s, k) in enumerate(parts):
        new = (reach << (s * k)) & mask & ~reach
        if not new:
            continue
        low = (new & -new).bit_length() - 1
        low -= low % 8
        bits = np.unpackbits(np.frombuffer((new >> low).to_bytes(-(-(new.bit_length() - low) // 8), "little"), np.uint8), bitorder="little")
        by[low + np.nonzero(bits)[0]] = i
        reach |= new
        if reach >> budget & 1:
            break
    best = reach.bit_length() - 1
    gap, out = budget - best, {}
    while best:  # a sum's part comes after all parts of what is left of the sum
        s, k = parts[by[best]]
        out[s] = out.get(s, 0) + k
        best -= s * k
    return out, gap


class Mixture:
    """Documents of the sources in targets, taken so that each source makes up its target share.

    documents: (doc_id, source, text); targets: (source, target_share, max_repeats), one row each.
    T is the tokens of all documents whose source is in targets. A source's want is its share of T;
    it is taken whole as often as fits, at most max_repeats times, and the rest of its want is fitted
    from its documents counted by exact token length. Documents of other or of null sources are left
    out; a source without documents contributes nothing; null shares or repeats count as 0."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokens: Column | None = None, seed: int = 42):
        self.scratch = Scratch(documents.sparkSession, "mix")
        self.seed = seed
        self.targets = targets.select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"),
        ).filter("source is not null")
        counted = documents.select("doc_id", "source", (blank_tokens() if tokens is None else tokens).alias("tokens"))
        wanted = self.targets.select("source")
        self.counted = self.scratch.write(counted.join(wanted, "source", "left_semi"))
        #: by source and exact length, the compressed form that everything else is computed from
        self.lengths = self.scratch.write(self.counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")))
        self.total = self.lengths.agg(F.sum(F.col("tokens") * F.col("docs"))).first()[0] or 0

    def own(self) -> DataFrame:
        own = self.lengths.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("docs")).alias("own_tokens"), F.sum("docs").alias("docs")
        )
        zero = F.lit(0).cast("long")
        return self.targets.join(own, "source", "left").withColumns(
            {
                "own_tokens": F.coalesce("own_tokens", zero),
                "docs": F.coalesce("docs", zero),
                "want": F.col("target_share") * F.lit(self.total),
            }
        )

    def short_sources(self) -> DataFrame:
        """Sources that cannot reach their share even when repeated max_repeats times: those of which
        the plan takes every document max_repeats times (or that have none) and still falls short."""
        left = self.own().join(self.taken(), "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        return left.filter((F.col("taken") == F.col("own_tokens") * F.col("max_repeats")) & (F.col("taken") < F.col("want"))).select("source")

    def taken(self) -> DataFrame:
        """(source, taken): the tokens that the plan takes of each source that has documents."""
        return self.plan().groupBy("source").agg(F.sum((F.col("docs") * F.col("whole") + F.col("take")) * F.col("tokens")).alias("taken"))

    def plan(self) -> DataFrame:
        """(source, tokens, docs, whole, take): every document of that length is taken whole times,
        and take of them once more. One task sees a source's distinct lengths, not its documents."""
        own = self.own().select("source", "own_tokens", "max_repeats", "want").filter("own_tokens > 0")
        rows = self.lengths.join(F.broadcast(own), "source") if self.targets.count() < 10_000 else self.lengths.join(own, "source")
        return self.scratch.write(rows.groupBy("source").applyInPandas(_fit_source, "source string, tokens long, docs long, whole long, take long"))

    def select(self) -> DataFrame:
        """(doc_id, source, tokens, copies) for each document taken at least once. Which documents of
        a length are taken once more is decided by a seeded hash of doc_id; a length that many
        documents have is ranked in slices of the hash, so no slice is larger than about RANKED_ROWS."""
        plan = self.plan()
        unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(self.seed)), F.lit(1 << 30)).cast("long")
        slices = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANKED_ROWS)).cast("long")
        hot = plan.filter(F.col("docs") > F.lit(RANKED_ROWS)).select("source", "tokens")
        hot = hot if hot.count() <= 512 else None
        placed = join_unique(self.counted, plan, ["source", "tokens"], hot=hot).withColumn("unit", unit)
        placed = self.scratch.write(placed.withColumn("slice", F.shiftright(F.col("unit") * slices, 30)))
        key = ["source", "tokens"]
        per_slice = placed.filter("take > 0").groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("here"))
        # at most one row for RANKED_ROWS documents, so a length's slices are few
        before = per_slice.withColumn(
            "before", F.sum("here").over(W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
        ).drop("here")
        ranked = placed.join(before, [*key, "slice"], "left").withColumn(
            "rank", F.row_number().over(W.partitionBy(*key, "slice").orderBy("unit", "doc_id"))
        )
        extra = (F.coalesce("before", F.lit(0)) + F.col("rank") <= F.col("take")).cast("long")
        return (
            ranked.withColumn("copies", F.col("whole") + extra)
            .filter("copies > 0")
            .select("doc_id", "source", "tokens", "copies")
        )

    def report(self) -> DataFrame:
        """(source, target_share, own_tokens, taken_tokens, actual_share, short, gap) from the plan; gap:
        the whole tokens by which the plan misses what the source could give, 0 where the fit is exact."""
        taken = self.scratch.write(self.taken())
        rows = self.own().join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        all_taken = taken.agg(F.sum("taken")).first()[0] or 0
        share = F.col("taken") / F.lit(all_taken) if all_taken else F.lit(0.0)
        could = F.least(F.floor("want"), F.col("own_tokens") * F.col("max_repeats"))
        return rows.select(
            "source", "target_share", "own_tokens", F.col("taken").alias("taken_tokens"), share.alias("actual_share"),
            (F.col("own_tokens") * F.col("max_repeats") < F.col("want")).alias("short"), (could - F.col("taken")).alias("gap"),
        )


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    own, repeats, want = int(rows.own_tokens[0]), int(rows.max_repeats[0]), int(rows.want[0])
    whole = min(repeats, want // own)
    take: dict[int, int] = {}
    if whole < repeats:
        take = fit_budget(list(zip(rows.tokens.tolist(), rows.docs.tolist())), want - whole * own)
    out = rows[["source", "tokens", "docs"]].copy()
    out["whole"] = whole
    out["take"] = [take.get(t, 0) for t in rows.tokens.tolist()]
    return out
