"""Inputs of the pair operators made from the given tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.schema import PAIRS_COLUMNS

FRAGMENT_STEP = 50_000


def pairs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The pairs table with the format's column names; pair_no is the input order (_ord)."""
    df = spark.read.parquet(f"{sf_dir}/pairs.parquet").withColumnsRenamed({"readid": "readID", "pair_no": "_ord"})
    return df.select(*PAIRS_COLUMNS, *more, "_ord")


def chrom_order(spark: SparkSession, sf_dir: str, listed: int = 20) -> list[str]:
    """The first chromosomes of chromsizes by rank; the rest are left unlisted, as scaffolds often are."""
    sizes = spark.read.parquet(f"{sf_dir}/chromsizes.parquet").filter(F.col("chrom_rank") <= listed)
    return [r.chrom for r in sizes.orderBy("chrom_rank").collect()]


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BED table with a cut every FRAGMENT_STEP bases and one at the end of each chromosome."""
    sizes = spark.read.parquet(f"{sf_dir}/chromsizes.parquet")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chrom_len") - 1, F.lit(FRAGMENT_STEP).cast("long")))
    return sizes.select("chrom", "chrom_len", starts.alias("start")).select(
        "chrom", "start", F.least(F.col("start") + FRAGMENT_STEP, "chrom_len").alias("end")
    )


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions for each chromosome."""
    sizes = spark.read.parquet(f"{sf_dir}/chromsizes.parquet")
    half = F.floor(F.col("chrom_len") / 2)
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("start"), half.alias("end")), F.struct(half.alias("start"), F.col("chrom_len").alias("end"))
    )
    return sizes.select("chrom", F.explode(ends).alias("r")).select("chrom", "r.*")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with haplotype suffixes and tags of best hits, made from their positions."""
    df = pairs(spark, sf_dir)
    out = {}
    for i in (1, 2):
        p, c = F.col(f"pos{i}"), F.col(f"chrom{i}")
        own = F.when(p % 2 == 0, F.lit("_hap1")).otherwise(F.lit("_hap2"))
        other = F.when(p % 7 == 0, own).when(p % 2 == 0, F.lit("_hap2")).otherwise(F.lit("_hap1"))
        best, second = F.lit(40) + p % 3, F.lit(40) + p % 5
        nm, alt = p % 2, p % 4
        first = F.concat_ws(",", F.concat(c, other), F.concat(F.lit("+"), p.cast("string")), F.lit("50M"))
        after = F.concat_ws(",", F.lit("chr9_hap1"), F.lit("+1"), F.lit("50M"))
        xb1, xb2 = (F.concat_ws(",", x, alt.cast("string"), s.cast("string"), F.lit("60")) for x, s in ((first, second), (after, F.lit(40) + p % 4)))
        xa1, xa2 = (F.concat_ws(",", x, alt.cast("string")) for x in (first, after))
        hits = lambda a, b, p=p: F.when(p % 11 == 0, F.lit("")).when(p % 3 == 0, F.concat(a, F.lit(";"), b, F.lit(";"))).otherwise(F.concat(a, F.lit(";")))
        out |= {f"chrom{i}": F.when(c == "!", c).otherwise(F.concat(c, own)), f"AS{i}": best, f"XS{i}": second, f"NM{i}": nm, f"XB{i}": hits(xb1, xb2), f"XA{i}": hits(xa1, xa2)}
    return df.withColumns(out)


def pairsam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with one SAM entry for each side."""
    df = pairs(spark, sf_dir)
    sep = "\x19"
    entry = lambda i: F.concat_ws(sep, "readID", F.when(F.col(f"strand{i}") == "+", "65").otherwise("81"), f"chrom{i}", F.col(f"pos{i}").cast("string"), F.lit("60"), F.lit("50M"), F.concat(F.lit("Yt:Z:"), "pair_type"))
    return df.withColumns({f"sam{i}": entry(i) for i in (1, 2)})


PAIRS_SQL = """
SELECT readid AS "readID", chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type, pair_no FROM pairs
"""

FRAGMENTS_SQL = f"""
SELECT chrom, s AS lo0, least(s + {FRAGMENT_STEP}, chrom_len) AS hi0 FROM chromsizes, unnest(range(0, chrom_len, {FRAGMENT_STEP})) AS u(s)
"""

ARMS_SQL = """
SELECT chrom, 0::BIGINT AS s, chrom_len // 2 AS e FROM chromsizes
UNION ALL SELECT chrom, chrom_len // 2, chrom_len FROM chromsizes
"""


def tagged_sql() -> str:
    cols = []
    for i in (1, 2):
        p, c = f"pos{i}", f"chrom{i}"
        own = f"CASE WHEN {p} % 2 = 0 THEN '_hap1' ELSE '_hap2' END"
        other = f"CASE WHEN {p} % 7 = 0 THEN {own} WHEN {p} % 2 = 0 THEN '_hap2' ELSE '_hap1' END"
        cols += [
            f"{c} AS raw{i}", f"CASE WHEN {c} = '!' THEN '!' ELSE {c} || {own} END AS c{i}", f"{own} AS own{i}", f"{other} AS other{i}",
            f"40 + {p} % 3 AS as{i}", f"40 + {p} % 5 AS xs{i}", f"{p} % 2 AS nm{i}", f"{p} % 4 AS alt{i}", f"40 + {p} % 4 AS s3{i}",
            f"CASE WHEN {p} % 11 = 0 THEN 0 WHEN {p} % 3 = 0 THEN 2 ELSE 1 END AS hits{i}",
        ]
    return f'SELECT readid AS "readID", pos1, pos2, strand1, strand2, pair_type, pair_no, {", ".join(cols)} FROM pairs'


def sam_lines(spark: SparkSession, sf_dir: str, chimeric: bool = False) -> DataFrame:
    """SAM lines (value, _ord) that tell of the pairs: one alignment of 50 bases for each side, named
    by pair_no. chimeric: the first side of every fourth molecule has a second part elsewhere."""
    df = spark.read.parquet(f"{sf_dir}/pairs.parquet")
    lines = []
    for i, flag in ((1, 65), (2, 129)):
        lines.append(_sam_line(i, F.lit(flag), F.lit("50M"), F.col(f"pos{i}"), F.col(f"chrom{i}") != "!", i))
    if chimeric:
        part = (F.col("pair_no") % 4 == 0) & (F.col("chrom1") != "!") & (F.col("chrom2") != "!")
        lines[0] = _sam_line(1, F.lit(65), F.when(part, "25M25S").otherwise("50M"), F.col("pos1"), F.col("chrom1") != "!", 1)
        lines.append(F.when(part, _sam_line(2, F.lit(2113), F.lit("25S25M"), F.col("pos2") + 300, F.lit(True), 3)))
    out = df.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("x"))
    return out.select("x.value", "x._ord")


def _sam_line(i: int, flag, cigar, pos, mapped, place: int):
    back = F.col(f"strand{i}") == "-"
    full = flag + F.when(mapped & back, 16).otherwise(0) + F.when(mapped, 0).otherwise(4)
    start = F.when(mapped, F.when(back, F.greatest(pos - 49, F.lit(1))).otherwise(pos)).otherwise(0)
    quality = F.when(mapped, F.coalesce(F.col(f"mapq{i}"), F.lit(60))).otherwise(0)
    value = F.concat_ws(
        "\t", F.concat(F.lit("q"), F.col("pair_no").cast("string")), full.cast("string"), F.when(mapped, F.col(f"chrom{i}")).otherwise("*"),
        start.cast("string"), quality.cast("string"), F.when(mapped, cigar).otherwise("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"),
    )
    return F.struct(value.alias("value"), (F.col("pair_no") * 4 + place).alias("_ord"))
