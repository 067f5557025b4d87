"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.contamination import PositionalIndex, phrase_matches, proximity_matches
from contactloom.llm.groups import read_groups
from contactloom.llm.mixing import Mixture
from contactloom.llm.neardup import contact_groups
from contactloom.llm.spans import SharedSpans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_groups(_table(spark, sf_dir, "pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_groups(_table(spark, sf_dir, "pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PositionalIndex(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return phrase_matches(index, 12).select("doc_id", "item_id")


def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PositionalIndex(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), ahead=3)
    return proximity_matches(index, 0.8)


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).short_sources()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).select()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p8_mixture takes of each source: tokens, documents, and the difference between the most and
    the fewest copies of one document, of all documents of the source."""
    m = _mixture(spark, sf_dir)
    taken = m.select().groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.sum("copies").alias("copies"),
        F.count(F.lit(1)).alias("docs"), F.count_distinct("doc_id").alias("distinct_docs"), F.max("copies").alias("most"),
    )
    ratio = F.when(F.col("own_tokens") > 0, F.ceil(F.col("taken_tokens") / F.col("own_tokens")))
    return taken.join(m.own().select("source", "own_tokens"), "source").select(
        "source", "taken_tokens", (F.col("docs") == F.col("distinct_docs")).alias("once_each"), (F.col("most") <= ratio).alias("evenly")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_table(spark, sf_dir, "documents")).pairs()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_table(spark, sf_dir, "documents")).spans()


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_table(spark, sf_dir, "documents")).coverage()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p6_found, p7_found, p7_proximity, p8_found, p8_mixture, p8_report, p8_totals, p9_found, p9_spans, p9_coverage)
}
