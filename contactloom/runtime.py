"""Execution helpers shared by the operators: shared scratch tables that cut lineage,
joins that stay balanced when one key holds most rows, and a lag over sorted ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 512

_local_dirs: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package for their Python workers, once for each application, so that
    jobs run wherever the package is importable on the driver only."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="contactloom-")
    atexit.register(shutil.rmtree, folder, True)
    at = f"{folder}/contactloom-{sc.applicationId}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a plain local session
    without that setting gets a temporary folder of its own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="contactloom-")
        atexit.register(shutil.rmtree, path, True)
        _local_dirs[sc.applicationId] = f"file://{path}"
    return _local_dirs[sc.applicationId]


class Scratch:
    """Tables an operator writes to the shared folder. A written table survives the loss of an
    executor, ends the lineage, and has a known size, so that Spark's own size check decides on
    broadcasts of it. drop() removes a table that is no longer read; the others stay for the lazy
    result and go, on whatever file system, when the session or the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        _clean_at_end(spark)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def read(self, tables: Sequence[DataFrame]) -> DataFrame:
        """Written tables of one schema as one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)


_roots: dict[str, list[str]] = {}
_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean_at_end(spark: SparkSession) -> None:
    """Has the scratch tables of the application removed before its context stops, and local ones that a
    lost context left when the process ends."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _cleaned:
        return
    _cleaned.add(app)
    stop = sc.stop

    def clean_and_stop():
        for root in _roots.pop(app, []):
            try:
                _delete(spark, root)
            except Exception:  # the context may be gone already; local tables go at the process's end
                _delete_local(root)
        stop()

    sc.stop = clean_and_stop
    atexit.register(lambda: [_delete_local(root) for root in _roots.pop(app, [])])


def _delete_local(root: str) -> None:
    if root.startswith("file:"):
        shutil.rmtree(root.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def target_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_limit(rows: int | None) -> int:
    """Rows above which a key is hot in a table of so many rows."""
    return max(1000, (rows or 0) // HOT_SHARE)


def join_unique(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot: DataFrame | list | None = None
) -> DataFrame:
    """left joined with right, where right has at most one row for a key.

    Keys that hold more than 1/HOT_SHARE of left's rows would make one task long. There are at most
    HOT_SHARE of them, so their rows of right (no more than HOT_SHARE) are broadcast and left's rows
    stay where they are; all other keys go through a shuffle join. hot: those keys if already known, an
    empty list if there are none.
    how: inner, left, left_semi or left_anti. Null keys match nothing, as in SQL."""
    on = list(on)
    spark = left.sparkSession
    if hot is None:
        # counting, sorting out and joining would each run left's plan, so it is run once and written
        left = left if hasattr(left, "_scratch_path") else Scratch(spark, "keyed").write(left)
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        limit = hot_limit(left.count())
        hot = counts.filter(F.col("_n") > limit).select(*on)
    keys = [] if isinstance(hot, list) else hot.dropna().collect()  # at most HOT_SHARE rows
    if not keys:
        return left.join(right, on, how)
    few = F.broadcast(spark.createDataFrame(keys, hot.schema))
    hot_right = F.broadcast(right.join(few, on, "left_semi"))
    hot_left = left.join(few, on, "left_semi")
    cold_left = left.join(few, on, "left_anti")
    return cold_left.join(right, on, how).unionByName(hot_left.join(hot_right, on, how))


def lag_over_ranges(
    df: DataFrame, part: Sequence[str], order: Sequence[str], carry: Sequence[str], scratch: Scratch
) -> DataFrame:
    """Adds prev_<c> for each c of carry: its value in the row before, by order, within part.

    A plain window would put a whole part into one task. Here the rows are cut into sorted ranges;
    lag runs within a range, and the first row of a range gets its values from the last row of the
    range before, a table of one row per range. has_prev tells whether there is a row before."""
    n = target_partitions(df.sparkSession)
    ranges = scratch.write(
        df.repartitionByRange(n, *part, *order).withColumn("_range", F.spark_partition_id())
    )
    within = W.partitionBy("_range", *part).orderBy(*order)
    row = F.struct(*[F.col(c) for c in carry])
    lagged = ranges.withColumn("_prev", F.lag(row).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    last = ranges.groupBy("_range").agg(
        F.max_by(F.struct(F.struct(*part).alias("part"), row.alias("row")), F.struct(*part, *order)).alias("_last")
    )
    before = last.select(
        F.col("_range"), F.lag("_last").over(W.orderBy("_range")).alias("_before")
    )  # one row per range
    out = lagged.join(F.broadcast(before), "_range", "left")
    same = F.col("_first") & F.struct(*part).eqNullSafe(F.col("_before.part")) & F.col("_before").isNotNull()
    prev = F.when(~F.col("_first"), F.col("_prev")).when(same, F.col("_before.row"))
    out = out.withColumn("_p", prev).withColumn("has_prev", ~F.col("_first") | F.coalesce(same, F.lit(False)))
    for c in carry:
        out = out.withColumn(f"prev_{c}", F.col("_p")[c])
    return out.drop("_range", "_prev", "_first", "_before", "_p")
