"""Statistics as text: lines of key and value, YAML, and tables by filter."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources.streams import write_bytes, write_table

LONG = "filter string, key string, value double"


def read_stats(spark: SparkSession, path: str, name: str = "no_filter") -> DataFrame:
    """(filter, key, value) of a text file with a key and a value on each line."""
    df = spark.read.csv(path, sep="\t", schema="key string, value string")
    return df.select(F.lit(name).alias("filter"), "key", F.col("value").try_cast("double").alias("value")).dropna(subset=["value"])


def to_dict(long: DataFrame) -> dict[str, dict]:
    """{filter: {key: value}} of a long table; statistics are a few thousand numbers, held by the driver."""
    out: dict[str, dict] = {}
    for r in long.orderBy("filter", "key").toLocalIterator():
        value = r["value"]
        out.setdefault(r["filter"], {})[r["key"]] = int(value) if value is not None and float(value).is_integer() else value
    return out


def nested(flat: Mapping[str, object]) -> dict:
    """Keys with '/' as dictionaries within dictionaries."""
    out: dict = {}
    for key, value in flat.items():
        at = out
        *above, last = key.split("/")
        for part in above:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def flattened(tree: Mapping, above: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        name = f"{above}/{k}" if above else str(k)
        out |= flattened(v, name) if isinstance(v, Mapping) else {name: v}
    return out


def write_stats(long: DataFrame, path: str, yaml: bool = False, more: Mapping[str, Mapping[str, object]] | None = None) -> None:
    """One small file, or standard output if path is '-', more being further keys of each filter. Without
    YAML only one filter can be written."""
    data = to_dict(long)
    for name, values in (more or {}).items():
        whole = {k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in values.items()}
        data.setdefault(name, {}).update(whole)
    if yaml:
        import yaml as y

        text = y.safe_dump({f: nested(v) for f, v in data.items()}, sort_keys=False)
    else:
        if len(data) > 1:
            raise ValueError("several filters need YAML")
        text = "".join(f"{k}\t{v}\n" for v in data.values() for k, v in v.items())
    write_bytes(long.sparkSession, path, text.encode())


def read_stats_yaml(spark: SparkSession, path: str) -> DataFrame:
    import yaml as y

    lines = spark.read.text(path, wholetext=True).first()
    data = (y.safe_load(lines.value) if lines else None) or {}
    rows = [(name, k, float(v)) for name, tree in data.items() for k, v in flattened(tree).items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, LONG)


def by_filter(long: DataFrame) -> DataFrame:
    """One row for each filter, one column for each key."""
    keys = sorted(r.key for r in long.select("key").distinct().toLocalIterator())
    return long.groupBy("filter").pivot("key", keys).agg(F.first("value"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    write_table(tiles, path)
