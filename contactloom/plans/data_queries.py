"""Queries of the general data-processing operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.bad_rows import LineCheck
from contactloom.operators.frequency import ValueFrequencies, unordered
from contactloom.operators.hierarchy import descendants, hierarchy
from contactloom.operators.schema_drift import schema_changes, unify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_changes(table(spark, sf_dir, "pairs_headers"), table(spark, sf_dir, "field_names"))
    return changes.select("file_id", "field_name", "change_kind").distinct()


def p2_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes as they look without the dictionary of names: what was renamed to what is decided by
    the least-cost edit script alone."""
    return schema_changes(table(spark, sf_dir, "pairs_headers"), None)


def _check(spark: SparkSession, sf_dir: str) -> LineCheck:
    return LineCheck(*(table(spark, sf_dir, n) for n in ("raw_lines", "pairs_headers", "field_names", "chromsizes")))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = _check(spark, sf_dir)
    return unify(check.clean(), check.files)


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of p2_unified that no fixed column holds, one row each with the value it is typed to."""
    return _cells(p2_unified(spark, sf_dir))


def _cells(df: DataFrame) -> DataFrame:
    cells = df.select("file_id", "line_no", "ints", "floats", "texts", F.explode("extras").alias("field_name", "written"))
    at = lambda m: F.try_element_at(m, F.col("field_name"))
    return cells.select(
        "file_id", "line_no", "field_name", "written", at(F.col("ints")).alias("whole"), at(F.col("floats")).alias("number"), at(F.col("texts")).alias("words")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir).errors()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir).clean().select("file_id", "line_no", F.size("cells").alias("n_cells"))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines, which p3_clean counts the cells of, as typed rows."""
    return _check(spark, sf_dir).rows()


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of p3_rows that no fixed column holds, one row each, typed as their own file says."""
    return _cells(p3_rows(spark, sf_dir))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "programs"), ["file_id"], "id", "pp")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programs(spark, sf_dir).select(
        "file_id",
        F.col("node").alias("id"),
        F.coalesce("root", F.lit("")).alias("root_id"),
        F.col("depth").cast("int").alias("node_depth"),
        F.array_join("path", ">").alias("id_path"),
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_programs(spark, sf_dir), ["file_id"])


def _by_chroms(spark: SparkSession, sf_dir: str, value) -> ValueFrequencies:
    a, b = unordered("chrom1", "chrom2")
    pairs = table(spark, sf_dir, "pairs").withColumns({"chrom_a": a, "chrom_b": b})
    return ValueFrequencies(pairs, ["chrom_a", "chrom_b"], value)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_chroms(spark, sf_dir, F.col("pair_type")).shares_above(0.04).select("chrom_a", "chrom_b")


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the distance between the two sides: rows, distinct values, mode and exact quartiles."""
    freq = _by_chroms(spark, sf_dir, F.abs(F.col("pos1") - F.col("pos2")))
    keys = ["chrom_a", "chrom_b"]
    at = freq.percentiles([0.25, 0.5, 0.75]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("share") == s, F.col("percentile"))).alias(n) for s, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    return freq.summary().drop("n_values").join(at, keys)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_guessed, p2_unified, p2_cells, p3_found, p3_clean, p3_rows, p3_cells, p4_found, p4_descendants, p5_found, p5_profile)
}

FILES = r"""
h AS (SELECT DISTINCT file_id, series, created_at, quoting, columns_line, type_casts FROM pairs_headers),
c AS (SELECT file_id, unnest(CASE WHEN coalesce(columns_line, '') = ''
        THEN ['readID', 'chrom1', 'pos1', 'chrom2', 'pos2', 'strand1', 'strand2', 'pair_type']
        ELSE regexp_extract_all(regexp_replace(columns_line, '^\s*#columns:', ''), '[^\s]+') END) AS written,
      generate_subscripts(CASE WHEN coalesce(columns_line, '') = ''
        THEN ['readID', 'chrom1', 'pos1', 'chrom2', 'pos2', 'strand1', 'strand2', 'pair_type']
        ELSE regexp_extract_all(regexp_replace(columns_line, '^\s*#columns:', ''), '[^\s]+') END, 1) AS idx FROM h),
cf AS (SELECT file_id, idx, written, coalesce(field_name, written) AS field FROM c LEFT JOIN field_names ON written = written_as),
t AS (SELECT file_id, unnest(regexp_extract_all(type_casts, '[^ ,;]+')) AS x FROM h),
tf AS (SELECT DISTINCT file_id, coalesce(field_name, split_part(x, ':', 1)) AS field, split_part(x, ':', 2) AS type
       FROM t LEFT JOIN field_names ON split_part(x, ':', 1) = written_as),
f AS (SELECT cf.file_id, idx, written, cf.field,
        coalesce(type, CASE WHEN cf.field IN ('pos1', 'pos2', 'mapq1', 'mapq2') THEN 'int' ELSE 'str' END) AS type
      FROM cf LEFT JOIN tf ON cf.file_id = tf.file_id AND cf.field = tf.field)
"""

P2 = f"""
WITH {FILES},
o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series ORDER BY created_at) AS prev FROM h),
j AS (SELECT n.file_id, n.field, n.written AS w2, n.type AS t2, p.written AS w1, p.type AS t1
      FROM o JOIN f n ON n.file_id = o.file_id LEFT JOIN f p ON p.file_id = o.prev AND p.field = n.field WHERE o.prev IS NOT NULL)
SELECT file_id, field AS field_name, 'added' AS change_kind FROM j WHERE w1 IS NULL
UNION SELECT file_id, field, 'renamed' FROM j WHERE w1 <> w2
UNION SELECT file_id, field, 'retyped' FROM j WHERE t1 <> t2
UNION SELECT o.file_id, p.field, 'removed' FROM o JOIN f p ON p.file_id = o.prev
  WHERE NOT EXISTS (SELECT 1 FROM f n WHERE n.file_id = o.file_id AND n.field = p.field)
"""

LINES = FILES + r"""
, g AS (SELECT file_id, list(field ORDER BY idx) AS fields, list(type ORDER BY idx) AS types,
     max(idx) FILTER (field IN ('readID', 'chrom1', 'pos1', 'chrom2', 'pos2', 'strand1', 'strand2', 'pair_type')) AS least FROM f GROUP BY 1),
l AS (SELECT DISTINCT r.file_id, line_no, line_text, quoting = 'double' AS q, fields, types, least
      FROM raw_lines r JOIN h ON r.file_id = h.file_id JOIN g ON g.file_id = r.file_id),
b AS (SELECT *, q AND NOT regexp_full_match(line_text,
     '(?:"(?:[^"]|"")*"|[^\t"][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^\t"][^\t]*|))*') AS broken FROM l),
s AS (SELECT *, CASE WHEN q THEN list_transform(regexp_extract_all(chr(9) || line_text, '\t("(?:[^"]|"")*"|[^\t"][^\t]*|)', 1),
     lambda x : CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) ELSE string_split(line_text, chr(9)) END AS cells FROM b),
k AS (SELECT *, CASE WHEN broken THEN 'broken_quoting' WHEN len(cells) > len(fields) OR len(cells) < least THEN 'field_count' END AS structure FROM s)
"""

P3 = f"""
WITH {LINES},
e AS (SELECT file_id, line_no, unnest(cells) AS v, unnest(fields[1 : len(cells)]) AS field, unnest(types[1 : len(cells)]) AS type,
     cells[list_position(fields, 'chrom1')] AS c1, cells[list_position(fields, 'chrom2')] AS c2 FROM k WHERE structure IS NULL),
x AS (SELECT e.*, CASE WHEN field IN ('chrom1', 'pos1') THEN c1 WHEN field IN ('chrom2', 'pos2') THEN c2 END AS ctx FROM e),
y AS (SELECT x.*, chrom_len FROM x LEFT JOIN chromsizes ON ctx = chrom)
SELECT file_id, line_no, structure AS reason FROM k WHERE structure IS NOT NULL
UNION SELECT file_id, line_no, 'bad_value' FROM y WHERE NOT CASE
  WHEN field = 'readID' THEN v <> ''
  WHEN field IN ('chrom1', 'chrom2') THEN v = '!' OR chrom_len IS NOT NULL
  WHEN field IN ('pos1', 'pos2') THEN regexp_full_match(v, '[0-9]{{1,18}}') AND
     CASE WHEN ctx = '!' THEN try_cast(v AS BIGINT) = 0 WHEN chrom_len IS NULL THEN true ELSE try_cast(v AS BIGINT) BETWEEN 1 AND chrom_len END
  WHEN field IN ('strand1', 'strand2') THEN v IN ('+', '-')
  WHEN field = 'pair_type' THEN regexp_full_match(v, 'DD|[NMURXW]{{2}}')
  WHEN type = 'int' THEN regexp_full_match(v, '-?[0-9]{{1,18}}')
  WHEN type = 'float' THEN regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?')
  ELSE true END
"""

P3_CLEAN = f"""
WITH {LINES}, bad AS ({P3})
SELECT DISTINCT file_id, line_no, len(cells)::INT AS n_cells FROM k
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.file_id = k.file_id AND bad.line_no = k.line_no)
"""

P2_CELLS = f"""
WITH {LINES}, bad AS ({P3}),
u AS (SELECT field, CASE max(CASE type WHEN 'int' THEN 0 WHEN 'float' THEN 1 ELSE 2 END) WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'str' END AS type FROM f GROUP BY 1),
c1 AS (SELECT DISTINCT file_id, line_no, cells, fields FROM k
  WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.file_id = k.file_id AND bad.line_no = k.line_no)),
v AS (SELECT file_id, line_no, unnest(fields[1 : len(cells)]) AS field_name, unnest(cells) AS written FROM c1)
SELECT file_id, line_no, field_name, written,
  CASE WHEN type = 'int' THEN try_cast(written AS BIGINT) END AS whole, CASE WHEN type = 'float' THEN try_cast(written AS DOUBLE) END AS number,
  CASE WHEN type = 'str' THEN written END AS words
FROM v JOIN u ON field = field_name
WHERE field_name NOT IN ('readID', 'chrom1', 'pos1', 'chrom2', 'pos2', 'strand1', 'strand2', 'pair_type')
"""

P3_CELLS = P2_CELLS.replace("unnest(fields[1 : len(cells)]) AS field_name", "unnest(types[1 : len(cells)]) AS type, unnest(fields[1 : len(cells)]) AS field_name").replace(
    "cells, fields FROM k", "cells, fields, types FROM k"
).replace("FROM v JOIN u ON field = field_name", "FROM v").replace("type = 'str'", "type NOT IN ('int', 'float')")

TREE = """
WITH RECURSIVE n AS (SELECT file_id, id, min(nullif(pp, '')) AS pp FROM programs WHERE id <> '' GROUP BY 1, 2),
up AS (SELECT n.file_id, n.id, p.id AS parent FROM n LEFT JOIN n p ON p.file_id = n.file_id AND p.id = n.pp),
tree AS (
  SELECT file_id, id, id AS root_id, 0 AS node_depth, id AS id_path FROM up WHERE parent IS NULL
  UNION ALL SELECT u.file_id, u.id, t.root_id, t.node_depth + 1, t.id_path || '>' || u.id
  FROM tree t JOIN up u ON u.file_id = t.file_id AND u.parent = t.id)
"""

P4 = f"""{TREE}
SELECT n.file_id, n.id, coalesce(root_id, '') AS root_id, coalesce(node_depth, -1)::INT AS node_depth, coalesce(id_path, '') AS id_path
FROM n LEFT JOIN tree t ON t.file_id = n.file_id AND t.id = n.id
"""

P4_DESCENDANTS = f"""{TREE},
under AS (SELECT t.file_id, u.parent AS ancestor, t.id AS descendant, 1 AS distance
  FROM tree t JOIN up u ON u.file_id = t.file_id AND u.id = t.id WHERE u.parent IS NOT NULL
  UNION ALL SELECT x.file_id, u.parent, x.descendant, x.distance + 1
  FROM under x JOIN up u ON u.file_id = x.file_id AND u.id = x.ancestor WHERE u.parent IS NOT NULL)
SELECT file_id, ancestor, descendant, distance::INT AS distance FROM under
"""

P5 = """
SELECT least(chrom1, chrom2) AS chrom_a, greatest(chrom1, chrom2) AS chrom_b FROM pairs
WHERE chrom1 IS NOT NULL AND chrom2 IS NOT NULL
GROUP BY 1, 2 HAVING count(*) > 0.04 * (SELECT count(*) FROM pairs)
"""

P5_PROFILE = """
WITH d AS (SELECT least(chrom1, chrom2) AS chrom_a, greatest(chrom1, chrom2) AS chrom_b, abs(pos1 - pos2) AS v FROM pairs),
m AS (SELECT chrom_a, chrom_b, v, row_number() OVER (PARTITION BY chrom_a, chrom_b ORDER BY count(*) DESC, v) AS r FROM d GROUP BY 1, 2, 3)
SELECT chrom_a, chrom_b, count(*)::BIGINT AS n, count(DISTINCT d.v)::BIGINT AS n_distinct,
  max(CASE WHEN r = 1 THEN m.v END)::BIGINT AS mode,
  quantile_disc(d.v, 0.25)::BIGINT AS q1, quantile_disc(d.v, 0.5)::BIGINT AS median, quantile_disc(d.v, 0.75)::BIGINT AS q3
FROM d JOIN m USING (chrom_a, chrom_b) WHERE r = 1 GROUP BY 1, 2
"""

ORACLE = {
    "p2_found": P2, "p2_cells": P2_CELLS, "p3_found": P3, "p3_clean": P3_CLEAN, "p3_cells": P3_CELLS, "p4_found": P4, "p4_descendants": P4_DESCENDANTS,
    "p5_found": P5, "p5_profile": P5_PROFILE,
}
