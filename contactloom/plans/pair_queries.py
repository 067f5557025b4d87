"""Queries of the pair operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.bins import geometric_edges, stats_edges
from contactloom.operators import coverage, intervals, order, rowwise, scaling, stats
from contactloom.operators.dedup import Dedup, neighbour_offsets
from contactloom.operators.parse import all_alignments, parse_sam
from contactloom.operators.walks import POLICIES, WalkOptions
from contactloom.plans import derive, walk_sql
from contactloom.schema import PAIRS_COLUMNS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ALL = ", ".join(f'"{c}"' for c in PAIRS_COLUMNS)
P = f"p AS ({derive.PAIRS_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _selection(name: str, text: str, where: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derive.pairs(spark, sf_dir, "mapq1", "mapq2")
        return rowwise.select(df, text, **options).select(*PAIRS_COLUMNS)

    run.__name__ = name
    query(f'SELECT readid AS "readID", {ALL.split(", ", 1)[1]} FROM pairs WHERE {where}')(run)


_selection("select_equal", 'pair_type == "UU" and chrom1 == chrom2', "pair_type = 'UU' AND chrom1 = chrom2")
_selection("select_csv", 'csv_match(chrom1, "chr1,chr3,chrX") or not csv_match(pair_type, "UU,UR,RU")', "chrom1 IN ('chr1', 'chr3', 'chrX') OR pair_type NOT IN ('UU', 'UR', 'RU')")
_selection("select_wildcard", 'wildcard_match(chrom1, "scf_?[0-4]*") or wildcard_match(chrom2, "chr[!1-9]")', r"regexp_full_match(chrom1, 'scf_.[0-4].*') OR regexp_full_match(chrom2, 'chr[^1-9]')")
_selection("select_regex", r'regex_match(chrom2, r"chr\d+") and regex_match(pair_type, "[UR]{2}")', r"regexp_full_match(chrom2, 'chr\d+') AND regexp_full_match(pair_type, '[UR]{2}')")
_selection("select_region", 'region_match(chrom1, pos1, "chr2", 1000000, 90000000) and region_match(chrom2, pos2, "chr2", 5)', "chrom1 = 'chr2' AND pos1 BETWEEN 1000000 AND 90000000 AND chrom2 = 'chr2' AND pos2 >= 5")
_selection("select_mapq", "mapq1 >= 30 and mapq2 >= 30 and 0 < abs(pos2 - pos1) // 1000 < 500", "mapq1 >= 30 AND mapq2 >= 30 AND abs(pos2 - pos1) // 1000 > 0 AND abs(pos2 - pos1) // 1000 < 500")
_selection("select_strings", 'readID.startswith("KX7") and COLS[1][:3] == "chr" and len(chrom2) in (4, 5) and (strand1 + strand2) in ["+-", "-+"]', "readid LIKE 'KX7%' AND chrom1[1:3] = 'chr' AND length(chrom2) IN (4, 5) AND strand1 || strand2 IN ('+-', '-+')")
_selection("chrom_subset", "True", "chrom1 IN ('chr1', 'chr2', 'chr5') AND chrom2 IN ('chr1', 'chr2', 'chr5')", chrom_subset=["chr1", "chr2", "chr5"])


@query('SELECT readid AS "readID", chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type FROM pairs WHERE NOT coalesce(pos1 > pos2 AND mapq1 > 10, false)')
def select_rest(spark, d):
    df = derive.pairs(spark, d, "mapq1", "mapq2")
    return rowwise.select_rest(df, "pos1 > pos2 and mapq1 > 10").select(*PAIRS_COLUMNS)


@query("SELECT readid AS \"readID\", chrom1, pos1, chrom2, pos2 FROM pairs WHERE pair_type = 'UU'")
def select_remove_columns(spark, d):
    return rowwise.select(derive.pairs(spark, d), 'pair_type == "UU"', ["strand1", "strand2", "pair_type"]).drop("_ord")


@query("SELECT split_part(readid, ':', 1) || '/' || length(readid) AS \"readID\" FROM pairs".replace("split_part(readid, ':', 1) || '/' || length(readid)", "upper(readid)[1:12] || '_' || length(readid)"))
def readid_transform(spark, d):
    return rowwise.transform_read_ids(derive.pairs(spark, d), 'readID.upper()[:12] + "_" + str(len(readID))').select("readID")


@query("SELECT readid AS \"readID\", mapq1::VARCHAR AS mapq1, mapq2::DOUBLE AS mapq2, try_cast(pair_type AS BIGINT) AS pair_type FROM pairs WHERE mapq2::DOUBLE >= 30.5")
def type_cast(spark, d):
    casts = {"mapq1": "str", "mapq2": "float", "pair_type": "int"}
    df = rowwise.cast_columns(derive.pairs(spark, d, "mapq1", "mapq2"), casts)
    return rowwise.select(df, "mapq2 >= 30.5").select("readID", *casts)


@query("SELECT readid AS read_name, chrom1 AS c1, pos1 AS p1, chrom2 AS c2, pos2 AS p2, strand1 AS s1, strand2 AS s2, pair_type AS pt FROM pairs")
def set_columns(spark, d):
    return rowwise.rename_columns(derive.pairs(spark, d), ["read_name", "c1", "p1", "c2", "p2", "s1", "s2", "pt"]).drop("_ord")


FLIP = """
WITH r AS (SELECT chrom, chrom_rank FROM chromsizes WHERE chrom_rank <= 20 UNION ALL SELECT '!', 0),
x AS (SELECT p.*, a.chrom_rank AS r1, b.chrom_rank AS r2 FROM pairs p LEFT JOIN r a ON chrom1 = a.chrom LEFT JOIN r b ON chrom2 = b.chrom),
w AS (SELECT *, CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN r1 > r2 OR (r1 = r2 AND pos1 > pos2)
  WHEN r1 IS NOT NULL THEN false WHEN r2 IS NOT NULL THEN true ELSE chrom1 >= chrom2 END AS t FROM x)
SELECT readid AS "readID", CASE WHEN t THEN chrom2 ELSE chrom1 END AS chrom1, CASE WHEN t THEN pos2 ELSE pos1 END AS pos1,
 CASE WHEN t THEN chrom1 ELSE chrom2 END AS chrom2, CASE WHEN t THEN pos1 ELSE pos2 END AS pos2,
 CASE WHEN t THEN strand2 ELSE strand1 END AS strand1, CASE WHEN t THEN strand1 ELSE strand2 END AS strand2,
 CASE WHEN t THEN pair_type[2] || pair_type[1] ELSE pair_type END AS pair_type,
 CASE WHEN t THEN mapq2 ELSE mapq1 END AS mapq1, CASE WHEN t THEN mapq1 ELSE mapq2 END AS mapq2 FROM w
"""


@query(FLIP)
def flip(spark, d):
    return rowwise.flip(derive.pairs(spark, d, "mapq1", "mapq2"), derive.chrom_order(spark, d)).drop("_ord")


@query(f"WITH {P} SELECT {ALL}, row_number() OVER (ORDER BY chrom1, chrom2, pos1, pos2, pair_type, pair_no)::BIGINT AS place FROM p")
def sort(spark, d):
    ordered = order.sort_pairs(derive.pairs(spark, d))
    # the place in the order from the sizes of the sorted ranges, so that no single task numbers all rows
    ranged = ordered.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()})
    from contactloom.runtime import Scratch

    kept = Scratch(spark, "sort").write(ranged)
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_in").alias("first"))
    from pyspark.sql import Window as W

    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = kept.join(F.broadcast(before), "_part")  # one row for each range
    return numbered.select(*PAIRS_COLUMNS, (F.col("before") + F.col("_in") - F.col("first") + 1).alias("place"))


@query('SELECT readid AS "readID", chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type FROM pairs')
def merge(spark, d):
    df = derive.pairs(spark, d)
    parts = [df.filter(F.col("_ord") % 3 == k) for k in range(3)]
    return order.sort_pairs(order.union_pairs(parts)).select(*PAIRS_COLUMNS)


@query("SELECT readid AS \"readID\", chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type FROM pairs WHERE ('0x' || md5('7:' || readid)[1:8])::BIGINT < 1073741824")
def sample_hash(spark, d):
    return rowwise.sample_by_hash(derive.pairs(spark, d), 0.25, seed=7).drop("_ord")


@query()
def sample(spark, d):
    return rowwise.sample(derive.pairs(spark, d), 0.1, 42).drop("_ord")


ENTRY = "readid || chr(25) || {flag} || chr(25) || chrom{i} || chr(25) || pos{i} || chr(25) || '60' || chr(25) || '50M' || chr(25) || 'Yt:Z:' || {pt}"


def _entries(flags: tuple[str, str], pt: str) -> list[str]:
    return [ENTRY.format(i=i, pt=pt, flag=f"CASE WHEN strand{i} = '+' THEN '{flags[0]}' ELSE '{flags[1]}' END") for i in (1, 2)]


@query("SELECT readid AS \"readID\", 'DD' AS pair_type, {} AS sam1, {} AS sam2 FROM pairs".format(*_entries(("1089", "1105"), "'DD'")))
def markasdup(spark, d):
    return rowwise.mark_as_dup(derive.pairsam(spark, d)).select("readID", "pair_type", "sam1", "sam2")


@query("SELECT replace({}, chr(25), chr(9)) AS value FROM pairs UNION ALL SELECT replace({}, chr(25), chr(9)) FROM pairs".format(*_entries(("65", "81"), "pair_type")))
def split_sam(spark, d):
    return rowwise.split_sam(derive.pairsam(spark, d))


@query(f"WITH {P} SELECT {ALL} FROM p")
def split_pairs(spark, d):
    return rowwise.split_pairs(derive.pairsam(spark, d)).drop("_ord")


# --- phase ---------------------------------------------------------------------------------------


def _phase_sql(mode: str) -> str:
    sides = []
    for i in (1, 2):
        tie = f"(hits{i} >= 2 AND s3{i} = xs{i} AND xs{i} = as{i})" if mode == "XB" else f"(hits{i} >= 2 AND alt{i} = nm{i})"
        homologue = f"(hits{i} >= 1 AND own{i} <> other{i})"
        state = f"CASE WHEN raw{i} = '!' THEN 'unmapped' WHEN as{i} > xs{i} THEN 'phased' WHEN {tie} THEN 'lost' WHEN {homologue} THEN 'open' ELSE 'lost' END"
        sides.append(f"{state} AS state{i}")
    out = []
    for i in (1, 2):
        s = f"state{i}"
        scores = (
            (f"as{i}", f"xs{i}", f"CASE WHEN {s} <> 'phased' AND hits{i} >= 2 THEN s3{i} ELSE -1 END")
            if mode == "XB"
            else (f"nm{i}", f"CASE WHEN hits{i} >= 1 THEN alt{i} ELSE -1 END", f"CASE WHEN {s} <> 'phased' AND hits{i} >= 2 THEN alt{i} ELSE -1 END")
        )
        out += [
            f"CASE {s} WHEN 'phased' THEN CASE own{i} WHEN '_hap1' THEN '0' ELSE '1' END WHEN 'open' THEN '.' ELSE '!' END AS phase{i}",
            f"CASE WHEN {s} IN ('phased', 'open') THEN raw{i} ELSE '!' END AS chrom{i}",
            f"CASE WHEN {s} = 'lost' THEN 0 ELSE pos{i} END AS pos{i}",
            f"CASE WHEN {s} = 'lost' THEN '-' ELSE strand{i} END AS strand{i}",
            *[f"(CASE WHEN {s} = 'unmapped' THEN -1 ELSE {v} END)::INT AS \"{'S' if mode == 'XB' else 'M'}{k}_{i}\"" for k, v in enumerate(scores, 1)],
        ]
    letter = " || ".join(f"CASE WHEN state{i} = 'lost' THEN 'M' ELSE pair_type[{i}] END" for i in (1, 2))
    return f'WITH t AS ({derive.tagged_sql()}), s AS (SELECT *, {", ".join(sides)} FROM t) SELECT "readID", {", ".join(out)}, {letter} AS pair_type FROM s'


def _phase(mode: str):
    def run(spark, d):
        extra = [f"{'S' if mode == 'XB' else 'M'}{k}_{i}" for i in (1, 2) for k in (1, 2, 3)]
        out = rowwise.phase(derive.tagged(spark, d), tag_mode=mode, report_scores=True)
        return out.select(*PAIRS_COLUMNS, "phase1", "phase2", *[F.col(c).cast("int").alias(c) for c in extra])

    run.__name__ = f"phase_{mode.lower()}"
    query(_phase_sql(mode))(run)


_phase("XB")
_phase("XA")

# --- statistics ----------------------------------------------------------------------------------

FLAGS = """
f AS (SELECT *, chrom1 <> '!' AS m1, chrom2 <> '!' AS m2, chrom1 <> '!' AND chrom2 <> '!' AND pair_type = 'DD' AS dup,
  chrom1 <> '!' AND chrom2 <> '!' AND pair_type <> 'DD' AS live, abs(pos2 - pos1) AS dist FROM p)
"""
COUNT_TESTS = {
    "total": "true", "total_unmapped": "NOT m1 AND NOT m2", "total_single_sided_mapped": "m1 <> m2", "total_mapped": "m1 AND m2",
    "total_dups": "dup", "total_nodups": "live", "cis": "live AND chrom1 = chrom2", "trans": "live AND chrom1 <> chrom2",
    **{k: f"live AND chrom1 = chrom2 AND dist >= {v}" for k, v in stats.CIS_THRESHOLDS.items()},
}


def _counts_sql(source: str = P, filters: str = "'no_filter' AS filter") -> str:
    each = " UNION ALL ".join(f"SELECT filter, '{k}' AS key, count(*) FILTER ({t})::BIGINT AS value FROM g GROUP BY filter" for k, t in COUNT_TESTS.items())
    return f"WITH {source}, {FLAGS}, g AS (SELECT *, {filters} FROM f) {each}"


@query(_counts_sql())
def stats_counts(spark, d):
    return stats.PairStats(derive.pairs(spark, d)).counts()


FILTERS = {"unique": 'pair_type == "UU"', "far": "chrom1 == chrom2 and abs(pos1 - pos2) > 20000", "all": "True"}


@query(_counts_sql(filters="unnest(list_filter([CASE WHEN pair_type = 'UU' THEN 'unique' END, CASE WHEN chrom1 = chrom2 AND abs(pos1 - pos2) > 20000 THEN 'far' END, 'all'], lambda x : x IS NOT NULL)) AS filter"))
def stats_filters(spark, d):
    return stats.PairStats(derive.pairs(spark, d), FILTERS).counts()


@query("SELECT 'no_filter' AS filter, pair_type, count(*)::BIGINT AS value FROM pairs GROUP BY pair_type")
def stats_pair_types(spark, d):
    return stats.PairStats(derive.pairs(spark, d)).pair_types()


@query(f"WITH {P}, {FLAGS} SELECT 'no_filter' AS filter, chrom1, chrom2, count(*)::BIGINT AS value FROM f WHERE live GROUP BY chrom1, chrom2")
def stats_chrom_freq(spark, d):
    return stats.PairStats(derive.pairs(spark, d)).chrom_freq()


def _values(edges: list[int], last: int = 2**62) -> str:
    return ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in zip(edges, [*edges[1:], last]))


DIST = f"""
WITH {P}, {FLAGS}, b(lo, hi) AS (VALUES {_values(stats_edges())}), s(strands) AS (VALUES ('++'), ('--'), ('-+'), ('+-')),
n AS (SELECT strand1 || strand2 AS strands, lo, count(*) AS n FROM f JOIN b ON dist >= lo AND dist < hi WHERE live AND chrom1 = chrom2 GROUP BY 1, 2),
q AS (SELECT 'no_filter' AS filter, strands, lo AS min_dist, coalesce(n, 0)::BIGINT AS value FROM s CROSS JOIN b LEFT JOIN n USING (strands, lo))
"""


@query(f"{DIST} SELECT * FROM q")
def stats_dist_freq(spark, d):
    return stats.PairStats(derive.pairs(spark, d)).dist_freq()


@query(f"""{DIST}, m AS (SELECT min_dist, avg(value) AS mean FROM q GROUP BY 1),
o AS (SELECT min_dist, strands, CASE strands WHEN '++' THEN 0 WHEN '--' THEN 1 WHEN '-+' THEN 2 ELSE 3 END AS r FROM q JOIN m USING (min_dist)
      WHERE mean > 0 AND min_dist > 0 AND abs(value - mean) / mean > 0.05 ORDER BY min_dist DESC, r LIMIT 1)
SELECT 'no_filter' AS filter, min_dist AS convergence_bin, strands FROM o""")
def stats_convergence(spark, d):
    return stats.convergence_table(stats.PairStats(derive.pairs(spark, d)).dist_freq())


@query(f"WITH c AS ({_counts_sql()}), w AS (SELECT max(value) FILTER (key = 'total_nodups') AS n, max(value) FILTER (key = 'total_mapped') AS m FROM c) SELECT 'no_filter' AS filter, "
       + ", ".join(f"max(value) FILTER (key = '{k}') / any_value(n) AS \"frac_{k}\"" for k in ["cis", *stats.CIS_THRESHOLDS])
       + ", max(value) FILTER (key = 'total_dups') / any_value(m) AS frac_dups FROM c, w")
def stats_summary(spark, d):
    return stats.summary(stats.PairStats(derive.pairs(spark, d)).counts())


COMPLEXITY = f"""WITH RECURSIVE c AS ({_counts_sql()}),
w AS (SELECT max(value) FILTER (key = 'total_mapped')::DOUBLE AS n, (max(value) FILTER (key = 'total_mapped') - max(value) FILTER (key = 'total_dups'))::DOUBLE AS u FROM c),
bisect(step, lo, hi) AS (SELECT 0, u, n * 1e6 FROM w UNION ALL
  SELECT step + 1, CASE WHEN m * (1 - exp(-n / m)) < u THEN m ELSE lo END, CASE WHEN m * (1 - exp(-n / m)) < u THEN hi ELSE m END
  FROM (SELECT *, (lo + hi) / 2 AS m FROM bisect), w WHERE step < 120)
SELECT 'no_filter' AS filter, round(lo)::BIGINT AS complexity_naive FROM bisect WHERE step = 120"""


@query(COMPLEXITY)
def stats_complexity(spark, d):
    """Distinct molecules of the library, to whole ones; the SQL finds them by bisection."""
    out = stats.full_summary(stats.PairStats(derive.pairs(spark, d)))
    return spark.createDataFrame([(k, round(v["summary/complexity_naive"])) for k, v in out.items()], "filter string, complexity_naive long")


def _labels() -> str:
    e = stats_edges()
    return ", ".join(f"({lo}::BIGINT, '{t}')" for lo, t in zip(e, [*(f"{x}-{y}" for x, y in zip(e, e[1:])), f"{e[-1]}+"]))


LONG = f"""{DIST}, lab(lo, label) AS (VALUES {_labels()})
SELECT * FROM ({_counts_sql()})
UNION ALL SELECT 'no_filter', 'pair_types/' || pair_type, count(*)::BIGINT FROM pairs GROUP BY pair_type
UNION ALL SELECT 'no_filter', 'chrom_freq/' || chrom1 || '/' || chrom2, count(*)::BIGINT FROM f WHERE live GROUP BY chrom1, chrom2
UNION ALL SELECT filter, 'dist_freq/' || label || '/' || strands, value FROM q JOIN lab ON lo = min_dist"""


@query(LONG)
def stats_long(spark, d):
    return stats.PairStats(derive.pairs(spark, d)).long()


@query(ORACLE["stats_summary"])
def stats_merge_summary(spark, d):
    """Shares computed from the merged counts of three parts of the pairs."""
    df = derive.pairs(spark, d)
    return stats.summary(stats.merge_stats([stats.PairStats(df.filter(F.col("_ord") % 3 == k)).long() for k in range(3)]))


@query(_counts_sql())
def stats_merge(spark, d):
    df = derive.pairs(spark, d)
    return stats.merge_stats([stats.PairStats(df.filter(F.col("_ord") % 3 == k)).counts() for k in range(3)])


@query("""SELECT least(a, b) AS tile, greatest(a, b) AS parent_tile, count(*)::BIGINT AS dup_count FROM (
  SELECT array_to_string(string_split(readid, ':')[3:5], ':') AS a, array_to_string(string_split(parent_readid, ':')[3:5], ':') AS b FROM pairs
  WHERE parent_readid IS NOT NULL AND parent_readid NOT IN ('', '.') AND readid <> '.') GROUP BY 1, 2""")
def stats_tiles(spark, d):
    df = derive.pairs(spark, d, "parent_readid").filter(~F.col("parent_readid").isin("", ".") & (F.col("readID") != "."))
    return stats.tile_duplicates(df, parent="parent_readid")


@query()
def stats_full_summary(spark, d):
    """Every key computed from counts; values as text, since one of them names strands. Tiles are those
    of duplicates with a parent."""
    dups = derive.pairs(spark, d, "parent_readid").filter((F.col("pair_type") == "DD") & ~F.col("parent_readid").isin("", ".") & (F.col("readID") != "."))
    out = stats.full_summary(stats.PairStats(derive.pairs(spark, d)), stats.tile_duplicates(dups, parent="parent_readid"))
    rows = [(name, k, str(v)) for name, values in out.items() for k, v in values.items()]
    return spark.createDataFrame(rows, "filter string, key string, value string")


# --- dedup ---------------------------------------------------------------------------------------

NEAR = {"max": "abs(a.pos2 - b.pos2) <= {r}", "sum": "abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) <= {r}"}


def _dedup_sql(r: int, method: str, more: str = "", columns: str = "file_id") -> str:
    return f"""
WITH RECURSIVE {P}, m AS (SELECT p.*, {columns} FROM p JOIN pairs USING (pair_no) WHERE p.chrom1 <> '!' AND p.chrom2 <> '!'),
e AS (SELECT a.pair_no AS x, b.pair_no AS y FROM m a JOIN m b ON a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.strand1 = b.strand1
  AND a.strand2 = b.strand2 {more} AND b.pos1 BETWEEN a.pos1 - {r} AND a.pos1 + {r} AND {NEAR[method].format(r=r)}),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT q.x, e.y FROM reach q JOIN e ON q.y = e.x),
c AS (SELECT x AS pair_no, min(y) AS kept FROM reach GROUP BY x)
SELECT m."readID", m.pair_no, c.pair_no <> c.kept AS duplicate, k."readID" AS "parent_readID" FROM m JOIN c USING (pair_no) JOIN p k ON k.pair_no = c.kept
"""


def _dedup(name: str, sql: str | None, more: tuple[str, ...] = (), **options) -> None:
    def run(spark, d):
        marked = Dedup(derive.pairs(spark, d, *more), **options).marked()
        return marked.select("readID", F.col("_ord").alias("pair_no"), "duplicate", "parent_readID")

    run.__name__ = name
    query(sql)(run)


_dedup("dedup_fuzzy_max", _dedup_sql(3, "max"))
_dedup("dedup_fuzzy_sum", _dedup_sql(3, "sum"), method="sum")
_dedup("dedup_exact", _dedup_sql(0, "max"), max_mismatch=0)
_dedup("dedup_extra_cols", _dedup_sql(3, "max", "AND a.file_id = b.file_id"), ("file_id",), extra_pairs=[("file_id", "file_id")])
_dedup("dedup_column_pairs", _dedup_sql(3, "max", "AND a.pair_type = b.pair_type AND a.mapq1 IS NOT DISTINCT FROM b.mapq1", "file_id, mapq1"), ("mapq1",), extra_pairs=[("pair_type", "mapq1")])
GREEDY = f"""
WITH {P}, m AS (SELECT * FROM p WHERE chrom1 <> '!' AND chrom2 <> '!'),
pt AS (SELECT chrom1, chrom2, strand1, strand2, pos1, pos2, min(pair_no) AS first FROM m GROUP BY ALL),
g AS (SELECT chrom1, chrom2, strand1, strand2, list({{'p': pos1, 'q': pos2, 'f': first}} ORDER BY pos1, pos2) AS l FROM pt GROUP BY ALL),
d AS (SELECT * EXCLUDE (l), unnest(l) AS x, list_reduce(list_transform(l, lambda x : [x]), lambda a, x : CASE WHEN
  len(list_filter(a, lambda y : abs(y.p - x[1].p) <= 3 AND abs(y.q - x[1].q) <= 3)) > 0 THEN a ELSE a || x END) AS leaders FROM g),
k AS (SELECT chrom1, chrom2, strand1, strand2, x.p AS pos1, x.q AS pos2,
  list_filter(leaders, lambda y : abs(y.p - x.p) <= 3 AND abs(y.q - x.q) <= 3)[1].f AS kept FROM d)
SELECT m."readID", m.pair_no, m.pair_no <> kept AS duplicate, o."readID" AS "parent_readID"
FROM m JOIN k USING (chrom1, chrom2, strand1, strand2, pos1, pos2) JOIN p o ON o.pair_no = kept
"""
_dedup("dedup_greedy", GREEDY, backend="greedy")


@query(f"WITH t AS ({_dedup_sql(3, 'max')}) SELECT sink, count(*)::BIGINT AS n FROM (SELECT CASE WHEN duplicate THEN 'dups' ELSE 'dedup' END AS sink FROM t UNION ALL SELECT 'unmapped' FROM pairs WHERE chrom1 = '!' OR chrom2 = '!') GROUP BY 1")
def dedup_sinks(spark, d):
    parts = Dedup(derive.pairs(spark, d)).split(keep_parent_id=True)
    out = [df.groupBy(F.lit(name).alias("sink")).agg(F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH t AS ({_dedup_sql(3, 'max')}), x AS (SELECT t.pair_no, abs(a.pos1 - b.pos1) AS d1, abs(a.pos2 - b.pos2) AS d2
  FROM t JOIN pairs a USING (pair_no) JOIN (SELECT "readID", min(pair_no) AS first FROM (SELECT readid AS "readID", pair_no FROM pairs) GROUP BY 1) f ON f."readID" = t."parent_readID"
  JOIN pairs b ON b.pair_no = f.first WHERE duplicate AND t."readID" <> '.' AND t."parent_readID" <> '.') SELECT d1, d2, count(*)::BIGINT AS n FROM x GROUP BY 1, 2""")
def duplicate_offsets(spark, d):
    df = derive.pairs(spark, d)
    dups = Dedup(df).marked().filter("duplicate and readID <> '.' and parent_readID <> '.'")
    firsts = df.groupBy(F.col("readID").alias("parent_readID")).agg(F.min_by(F.struct("pos1", "pos2"), "_ord").alias("kept"))
    off = dups.join(firsts, "parent_readID").select(*[F.abs(F.col(f"pos{i}") - F.col(f"kept.pos{i}")).alias(f"d{i}") for i in (1, 2)])
    return off.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P}, m AS (SELECT * FROM p WHERE chrom1 <> '!' AND chrom2 <> '!') SELECT abs(a.pos1 - b.pos1) AS d1, abs(a.pos2 - b.pos2) AS d2, count(*)::BIGINT AS n
FROM m a JOIN m b ON a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.strand1 = b.strand1 AND a.strand2 = b.strand2 AND a.pair_no < b.pair_no
WHERE abs(a.pos1 - b.pos1) <= 100 AND abs(a.pos2 - b.pos2) <= 100 GROUP BY 1, 2""")
def neighbour_distances(spark, d):
    return neighbour_offsets(derive.pairs(spark, d), 100)


# --- coverage, fragments, regions ----------------------------------------------------------------

def _cov_sql(dist: int, cov: int, method: str) -> str:
    value = "greatest(a.n, b.n)" if method == "max" else "a.n + b.n - 1"
    return f"""
WITH {P}, m AS (SELECT * FROM p WHERE chrom1 <> '!' AND chrom2 <> '!'),
e AS (SELECT chrom1 AS c, pos1 AS x FROM m UNION ALL SELECT chrom2, pos2 FROM m),
w AS (SELECT DISTINCT c, x, count(*) OVER (PARTITION BY c ORDER BY x RANGE BETWEEN {dist} PRECEDING AND {dist} FOLLOWING) AS n FROM e)
SELECT "readID", pair_no, CASE WHEN {value} > {cov} THEN 'highcov' ELSE 'lowcov' END AS sink FROM m
JOIN w a ON chrom1 = a.c AND pos1 = a.x JOIN w b ON chrom2 = b.c AND pos2 = b.x
UNION ALL SELECT "readID", pair_no, 'unmapped' FROM p WHERE chrom1 = '!' OR chrom2 = '!'
"""


def _coverage(method: str, dist: int, cov: int) -> None:
    def run(spark, d):
        parts = coverage.filter_by_coverage(derive.pairs(spark, d), cov, dist, method)
        out = [df.select("readID", F.col("_ord").alias("pair_no"), F.lit(name).alias("sink")) for name, df in parts.items()]
        return out[0].unionByName(out[1]).unionByName(out[2])

    run.__name__ = f"filterbycov_{method}"
    query(_cov_sql(dist, cov, method))(run)


_coverage("max", 500, 2)
_coverage("sum", 2000, 4)

RFRAG = f"""
{P}, bed AS ({derive.FRAGMENTS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY lo0) - 1 AS idx,
  row_number() OVER (PARTITION BY chrom ORDER BY lo0 DESC) AS back FROM bed),
g AS (SELECT chrom, idx, CASE WHEN idx = 0 THEN 0 ELSE lo0 + 1 END AS lo, hi0 + 1 AS hi, CASE WHEN idx = 0 THEN -1 ELSE lo0 + 1 END AS from_, CASE WHEN back = 1 THEN 1000000000000 ELSE hi0 + 1 END AS to_ FROM o),
r AS (SELECT p.*, """ + ", ".join(
    f"coalesce(g{i}.idx, -1)::BIGINT AS rfrag{i}, coalesce(g{i}.lo, 0)::BIGINT AS rfrag_start{i}, coalesce(g{i}.hi, 0)::BIGINT AS rfrag_end{i}" for i in (1, 2)
) + " FROM p " + " ".join(f"LEFT JOIN g g{i} ON chrom{i} = g{i}.chrom AND pos{i} >= g{i}.from_ AND pos{i} < g{i}.to_" for i in (1, 2)) + ")"


@query(f"WITH {RFRAG} SELECT * EXCLUDE (pair_no) FROM r")
def restrict(spark, d):
    return intervals.restrict(derive.pairs(spark, d), derive.fragments(spark, d)).drop("_ord")


@query(f"""WITH {RFRAG} SELECT CASE WHEN chrom1 = chrom2 AND rfrag1 >= 0 AND abs(rfrag1 - rfrag2) <= 1 THEN
  CASE strand1 || strand2 WHEN '+-' THEN 'dangling_end' WHEN '-+' THEN 'self_circle' ELSE 'mirror' END ELSE 'regular' END AS class,
  count(*) FILTER (pair_type = 'UU')::BIGINT AS uu, count(*) FILTER (pair_type <> 'UU')::BIGINT AS other FROM r GROUP BY 1""")
def fragment_classes(spark, d):
    df = intervals.fragment_classes(intervals.restrict(derive.pairs(spark, d), derive.fragments(spark, d)))
    uu = F.col("pair_type") == "UU"
    return df.groupBy("class").agg(F.count_if(uu).alias("uu"), F.count_if(~uu).alias("other"))


@query(f"WITH {RFRAG} SELECT \"readID\", pos1 - rfrag_start1 AS dist_start1, rfrag_end1 - pos1 AS dist_end1, pos2 - rfrag_start2 AS dist_start2, rfrag_end2 - pos2 AS dist_end2 FROM r WHERE rfrag1 >= 0 AND rfrag2 >= 0")
def fragment_end_distances(spark, d):
    df = intervals.fragment_end_distances(intervals.restrict(derive.pairs(spark, d), derive.fragments(spark, d)))
    return df.filter("rfrag1 >= 0 and rfrag2 >= 0").select("readID", "dist_start1", "dist_end1", "dist_start2", "dist_end2")


REGS = f"""
{P}, arms AS ({derive.ARMS_SQL}), r AS (SELECT p.*, """ + ", ".join(f"coalesce(a{i}.s, -1) AS start{i}, coalesce(a{i}.e, -1) AS end{i}" for i in (1, 2)) + (
    " FROM p " + " ".join(f"LEFT JOIN arms a{i} ON chrom{i} = a{i}.chrom AND pos{i} >= a{i}.s AND pos{i} < a{i}.e" for i in (1, 2)) + ")"
)


@query(f"WITH {REGS} SELECT * EXCLUDE (pair_no) FROM r")
def regions(spark, d):
    return intervals.assign_regions(derive.pairs(spark, d), derive.arms(spark, d)).drop("_ord")


# --- scaling -------------------------------------------------------------------------------------

EDGES = geometric_edges(1, 10**9)
SCALED = f"""{REGS}, k AS (SELECT *, chrom1 = chrom2 AND start1 = start2 AND end1 = end2 AS same, abs(pos1 - pos2) AS dist FROM r WHERE start1 >= 0 AND start2 >= 0),
b(lo, hi) AS (VALUES {_values(EDGES[:-1], EDGES[-1])}),
cis AS (SELECT chrom1, start1, end1, chrom2, start2, end2, strand1, strand2, lo AS min_dist, hi AS max_dist, count(*)::BIGINT AS n_pairs,
  0.5::DOUBLE * (greatest(end1 - start1 - lo, 0)::BIGINT * greatest(end1 - start1 - lo, 0)::BIGINT - greatest(end1 - start1 - hi, 0)::BIGINT * greatest(end1 - start1 - hi, 0)::BIGINT)::DOUBLE AS n_bp2
  FROM k JOIN b ON dist >= lo AND dist < hi WHERE same GROUP BY ALL),
trans AS (SELECT chrom1, start1, end1, chrom2, start2, end2, strand1, strand2, count(*)::BIGINT AS n_pairs,
  ((end1 - start1) * (end2 - start2))::DOUBLE AS n_bp2 FROM k WHERE NOT same GROUP BY ALL)
"""


def _scaling(spark, d) -> scaling.Scaling:
    return scaling.Scaling(derive.pairs(spark, d), derive.arms(spark, d))


@query(f"WITH {SCALED} SELECT * FROM cis")
def scaling_cis(spark, d):
    return _scaling(spark, d).cis()


@query(f"WITH {SCALED} SELECT * FROM trans")
def scaling_trans(spark, d):
    return _scaling(spark, d).trans()


@query(f"WITH {SCALED} SELECT strand1, strand2, min_dist, max_dist, sum(n_pairs)::BIGINT AS n_pairs, sum((n_bp2 * 2)::HUGEINT)::DOUBLE / 2 AS n_bp2, sum(n_pairs) / nullif(sum((n_bp2 * 2)::HUGEINT)::DOUBLE / 2, 0) AS density FROM cis GROUP BY ALL")
def scaling_by_strands(spark, d):
    return scaling.by_strands(_scaling(spark, d).cis())


DENSE = f"""WITH {SCALED}, st(strand1, strand2) AS (VALUES ('+', '+'), ('+', '-'), ('-', '+'), ('-', '-')),
dc AS (SELECT chrom AS chrom1, s AS start1, e AS end1, chrom AS chrom2, s AS start2, e AS end2, strand1, strand2, lo AS min_dist, hi AS max_dist
  FROM arms CROSS JOIN st CROSS JOIN b),
dt AS (SELECT a.chrom AS chrom1, a.s AS start1, a.e AS end1, c.chrom AS chrom2, c.s AS start2, c.e AS end2, strand1, strand2
  FROM arms a JOIN arms c ON a.chrom <> c.chrom OR a.s <> c.s OR a.e <> c.e CROSS JOIN st)
SELECT dc.*, coalesce(n_pairs, 0)::BIGINT AS n_pairs,
  0.5::DOUBLE * (greatest(end1 - start1 - min_dist, 0)::BIGINT * greatest(end1 - start1 - min_dist, 0)::BIGINT
   - greatest(end1 - start1 - max_dist, 0)::BIGINT * greatest(end1 - start1 - max_dist, 0)::BIGINT)::DOUBLE AS n_bp2
FROM dc LEFT JOIN (SELECT * EXCLUDE (n_bp2, max_dist) FROM cis) x USING (chrom1, start1, end1, chrom2, start2, end2, strand1, strand2, min_dist)
UNION ALL SELECT dt.*, NULL, NULL, coalesce(n_pairs, 0)::BIGINT, ((end1 - start1) * (end2 - start2))::DOUBLE
FROM dt LEFT JOIN (SELECT * EXCLUDE (n_bp2) FROM trans) x USING (chrom1, start1, end1, chrom2, start2, end2, strand1, strand2)"""


@query(DENSE)
def scaling_dense(spark, d):
    return _scaling(spark, d).table(dense=True)


@query(f"WITH {SCALED} SELECT round(sum(n_pairs)::DOUBLE / sum(n_bp2) * 1e15)::BIGINT AS pairs_in_1e15 FROM trans")
def scaling_trans_density(spark, d):
    return scaling.mean_trans_density(_scaling(spark, d).trans()).select(F.round(F.col("trans_density") * 1e15).cast("long").alias("pairs_in_1e15"))


@query(f"""WITH {SCALED}, s AS (SELECT min_dist, max_dist, sum(n_pairs)::BIGINT AS n_pairs, sum((n_bp2 * 2)::HUGEINT)::DOUBLE / 2 AS n_bp2 FROM cis GROUP BY ALL),
u AS (SELECT sum(n_pairs) / sum(n_bp2) AS unit FROM s WHERE min_dist >= 1000)
SELECT min_dist, n_pairs, round(CASE WHEN n_bp2 > 0 THEN n_pairs / n_bp2 END / unit * 1e6)::BIGINT AS millionths FROM s, u""")
def scaling_normalised(spark, d):
    profile = scaling.by_strands(_scaling(spark, d).cis()).groupBy("min_dist", "max_dist").agg(F.sum("n_pairs").alias("n_pairs"), scaling.area_sum().alias("n_bp2"))
    return scaling.normalised(profile).select("min_dist", "n_pairs", F.round(F.col("relative_density") * 1e6).cast("long").alias("millionths"))


@query(f"""WITH {P}, b(lo, hi) AS (VALUES {_values(EDGES[:-1], EDGES[-1])}) SELECT chrom1, lo AS min_dist, count(*)::BIGINT AS n_pairs FROM p JOIN b ON abs(pos1 - pos2) >= lo AND abs(pos1 - pos2) < hi
 WHERE chrom1 = chrom2 GROUP BY ALL""")
def scaling_whole_chroms(spark, d):
    out = scaling.Scaling(derive.pairs(spark, d)).cis()
    return out.groupBy("chrom1", "min_dist").agg(F.sum("n_pairs").alias("n_pairs"))


# --- parse ---------------------------------------------------------------------------------------


def _parsed_sql() -> str:
    side = """CASE WHEN chrom{i} = '!' OR coalesce(mapq{i}, 60) < 1 THEN '!' ELSE chrom{i} END AS chrom{i},
 CASE WHEN chrom{i} = '!' OR coalesce(mapq{i}, 60) < 1 THEN 0 WHEN strand{i} = '-' THEN greatest(pos{i} - 49, 1) + 49 ELSE pos{i} END AS pos{i},
 CASE WHEN chrom{i} = '!' OR coalesce(mapq{i}, 60) < 1 THEN '-' ELSE strand{i} END AS strand{i}"""
    letter = "CASE WHEN chrom{i} = '!' THEN 'N' WHEN coalesce(mapq{i}, 60) < 1 THEN 'M' ELSE 'U' END"
    return f"SELECT 'q' || pair_no AS \"readID\", {side.format(i=1)}, {side.format(i=2)}, {letter.format(i=1)} || {letter.format(i=2)} AS pair_type FROM pairs"


@query(_parsed_sql())
def parse(spark, d):
    chroms = derive.chrom_order(spark, d, 10**9)
    return parse_sam(derive.sam_lines(spark, d), chroms, flip=False, drop_sam=True).drop("_ord")


def _walks(name: str, options: WalkOptions, sql: str) -> None:
    def run(spark, d):
        lines = derive.sam_lines(spark, d, chimeric=True)
        return parse_sam(lines, derive.chrom_order(spark, d, 10**9), options, drop_sam=True, add_pair_index=True).drop("_ord")

    run.__name__ = name
    query(sql)(run)


OUTER, JUNCTION = {"R1": (2,), "R1-2": ()}, {"R1": (1,), "R1-2": (1, 2)}
for _policy in POLICIES:
    _walks(f"parse_walks_{_policy}", WalkOptions(policy=_policy), walk_sql.all_contacts(750, True, OUTER) if _policy == "all" else walk_sql.one_contact(_policy))
_walks("parse2_outer", WalkOptions(parse2=True, max_size=500), walk_sql.all_contacts(500, False, OUTER))
_walks("parse2_junction", WalkOptions(parse2=True, max_size=500, position="junction", orientation="junction"), walk_sql.all_contacts(500, False, JUNCTION))
_walks("parse2_expand", WalkOptions(parse2=True, max_size=500, expand=True), walk_sql.all_contacts(500, False, OUTER, True))


@query(walk_sql.ALIGNMENTS)
def parsed_alignments(spark, d):
    return all_alignments(derive.sam_lines(spark, d, chimeric=True))


@query(f"WITH x AS ({_parsed_sql()}), p AS (SELECT *, 0 AS pair_no FROM x), "
       + _counts_sql("").removeprefix("WITH , "))
def parse_stats(spark, d):
    return stats.PairStats(parse(spark, d)).counts()
