import pytest

from contactloom.plans import derive
from contactloom.plans.pair_queries import ORACLE, QUERIES

SIZES = [("chr1", 120_000, 1), ("chr2", 50_000, 20), ("scaffold21", 70_000, 21), ("scaffold216", 10, 216)]
ROWS = [
    ("far", "scaffold21", 10, "scaffold21", 60_000, "+", "-"), ("near", "chr1", 10, "chr1", 20, "+", "-"), ("tiny", "scaffold216", 9, "chr1", 20, "-", "-"),
    ("unmapped", "!", 0, "scaffold21", 1, "-", "+"), ("unknown", "elsewhere", 5, "chr2", 5, "+", "+"), ("beyond", "scaffold21", 70_500, "chr2", 5, "+", "+"),
]


@pytest.fixture
def tables(frame, tmp_path):
    d = str(tmp_path)
    frame(SIZES, "chrom string, chrom_len long, chrom_rank int").write.parquet(f"{d}/chromsizes.parquet")
    columns = "readid string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string, pair_no long"
    frame([(*r, "UU", i) for i, r in enumerate(ROWS)], columns).write.parquet(f"{d}/pairs.parquet")
    return d


def test_every_chromosome_has_fragments_and_arms(spark, tables):
    names = {c for c, _, _ in SIZES}
    assert {r.chrom for r in derive.fragments(spark, tables).collect()} == {r.chrom for r in derive.arms(spark, tables).collect()} == names


def test_sides_with_and_without_fragments_and_regions(spark, tables):
    frags = {r.readID: (r.rfrag1, r.rfrag_start1, r.rfrag_end1, r.rfrag2) for r in QUERIES["restrict"](spark, tables).collect()}
    assert frags["far"] == (0, 0, 50_001, 1) and frags["tiny"] == (0, 0, 11, 0) and frags["beyond"][0] == 1
    assert frags["unmapped"] == (-1, 0, 0, 0) and frags["unknown"] == (-1, 0, 0, 0)
    arms = {r.readID: (r.start1, r.end1, r.start2, r.end2) for r in QUERIES["regions"](spark, tables).collect()}
    assert arms["far"] == (0, 35_000, 35_000, 70_000) and arms["tiny"] == (5, 10, 0, 60_000)
    assert arms["unmapped"][:2] == arms["unknown"][:2] == arms["beyond"][:2] == (-1, -1)
    classes = {r["class"]: r.uu for r in QUERIES["fragment_classes"](spark, tables).collect()}
    assert classes == {"dangling_end": 2, "regular": 4}
    ends = {r.readID for r in QUERIES["fragment_end_distances"](spark, tables).collect()}
    assert ends == {"far", "near", "tiny", "beyond"}


def test_scaling_sees_every_chromosome(spark, tables):
    assert "scaffold21" in {r.chrom1 for r in QUERIES["scaling_dense"](spark, tables).select("chrom1").distinct().collect()}
    got = sorted((r.chrom1, r.chrom2, r.n_pairs) for r in QUERIES["scaling_trans"](spark, tables).collect())
    assert got == [("scaffold21", "scaffold21", 1), ("scaffold216", "chr1", 1)]


OVER_ALL = ["restrict", "fragment_classes", "fragment_end_distances", "regions", "scaling_cis", "scaling_trans", "scaling_by_strands"]


@pytest.mark.parametrize("name", OVER_ALL)
def test_all_chromosomes_agree_with_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pairs", "chromsizes"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    assert "chrom_rank" not in ORACLE[name]
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, tables).select(*[f"`{c}`" for c in want.columns])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
