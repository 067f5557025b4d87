import random

import pytest
from brute import components
from pyspark.sql import functions as F

from contactloom.functions.bins import geometric_edges, stats_edges
from contactloom.functions.complexity import estimate_complexity, lambert_w0
from contactloom.functions.predicates import Unsupported, wildcard_regex
from contactloom.operators import coverage, intervals, order, rowwise, scaling, stats
from contactloom.operators.dedup import Dedup

PAIRS = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string"


def pair(name, c1, p1, c2, p2, s="++", t="UU"):
    return (name, c1, p1, c2, p2, s[0], s[1], t)


@pytest.fixture
def random_pairs(frame):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        c1, c2 = rng.choice(["chr1", "chr1", "chr2", "!"]), rng.choice(["chr1", "chr2", "!"])
        rows.append(pair(f"r{i}", c1, rng.randrange(60) if c1 != "!" else 0, c2, rng.randrange(60) if c2 != "!" else 0, rng.choice(["++", "+-"])))
    return rows, frame([(*r, i) for i, r in enumerate(rows)], PAIRS + ", _ord long")


def near(a, b, r, method):
    if a[1] == "!" or a[3] == "!" or (a[1], a[3], a[5], a[6]) != (b[1], b[3], b[5], b[6]):
        return False
    d1, d2 = abs(a[2] - b[2]), abs(a[4] - b[4])
    return max(d1, d2) <= r if method == "max" else d1 + d2 <= r


@pytest.mark.parametrize("method,r", [("max", 3), ("sum", 3), ("max", 0), ("max", 7)])
def test_dedup_against_brute_force(random_pairs, method, r):
    rows, df = random_pairs
    mapped = [i for i, x in enumerate(rows) if "!" not in (x[1], x[3])]
    want = components(mapped, lambda a, b: near(rows[a], rows[b], r, method))
    got = {x["_ord"]: (x["duplicate"], x["parent_readID"]) for x in Dedup(df, r, method).marked().collect()}
    assert got == {i: (k != i, f"r{k}") for i, k in want.items()}


def test_greedy_follows_no_chains(frame):
    df = frame([(*pair("a", "chr1", 1, "chr1", 10), 0), (*pair("b", "chr1", 1, "chr1", 13), 1), (*pair("c", "chr1", 1, "chr1", 16), 2)], PAIRS + ", _ord long")
    kept = lambda d: sorted(r.readID for r in d.marked().filter("not duplicate").collect())
    assert kept(Dedup(df, 3)) == ["a"]
    assert kept(Dedup(df, 3, backend="greedy")) == ["a", "c"]


def test_dedup_of_equal_rows_nulls_and_empty(frame, spark):
    rows = [pair("x", "chr1", 5, "chr1", 9)] * 50 + [pair(None, "chr1", None, "chr1", 9), pair("n", None, 3, "chr1", 9), pair("s", "chr1", 5, "chr1", 9, "+-")]
    parts = Dedup(frame(rows, PAIRS)).split()
    assert {k: v.count() for k, v in parts.items()} == {"dedup": 2, "dups": 49, "unmapped": 2}
    assert {r.pair_type for r in parts["dups"].collect()} == {"DD"}
    assert Dedup(frame([], PAIRS)).marked().count() == 0
    extra = frame([(*r, "note", 1, "x") for r in rows], PAIRS + ", root string, n int, kept string")
    assert Dedup(extra).marked().count() == 51


def test_dedup_extra_columns_and_sam_marks(frame):
    sam = "q\x1965\x19chr1\x195\x19Yt:Z:UU"
    rows = [(*pair(f"r{i}", "chr1", 5, "chr1", 9), k, sam, ".") for i, k in enumerate(["a", "a", "b", None, None])]
    parts = Dedup(frame(rows, PAIRS + ", bc string, sam1 string, sam2 string"), extra_pairs=[("bc", "bc")]).split(keep_parent_id=True)
    assert sorted(r.readID for r in parts["dedup"].collect()) == ["r0", "r2", "r3"]
    dup = parts["dups"].orderBy("readID").first()
    assert (dup.parent_readID, dup.sam1, dup.sam2) == ("r0", "q\x191089\x19chr1\x195\x19Yt:Z:DD", ".")


@pytest.mark.parametrize("method", ["max", "sum"])
@pytest.mark.parametrize("dist,cov", [(0, 3), (1, 2), (5, 9)])
def test_coverage_against_brute_force(random_pairs, method, dist, cov):
    rows, df = random_pairs
    mapped = [r for r in rows if "!" not in (r[1], r[3])]
    ends = [(r[1], r[2]) for r in mapped] + [(r[3], r[4]) for r in mapped]
    n = lambda c, p: sum(1 for x, y in ends if x == c and abs(y - p) <= dist)
    value = lambda r: max(n(r[1], r[2]), n(r[3], r[4])) if method == "max" else n(r[1], r[2]) + n(r[3], r[4]) - 1
    parts = coverage.filter_by_coverage(df, cov, dist, method)
    assert sorted(r.readID for r in parts["highcov"].collect()) == sorted(r[0] for r in mapped if value(r) > cov)
    assert sum(p.count() for p in parts.values()) == len(rows)


def test_coverage_across_block_borders(frame):
    rows = [pair(f"r{i}", "chr1", 65536 * 3 - 2 + i, "chr1", 65536 * 5 + i) for i in range(5)]
    assert coverage.filter_by_coverage(frame(rows, PAIRS), 4, 4)["highcov"].count() == 5


def test_flip_orders_sides_and_is_stable(frame):
    rows = [
        pair("a", "chr2", 5, "chr1", 9, "+-", "UR"), pair("b", "chr1", 9, "chr1", 5), pair("c", "chrU", 1, "chr1", 5),
        pair("d", "chrU", 1, "chrU", 9), pair("e", "chr1", 1, "!", 0, "+-", "UN"), pair("f", "chrA", 1, "chrB", 2),
        pair("g", None, 1, "chr1", 2),
    ]
    out = {r.readID: r for r in rowwise.flip(frame(rows, PAIRS), ["chr1", "chr2"]).collect()}
    assert out["a"][1:] == ("chr1", 9, "chr2", 5, "-", "+", "RU")
    assert (out["b"].pos1, out["c"].chrom1, out["e"].chrom1, out["f"].chrom1) == (5, "chr1", "!", "chrA")
    assert out["d"].pos1 == 9  # equal unlisted names are always exchanged
    kept = rowwise.flip(frame(rows, PAIRS), ["chr1", "chr2"], keep_equal_unlisted=True)
    again = rowwise.flip(kept, ["chr1", "chr2"], keep_equal_unlisted=True)
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))
    assert out["g"].chrom2 == "chr1"


CONDITIONS = {
    'chrom1 == chrom2 and pos2 - pos1 > 3': ["a"], 'wildcard_match(chrom1, "chr[!2]")': ["a", "c"], 'not regex_match(chrom1, "chr[12]")': ["c"],
    'region_match(chrom1, pos1, "chr1", 2, 5)': ["a"], "pos1 < 3 < pos2": ["b", "c"], 'csv_match(pair_type, "RU,NU")': ["c"],
    'COLS[0][-1:] in ["a", "c"]': ["a", "c"], "int(str(pos1)) // 2 == 2": ["a"], '"a" if pos1 > 4 else ""': ["a"], "-7 // 2 == -4 and -7 % 3 == 2": ["a", "b", "c"],
    "chrom1 == 5": [], "chrom1 != 5": ["a", "b", "c"], "min(pos1, pos2) == 1 or max(pos1, 2) == 2": ["b", "c"], 'readID.upper() + "x" == "Bx"': ["b"],
}


@pytest.mark.parametrize("text", CONDITIONS)
def test_conditions(frame, text):
    rows = [pair("a", "chr1", 5, "chr1", 9), pair("b", "chr2", 1, "chr1", 9), pair("c", "chr3", 1, "!", 7, "+-", "RU")]
    df = frame(rows, PAIRS)
    assert sorted(r.readID for r in rowwise.select(df, text).collect()) == CONDITIONS[text]
    rest = rowwise.select_rest(df, text).count()
    assert rest == 3 - len(CONDITIONS[text])
    python = rowwise.select(df, text + " and len(COLS) > 0", python=True) if "else" not in text else None
    assert python is None or sorted(r.readID for r in python.collect()) == CONDITIONS[text]


def test_conditions_that_are_turned_down(frame):
    df = frame([pair("a", "chr1", 5, "chr1", 9)], PAIRS)
    for text in ("__import__('os')", "unknown > 3", "chrom1 < 3", "regex_match(chrom1, '(?P<x>a)')", "[x for x in chrom1]"):
        with pytest.raises(Unsupported):
            rowwise.select(df, text)
    assert rowwise.select(df, "double(pos1) == 10", python=True, startup="double = lambda x: 2 * x").count() == 1
    assert rowwise.select(frame([pair("a", None, None, "chr1", 9)], PAIRS), "pos1 > 3 and chrom1 == 'x'").count() == 0


def test_wildcards():
    assert wildcard_regex("a.b*") == "a\\.b[\\s\\S]*"


def test_sort_is_by_bytes_and_merge_conserves(frame):
    rows = [pair("a", "chr2", 1, "chr2", 1), pair("b", "chr10", 9, "chr10", 9), pair("c", "!", 0, "chr1", 3), pair("d", "chr10", 10, "chr10", 10)]
    df = frame(rows, PAIRS)
    assert [r.readID for r in order.sort_pairs(df).collect()] == ["c", "b", "d", "a"]
    assert order.union_pairs([df, df]).count() == 8


def test_samples(frame):
    df = frame([pair(f"r{i}", "chr1", i, "chr1", i) for i in range(2000)], PAIRS)
    assert rowwise.sample_by_hash(df, 1.0).count() == 2000 and rowwise.sample_by_hash(df, 0.0).count() == 0
    half = {r.readID for r in rowwise.sample_by_hash(df, 0.5).collect()}
    assert half == {r.readID for r in rowwise.sample_by_hash(df.repartition(3), 0.5).collect()} and 850 < len(half) < 1150


def test_restrict_and_regions(frame):
    bed = frame([("chr1", 0, 100), ("chr1", 100, 500), ("chr1", 500, 10000), ("chr2", 0, 200), ("chr2", 200, 10000)], "chrom string, start long, end long")
    places = [("chr1", 1), ("chr1", 100), ("chr1", 499), ("chr1", 600), ("chr1", 10001), ("chr2", 500), ("!", 0), ("chr9", 4), ("chr1", 101)]
    df = frame([pair(f"r{i}", c, p, "chr2", 20) for i, (c, p) in enumerate(places)], PAIRS)
    out = {r.readID: (r.rfrag1, r.rfrag_start1, r.rfrag_end1) for r in intervals.restrict(df, bed).collect()}
    assert list(map(out.get, [f"r{i}" for i in range(9)])) == [
        (0, 0, 101), (0, 0, 101), (1, 101, 501), (2, 501, 10001), (2, 501, 10001), (1, 201, 10001), (-1, 0, 0), (-1, 0, 0), (1, 101, 501),
    ]
    clash = df.withColumns({c: F.lit("x") for c in ("lo", "hi", "idx", "chrom", "start", "end")})
    assert intervals.restrict(clash, bed).filter("rfrag1 = 2").count() == 2
    regions = frame([("chr1", 0, 100), ("chr1", 200, 700)], "chrom string, start long, end long")
    got = {r.readID: (r.start1, r.end1) for r in intervals.assign_regions(df, regions).collect()}
    assert (got["r0"], got["r1"], got["r3"], got["r5"]) == ((0, 100), (-1, -1), (200, 700), (-1, -1))


def test_interval_lookup_by_shuffle_is_the_same(frame, monkeypatch):
    rng = random.Random(1)
    bed = frame([("chr1", a, b) for a, b in zip(range(0, 900, 90), range(90, 990, 90))], "chrom string, start long, end long")
    df = frame([pair(f"r{i}", "chr1", rng.randrange(1000), "chr1", 7) for i in range(200)], PAIRS)
    want = sorted(map(tuple, intervals.restrict(df, bed).collect()))
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, intervals.restrict(df, bed).collect())) == want


STATS = [
    pair("1", "chr1", 1, "chr1", 50), pair("2", "chr1", 1, "chr1", 50, t="DD"), pair("3", "chr1", 1, "chr1", 2, t="UR"), pair("4", "chr1", 1, "chr1", 3),
    pair("5", "chr1", 1, "chr2", 20), pair("6", "chr2", 1, "chr3", 2), pair("7", "!", 0, "chr1", 3, "-+", "NU"), pair("8", "!", 0, "chr1", 3, "-+", "MU"),
    pair("9", "!", 0, "!", 0, "--", "WW"),
]


def test_stats(frame):
    s = stats.PairStats(frame(STATS, PAIRS))
    counts = {r.key: r.value for r in s.counts().collect()}
    assert {k: counts[k] for k in stats.COUNTS} == {
        "total": 9, "total_unmapped": 1, "total_single_sided_mapped": 2, "total_mapped": 6, "total_dups": 1, "total_nodups": 5, "cis": 3, "trans": 2,
    }
    assert {r.pair_type: r.value for r in s.pair_types().collect()} == {"UU": 4, "DD": 1, "UR": 1, "NU": 1, "MU": 1, "WW": 1}
    dist = {(r.strands, r.min_dist): r.value for r in s.dist_freq().collect()}
    assert len(dist) == 4 * 72 and {k for k, v in dist.items() if v} == {("++", 1), ("++", 2), ("++", 42)}
    row = stats.summary(s.counts()).first()
    assert row.frac_cis == pytest.approx(0.6) and row.frac_dups == pytest.approx(1 / 6)
    long = {r.key: r.value for r in s.long().collect()}
    assert long["chrom_freq/chr1/chr1"] == 3 and long["dist_freq/42-56/++"] == 1 and long["dist_freq/1000000000+/--"] == 0


def test_stats_merge_equals_stats_of_union(frame):
    df = frame(STATS, PAIRS)
    halves = [stats.PairStats(df.filter(F.col("readID") % 2 == k)).counts() for k in (0, 1)]
    key = lambda x: sorted(map(tuple, x.select("filter", "key", "value").collect()))
    assert key(stats.merge_stats(halves)) == key(stats.PairStats(df).counts())


def test_stats_of_nothing_and_nulls(frame):
    assert stats.PairStats(frame([], PAIRS)).counts().count() == 0
    row = stats.PairStats(frame([(None,) * 8], PAIRS)).counts().filter("key = 'total_unmapped'").first()
    assert row.value == 1


def test_convergence():
    freq = {"++": [80, 80, 91, 95], "--": [100] * 4, "-+": [100] * 4, "+-": [120, 120, 109, 105]}
    out = stats.convergence(freq, [1, 1000, 10_000, 100_000, 1_000_000], 0.1)
    assert (out["convergence_dist"], out["strands_w_max_convergence_dist"]) == (10_000, "++")
    assert stats.convergence({k: [5, 5] for k in freq}, [1, 10, 100])["strands_w_max_convergence_dist"] == "??"


def test_complexity_solves_its_equation():
    import math

    for x in (-0.36, -0.3, -0.1, 0.5, 3.0):
        w = lambert_w0(x)
        assert w * math.exp(w) == pytest.approx(x, abs=1e-12)
    c = estimate_complexity(1000, 100)
    assert c * (1 - math.exp(-1000 / c)) == pytest.approx(900, rel=1e-6)
    assert estimate_complexity(0, 0) == 0 and estimate_complexity(10, 10) == 0 and estimate_complexity(10, 0) == math.inf


def test_tiles(frame):
    df = frame([("a:b:1:2:3:x", "a:b:1:2:4:y"), ("a:b:1:2:4:x", "a:b:1:2:3:y"), ("a:b:1:2:3:x", "a:b:1:2:3:y")], "readID string, parent_readID string")
    tiles = stats.tile_duplicates(df)
    assert sorted(map(tuple, tiles.collect())) == [("1:2:3", "1:2:3", 1), ("1:2:3", "1:2:4", 2)]
    assert stats.tile_summary(tiles, 100, 10)["dups_by_tile_median"] == 3


def test_edges():
    e = stats_edges()
    assert len(e) == 72 and e[:14] == [0, 1, 2, 3, 4, 6, 7, 10, 13, 18, 24, 32, 42, 56] and e[-1] == 10**9
    assert geometric_edges(1, 10**9) == e[1:] and len(geometric_edges(10, 10**9)) == 65


def test_scaling(frame):
    rows = [pair("1", "chr1", 1, "chr1", 50), pair("2", "chr1", 5, "chr1", 5), pair("3", "!", 0, "chr1", 3), pair("4", "chr1", 1, "chr2", 20), pair("5", "!", 0, "!", 0)]
    s = scaling.Scaling(frame(rows, PAIRS))
    assert [tuple(r) for r in s.cis().select("chrom1", "min_dist", "max_dist", "n_pairs").collect()] == [("chr1", 42, 56, 1)]
    assert sorted((r.chrom1, r.chrom2) for r in s.trans().collect()) == [("!", "chr1"), ("chr1", "chr2")]
    regions = frame([("chr1", 0, 100), ("chr2", 0, 30)], "chrom string, start long, end long")
    dense = scaling.Scaling(frame(rows, PAIRS), regions)
    cis = dense.cis(dense=True)
    assert cis.agg(F.sum("n_pairs")).first()[0] == 1 and cis.count() == 2 * 4 * 70  # the region without pairs too
    assert cis.filter("min_dist = 42 and chrom1 = 'chr1'").first().n_bp2 == 0.5 * (58**2 - 44**2)
    trans = dense.trans(dense=True)
    assert trans.count() == 8 and trans.agg(F.sum("n_pairs")).first()[0] == 1 and trans.first().n_bp2 == 3000


def test_phase(frame):
    cols = "XB1 string, AS1 int, XS1 int, XB2 string, AS2 int, XS2 int"
    homologue, other, third = "chr1_b,+5,50M,0,50,60;", "chr7_a,+5,50M,0,50,60;", "chr9_a,+5,50M,0,50,60;"
    cases = [("", 50, 40), (homologue, 50, 50), (other, 50, 50), (homologue + third, 50, 50), ("", 50, 50)]
    rows = [(*pair(f"r{i}", "chr1_a", 5, "!", 0), *c, "", 0, 0) for i, c in enumerate(cases)]
    out = {r.readID: r for r in rowwise.phase(frame(rows, PAIRS + ", " + cols), ("_a", "_b"), report_scores=True, clean=True).collect()}
    assert [out[f"r{i}"].phase1 for i in range(5)] == ["0", ".", "!", "!", "!"]
    assert [out[f"r{i}"].chrom1 for i in range(5)] == ["chr1", "chr1", "!", "!", "!"]
    assert (out["r2"].pos1, out["r2"].strand1, out["r2"].pair_type) == (0, "-", "MU")
    assert (out["r3"].S3_1, out["r0"].S3_1, out["r0"].phase2, out["r0"].S1_2) == (50, -1, "!", -1)
    with pytest.raises(ValueError):
        rowwise.phase(frame([pair("a", "chr1", 1, "chr1", 2)], PAIRS))


def test_markasdup_and_split(frame):
    two = "q\x1965\x19c\x19Yt:Z:UU\x19NEXT_SAM\x19q\x192113\x19c\x19Yt:Z:UU"
    df = frame([(*pair("a", "chr1", 1, "chr1", 2), two, ".")], PAIRS + ", sam1 string, sam2 string")
    once = rowwise.mark_as_dup(df)
    assert once.first().sam1 == two.replace("65", "1089").replace("2113", "3137").replace("UU", "DD")
    assert once.collect() == rowwise.mark_as_dup(once).collect()
    assert [r.value for r in rowwise.split_sam(df).collect()] == ["q\t65\tc\tYt:Z:UU", "q\t2113\tc\tYt:Z:UU"]
    assert rowwise.split_pairs(df).columns[-1] == "pair_type"
