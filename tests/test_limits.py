"""Walks without the common parsers' limits, nameless reads, dense tables, offsets between neighbours."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactloom.operators.dedup import BLOCK, neighbour_offsets
from contactloom.operators.parse import parse_sam
from contactloom.operators.scaling import Scaling, by_strands, mean_trans_density, normalised
from contactloom.operators.stats import NO_FILTER, PairStats, full_summary, merge_stats
from contactloom.operators.walks import Alignment, WalkOptions, fill_gaps, molecule_contacts
from contactloom.runtime import Scratch, join_unique


def aligned(chrom, pos, start, length=30, strand="+", unique=True):
    end = pos + length - 1 if strand == "+" else pos - length + 1
    return Alignment(chrom, pos, end, strand, 60, True, unique, type="U" if unique else "M", dist_to_5=start, algn_read_span=length, read_len=150)


def test_all_gaps_without_the_limit():
    parts = [aligned("c", 1, 30), aligned("c", 500, 100), aligned("c", 900, 160)]
    kinds = lambda parity: [x.is_mapped for x in fill_gaps(parts, 20, parity)]
    assert kinds(True) == [False, True, False, True, True] and kinds(False) == [False, True, False, True, False, True]
    assert kinds(False)[0] is False and fill_gaps([], 20) == []
    inside = [aligned("c", 1, 0, 100), aligned("c", 500, 10, 20), aligned("c", 900, 115, 20)]
    assert all(x.is_mapped for x in fill_gaps(inside, 20, False))


def test_all_junctions_of_the_right_read_without_the_limit():
    left = [aligned("c", 1, 0), aligned("d", 1, 30)]
    right = [aligned("e", 1, 0), aligned("f", 1, 30), aligned("g", 1, 60)]
    found = lambda parity: [(c.left.chrom, c.right.chrom, c.index, c.kind) for c in molecule_contacts(left, right, WalkOptions(policy="all", parity=parity))[0]]
    assert found(True) == [("c", "d", 1, "R1"), ("d", "g", 2, "R1-2"), ("f", "e", 3, "R2")]
    assert found(False) == [("c", "d", 1, "R1"), ("d", "g", 2, "R1-2"), ("g", "f", 3, "R2"), ("f", "e", 4, "R2")]


def test_uniqueness_is_asked_of_the_outer_part_without_the_limit():
    chimeric = [aligned("c", 1, 0, unique=False), aligned("d", 900_000, 30)]
    kind = lambda parity: molecule_contacts([a for a in chimeric], [aligned("c", 300, 0)], WalkOptions(policy="mask", parity=parity))[0][0].kind
    assert kind(True) == "R1" and kind(False) == "R1-2"


def test_lines_without_a_name_are_molecules_of_their_own(frame):
    line = lambda name, flag, pos: "\t".join([name, str(flag), "chr1", str(pos), "60", "50M", "*", "0", "0", "*", "*"])
    lines = [line("*", 65, 10), line("*", 129, 200), line(".", 65, 400), line("a", 65, 5), line("a", 129, 700)]
    rows = parse_sam(frame([(x, i) for i, x in enumerate(lines)], "value string, _ord long"), ["chr1"], drop_sam=True).collect()
    assert sorted((r.readID, r.pair_type) for r in rows) == [("*", "XX"), ("*", "XX"), (".", "XX"), ("a", "UU")]


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_between_neighbours(frame, seed):
    rng = random.Random(seed)
    near = lambda: BLOCK * rng.randrange(1, 4) + rng.randrange(-9, 9)
    rows = [(rng.choice("ab"), near(), rng.choice("ab!"), near(), rng.choice("+-"), "+", i) for i in range(250)] + [("a", None, "b", 1, "+", "+", 900), (None, 1, "b", 1, "+", "+", 901)]
    df = frame(rows, "chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, n long")
    want = Counter()
    for i, a in enumerate(rows[:250]):
        for b in rows[:i]:
            if a[0] == b[0] and a[2] == b[2] != "!" and a[4] == b[4] and abs(a[1] - b[1]) <= 5 and abs(a[3] - b[3]) <= 5:
                want[abs(a[1] - b[1]), abs(a[3] - b[3])] += 1
    assert {(r.d1, r.d2): r.n for r in neighbour_offsets(df, 5).collect()} == want
    assert neighbour_offsets(df.limit(0), 5).count() == 0


def test_dense_tables_have_every_region(frame):
    columns = "chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string"
    df = frame([("c1", 5, "c1", 50, "+", "-"), ("c1", 5, "out", 1, "+", "-"), (None, 1, "c1", 2, "+", "+")], columns)
    view = frame([("c1", 0, 100), ("c9", 0, 1000)], "chrom string, start long, end long")
    s = Scaling(df, view, dist_range=(1, 1000))
    cis, trans = s.cis(dense=True), s.trans(dense=True)
    assert {r.chrom1 for r in cis.select("chrom1").distinct().collect()} == {"c1", "c9"} and cis.agg(F.sum("n_pairs")).first()[0] == 1
    assert sorted((r.chrom1, r.chrom2, r.strand1 + r.strand2, r.n_pairs) for r in trans.collect()) == sorted((a, b, x + y, 0) for a, b in (("c1", "c9"), ("c9", "c1")) for x in "+-" for y in "+-")
    kept = Scaling(df, view, filter_f=lambda d: d.filter("pos1 > 5"))
    assert kept.cis().count() == 0
    profile = by_strands(s.cis())
    assert normalised(profile, lo=1).first().relative_density == pytest.approx(1.0)
    assert mean_trans_density(s.trans()).first().trans_density is None


def test_statistics_of_one_scan_and_of_merged_tables(frame):
    columns = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string"
    rows = [(f"r{i}", "c", i, "c", i * 40, "+", "-", "DD" if i % 4 == 0 else "UU") for i in range(1, 60)]
    s = PairStats(frame(rows, columns)).once()
    assert s.once() is s and s.long().count() > 0
    plan = s.long()._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan
    whole = full_summary(s)[NO_FILTER]
    assert whole["summary/complexity_naive"] > 45 and "summary/dist_freq_convergence/convergence_dist" in whole
    sizes = frame([(NO_FILTER, "chromsizes/c", 9)], "filter string, key string, value long")
    merged = merge_stats([s.long().unionByName(sizes), s.long()])
    got = {r.key: r.value for r in merged.collect()}
    assert got["chromsizes/c"] == 9 and got["total"] == 118
    with pytest.raises(ValueError):
        merge_stats([sizes, sizes.withColumn("value", F.lit(8).cast("long"))])


def test_hot_keys_are_joined_apart(spark, frame):
    left = frame([(1, i) for i in range(3000)] + [(k, k) for k in range(2, 50)] + [(None, 1)], "k int, v int")
    right = frame([(k, k * 10) for k in range(0, 40)], "k int, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, join_unique(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
    scratch = Scratch(spark, "x")
    kept = scratch.write(left)
    assert scratch.read([kept, kept]).count() == 2 * left.count()
    scratch.drop(kept)
    with pytest.raises(Exception):
        kept.count()
