import random

import pytest

from contactloom.operators.parse import all_alignments, parse_sam
from contactloom.operators.walks import Alignment, WalkOptions, fill_gaps, mismatches, overlap_length

CHROMS = ["chr1", "chr2"]


def line(name, flag, chrom, pos, cigar="50M", mapq=60, *tags):
    return "\t".join([name, str(flag), chrom, str(pos), str(mapq), cigar, "*", "0", "0", "ACGT", "IIII", *tags])


def parsed(frame, lines, options=None, **kw):
    df = frame([(x, i) for i, x in enumerate(lines)], "value string, _ord long")
    rows = parse_sam(df, CHROMS, options, add_pair_index=True, **{"drop_sam": True} | kw).orderBy("_ord", "walk_pair_index").collect()
    return [(r.readID, r.chrom1, r.pos1, r.chrom2, r.pos2, r.strand1 + r.strand2, r.pair_type, r.walk_pair_index, r.walk_pair_type) for r in rows]


# Molecules of one or two parts on each side, with what each policy has to report.
LINEAR = [line("a", 65, "chr1", 10), line("a", 129, "chr1", 200)]
BACK = [line("b", 65, "chr1", 10), line("b", 145, "chr1", 200)]
TURNED = [line("c", 65, "chr2", 10), line("c", 129, "chr1", 200)]
UNMAPPED = [line("d", 65, "chr1", 10), line("d", 133, "*", 0, "*", 0)]
MULTI = [line("e", 65, "chr1", 10, mapq=0), line("e", 129, "chr1", 200)]
ALONE = [line("f", 129, "chr1", 200)]
RESCUED = [line("g", 65, "chr1", 10, "25M25S"), line("g", 2129, "chr1", 300, "25M25H"), line("g", 129, "chr1", 200)]
FAR = [line("h", 65, "chr1", 10, "25M25S"), line("h", 2129, "chr1", 5300, "25M25H"), line("h", 129, "chr1", 200)]
GAP = [line("i", 65, "chr1", 10, "30S20M"), line("i", 129, "chr1", 200)]


@pytest.mark.parametrize(
    "lines,want",
    [
        (LINEAR, ("a", "chr1", 10, "chr1", 200, "++", "UU", 1, "R1-2")), (BACK, ("b", "chr1", 10, "chr1", 249, "+-", "UU", 1, "R1-2")),
        (TURNED, ("c", "chr1", 200, "chr2", 10, "++", "UU", 1, "R1-2")), (UNMAPPED, ("d", "!", 0, "chr1", 10, "-+", "NU", 1, "R1-2")),
        (MULTI, ("e", "!", 0, "chr1", 200, "-+", "MU", 1, "R1-2")), (ALONE, ("f", "!", 0, "!", 0, "--", "XX", 1, "R1-2")),
        (RESCUED, ("g", "chr1", 10, "chr1", 200, "++", "UR", 1, "R1")), (FAR, ("h", "!", 0, "!", 0, "--", "WW", 1, "R1-2")),
    ],
)
def test_mask(frame, lines, want):
    assert parsed(frame, lines, WalkOptions(policy="mask")) == [want]


def test_other_policies(frame):
    pick = lambda policy, lines: parsed(frame, lines, WalkOptions(policy=policy))[0][1:7]
    assert pick("5any", FAR) == ("chr1", 10, "chr1", 200, "++", "UU")
    assert pick("3any", FAR) == ("chr1", 200, "chr1", 5324, "+-", "UU")
    parts = [line("x", 65, "chr1", 10, "15M35S", 0), line("x", 2113, "chr1", 3000, "15S15M20S"), line("x", 2113, "chr1", 8000, "30S20M"), line("x", 129, "chr1", 200)]
    assert pick("5unique", parts) == ("chr1", 200, "chr1", 3000, "++", "UU")
    assert pick("3unique", parts) == ("chr1", 200, "chr1", 8000, "++", "UU")
    # a molecule of three parts whose inner part is placed nowhere is rescued without further tests
    assert pick("5unique", [line("h", 65, "chr1", 10, "25M25S", 0), *FAR[1:]]) == ("!", 0, "chr1", 200, "-+", "MR")


def test_walks_in_full(frame):
    assert parsed(frame, FAR, WalkOptions(policy="all")) == [
        ("h", "chr1", 10, "chr1", 5300, "++", "UU", 1, "R1"), ("h", "chr1", 200, "chr1", 5324, "+-", "UU", 2, "R1-2"),
    ]
    # the right read goes through the same junction as the left one
    both = [line("k", 65, "chr1", 10, "25M25S"), line("k", 2113, "chr2", 300, "25S25M"), line("k", 145, "chr2", 300, "25S25M"), line("k", 2193, "chr1", 10, "25M25S")]
    out = parsed(frame, both, WalkOptions(parse2=True, max_size=500), flip=True)
    assert [(x[-1], x[-2]) for x in out] == [("R1&2", 1)] and out[0][1:5] == ("chr1", 10, "chr2", 324)


def test_single_end_and_expansion(frame):
    lines = [line("s", 0, "chr1", 10, "20M60S"), line("s", 2048, "chr1", 300, "20S20M40S"), line("s", 2048, "chr2", 700, "40S40M")]
    o = WalkOptions(parse2=True, max_size=500, single_end=True, expand=True)
    assert parsed(frame, lines, o) == [
        ("s", "chr1", 10, "chr1", 319, "+-", "UU", 1, "R1"), ("s", "chr1", 10, "chr2", 739, "+-", "UU", 1, "E1_R1"), ("s", "chr1", 300, "chr2", 739, "+-", "UU", 2, "R1"),
    ]
    limited = WalkOptions(parse2=True, single_end=True, expand=True, max_depth=0)
    assert len(parsed(frame, lines, limited)) == 2


def test_columns_sam_and_read_names(frame):
    lines = [line("a", 65, "chr1", 10, "5S45M", 60, "NM:i:2", "MD:Z:45"), line("a", 129, "chr1", 200, "50M", 50, "SA:Z:x")]
    df = frame([(x, i) for i, x in enumerate(lines)], "value string, _ord long")
    r = parse_sam(df, CHROMS, add_columns=["mapq", "NM", "cigar", "dist_to_5", "read_len", "mismatches"], readid_transform='readID + "_x"').first()
    assert (r.readID, r.mapq1, r.mapq2, r.NM1, r.NM2, r.cigar1, r.dist_to_51, r.read_len2) == ("a_x", 60, 50, "2", "", "5S45M", 5, 50)
    assert r.sam1 == lines[0].replace("\t", "\x19") + "\x19Yt:Z:UU" and r.mismatches1 == ""
    dropped = parse_sam(df, CHROMS, drop_seq=True, drop_readid=True).first()
    assert dropped.readID == "." and "ACGT" not in dropped.sam1
    with pytest.raises(ValueError):
        parse_sam(df, CHROMS, add_columns=["nonsense"])
    end = parse_sam(df, CHROMS, report_end="3").first()
    assert (end.pos1, end.pos2) == (54, 249)


def test_mismatch_positions():
    assert mismatches("ACGTA", "IIIII", [(2, "S"), (3, "M")], "1C1", 10) == "C:T:40:10:3"
    assert mismatches("ACGTA", "IIIII", [(2, "M"), (1, "D"), (2, "M"), (1, "I")], "0G1^T2", 1) == "G:A:40:0:0"
    assert mismatches("ACG", "*", [(3, "M")], "2T0", 1) == "T:G:-1:2:2"


def test_gaps_become_unmapped_parts(frame):
    a = lambda at, n=20: Alignment(is_mapped=True, is_unique=True, dist_to_5=at, algn_read_span=n, read_len=200)
    out = fill_gaps([a(30), a(100)], 20)
    assert [x.is_mapped for x in out] == [False, True, True]  # after one gap the last part is not examined
    assert [x.is_mapped for x in fill_gaps([a(0), a(60)], 20)] == [True, False, True]
    assert fill_gaps([Alignment()], 20)[0].type == "N"
    n = all_alignments(frame([(x, i) for i, x in enumerate(GAP)], "value string, _ord long")).filter("side = 1").count()
    assert n == 2


def test_overlaps_need_all_their_junctions():
    rng = random.Random(1)
    def part(c, p, strand):
        return Alignment(chrom=c, pos5=p, pos3=p + (20 if strand == "+" else -20), strand=strand, is_mapped=True, is_unique=True)
    left = [part("chr1", rng.randrange(1000), "+") for _ in range(4)]
    mirror = lambda a: Alignment(chrom=a.chrom, pos5=a.pos3, pos3=a.pos5, strand="-", is_mapped=True, is_unique=True)
    right = [part("chr2", 5, "+")] + [mirror(a) for a in left[::-1][:3]]
    assert overlap_length(left, right, 3) == 2
    assert overlap_length(left, right[:2], 3) == 0 and overlap_length(left[:1], right, 3) == 0


def test_empty_input(frame):
    assert parsed(frame, []) == []
