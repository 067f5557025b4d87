"""SQL for the walks of the molecules that derive.sam_lines(chimeric=True) makes of the pairs table.

Read 1 of every fourth molecule with both sides mapped has two parts of 25 bases: a at the first side and b
300 bases beyond the second; read 2 is c at the second side. Which part comes first in the read, and
whether a gap comes before both, depends on the strands."""

from __future__ import annotations


def _part(chrom: str, start: str, strand: str, quality: str, mapped: str, span: str, extra: str) -> str:
    """A struct of an alignment: place, ends, strand, type, and what tells its mapping."""
    plus = f"{strand} = '+'"
    placed = f"({mapped} AND {quality} >= 1)"
    low, high = f"({start})", f"({start} + {span} - 1)"
    end = lambda a, b: f"CASE WHEN {placed} THEN CASE WHEN {plus} THEN {a} ELSE {b} END ELSE 0 END"
    return f"""{{'c': CASE WHEN {placed} THEN {chrom} ELSE '!' END, 'p5': {end(low, high)}, 'p3': {end(high, low)},
  's': CASE WHEN {placed} AND {plus} THEN '+' ELSE '-' END, 't': CASE WHEN NOT {mapped} THEN 'N' WHEN {quality} < 1 THEN 'M' ELSE 'U' END,
  'pl': {placed}, 'mp': {mapped}, 'un': CASE WHEN {mapped} THEN {quality} >= 1 ELSE false END, {extra}}}"""


def _start(pos: str, strand: str) -> str:
    return f"CASE WHEN {strand} = '-' THEN greatest({pos} - 49, 1) ELSE {pos} END"


def _told(quality: str, cigar: str, from5: str, span: str) -> str:
    return f"'mq': ({quality})::INT, 'cg': {cigar}, 'd5': ({from5})::INT, 'sp': ({span})::INT"


MOLECULES = f"""
x AS (SELECT pair_no, pos1, pos2, chrom1, chrom2, strand1, strand2, CASE WHEN chrom1 = '!' THEN 0 ELSE coalesce(mapq1, 60) END AS q1,
        CASE WHEN chrom2 = '!' THEN 0 ELSE coalesce(mapq2, 60) END AS q2, pair_no % 4 = 0 AND chrom1 <> '!' AND chrom2 <> '!' AS part FROM pairs),
y AS (SELECT *, {_part("chrom1", _start("pos1", "strand1"), "strand1", "q1", "(chrom1 <> '!')", "CASE WHEN part THEN 25 ELSE 50 END",
        _told("q1", "CASE WHEN chrom1 = '!' THEN '*' WHEN part THEN '25M25S' ELSE '50M' END", "CASE WHEN part AND strand1 = '-' THEN 25 ELSE 0 END",
              "CASE WHEN chrom1 = '!' THEN 0 WHEN part THEN 25 ELSE 50 END"))} AS a,
      {_part("chrom2", _start("pos2 + 300", "strand2"), "strand2", "q2", "(chrom2 <> '!')", "25",
        _told("q2", "'25S25M'", "CASE WHEN strand2 = '-' THEN 0 ELSE 25 END", "25"))} AS b,
      {_part("chrom2", _start("pos2", "strand2"), "strand2", "q2", "(chrom2 <> '!')", "50",
        _told("q2", "CASE WHEN chrom2 = '!' THEN '*' ELSE '50M' END", "0", "CASE WHEN chrom2 = '!' THEN 0 ELSE 50 END"))} AS c,
      {{'c': '!', 'p5': 0, 'p3': 0, 's': '-', 't': 'N', 'pl': false, 'mp': false, 'un': false, 'mq': 0, 'cg': '*', 'd5': 0, 'sp': 25}} AS g FROM x),
z AS (SELECT pair_no, part, c, q1, q2, strand1, CASE WHEN NOT part THEN [a] WHEN strand1 <> '-' THEN [a, b] WHEN strand2 <> '-' THEN [g, a, b] ELSE [b, a] END AS l FROM y)
"""


def _reported(flip: bool, contacts: str) -> str:
    """contacts (pair_no, u, v, i, kind): of both sides c, p, s, t, mp and un; as rows of pairs."""
    wrong = """CASE WHEN u.c <> '!' AND v.c <> '!' THEN ru > rv OR (ru = rv AND u.p > v.p)
  ELSE u.mp::INT > v.mp::INT OR (u.mp = v.mp AND u.un::INT > v.un::INT) END"""
    out = []
    for n, (own, other) in ((1, ("u", "v")), (2, ("v", "u"))):
        out += [f"CASE WHEN w THEN {other}.{f} ELSE {own}.{f} END AS {name}{n}" for f, name in (("c", "chrom"), ("p", "pos"), ("s", "strand"))]
    return f"""{contacts},
o AS (SELECT k.*, a.chrom_rank AS ru, b.chrom_rank AS rv FROM k LEFT JOIN chromsizes a ON u.c = a.chrom LEFT JOIN chromsizes b ON v.c = b.chrom),
e AS (SELECT *, {wrong if flip else 'false'} AS w FROM o)
SELECT 'q' || pair_no AS "readID", {", ".join(out)}, CASE WHEN w THEN v.t || u.t ELSE u.t || v.t END AS pair_type,
  i::INT AS walk_pair_index, kind AS walk_pair_type FROM e"""


def _side(of: str, turned: bool, pos: str | None = None) -> str:
    strand = f"CASE {of}.s WHEN '-' THEN '+' ELSE '-' END" if turned else f"{of}.s"
    return f"{{'c': {of}.c, 'p': {pos or (f'{of}.p3' if turned else f'{of}.p5')}, 's': {strand}, 't': {of}.t, 'mp': {of}.mp, 'un': {of}.un}}"


def one_contact(policy: str) -> str:
    """The policies that report one contact of a molecule."""
    ends = {"5any": "l[1]", "3any": "l[len(l)]", "mask": "l[1]"}
    placed = "list_filter(l, lambda q : q.pl)"
    ends |= {"5unique": f"coalesce({placed}[1], l[1])", "3unique": f"coalesce({placed}[len({placed})], l[len(l)])"}
    masked = "{'c': '!', 'p': 0, 's': '-', 't': 'W', 'mp': true, 'un': true}"
    free = (masked, masked) if policy == "mask" else (_side("f", False), _side("c", False))
    linear = "{'c': c.c, 'p': c.p5, 's': c.s, 't': 'R', 'mp': c.mp, 'un': c.un}"
    u = f"CASE WHEN rescued OR NOT part THEN {_side('h', False)} ELSE {free[0]} END"
    v = f"CASE WHEN rescued THEN {linear} WHEN NOT part THEN {_side('c', False)} ELSE {free[1]} END"
    # b never faces c, so a molecule is rescued only where a, standing first, is not unique
    rescued = "part AND strand1 <> '-' AND q1 < 1 AND q2 >= 1"
    return "WITH " + _reported(True, f"""{MOLECULES},
r AS (SELECT *, {rescued} AS rescued, l[1] AS h, {ends[policy]} AS f FROM z),
k AS (SELECT pair_no, {u} AS u, {v} AS v, 1 AS i, CASE WHEN rescued THEN 'R1' ELSE 'R1-2' END AS kind FROM r)""")


def all_contacts(max_size: int, flip: bool, turned: dict[str, tuple[int, ...]], expand: bool = False) -> str:
    """Every contact along a molecule. turned: which sides are reported from their other end, by kind."""
    meet = f"""CASE WHEN NOT f.pl OR NOT c.pl THEN NOT f.pl AND NOT c.pl WHEN f.c <> c.c OR f.s = c.s THEN false
  ELSE greatest(turn * (f.p3 - f.p5), turn * (c.p5 - c.p3)) - 3 <= turn * (c.p5 - f.p5) AND turn * (c.p5 - f.p5) <= {max_size} + 3 END"""
    last = f"CASE WHEN j = n - 1 AND meet THEN c.p5 ELSE y.{'p3' if 2 in turned['R1'] else 'p5'} END" if 2 in turned["R1"] else "y.p5"
    r1 = (_side("h", 1 in turned["R1"]), _side("y", 2 in turned["R1"], last))
    between = (_side("h", 1 in turned["R1-2"]), _side("c", 2 in turned["R1-2"]))
    base = f"""{MOLECULES},
m AS (SELECT *, len(l) AS n, l[len(l)] AS f, CASE l[len(l)].s WHEN '+' THEN 1 ELSE -1 END AS turn FROM z),
d AS (SELECT *, {meet} AS meet FROM m),
t AS (SELECT *, l[j] AS h, l[j + 1] AS y FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM d) WHERE j < n OR n = 1 OR NOT meet),
k0 AS (SELECT pair_no, CASE WHEN j < n THEN {r1[0]} ELSE {between[0]} END AS u, CASE WHEN j < n THEN {r1[1]} ELSE {between[1]} END AS v, j AS i,
  CASE WHEN j < n THEN 'R1' ELSE 'R1-2' END AS kind FROM t)"""
    more = """, k AS (SELECT * FROM k0 UNION ALL SELECT p.pair_no, p.u, q.v, p.i, 'E' || (q.i - p.i) || '_' || q.kind
  FROM k0 p JOIN k0 q ON p.pair_no = q.pair_no AND p.i < q.i)"""
    return "WITH " + _reported(flip, base + (more if expand else ", k AS (SELECT * FROM k0)"))


ALIGNMENTS = f"""WITH {MOLECULES}, s AS (SELECT pair_no, 1 AS side, l FROM z UNION ALL SELECT pair_no, 2, [c] FROM z),
u AS (SELECT pair_no, side, unnest(l) AS a, unnest(range(0, len(l))) AS idx FROM s)
SELECT 'q' || pair_no AS "readID", side::INT AS side, idx::INT AS idx, a.c AS chrom, a.p5::BIGINT AS pos5, a.s AS strand, a.mq AS mapq, a.cg AS cigar,
  a.d5 AS dist_to_5, a.sp AS algn_read_span, CASE WHEN a.cg = '*' THEN 0 ELSE a.sp END::INT AS matched_bp, (a.d5 + a.sp)::INT AS read_end FROM u
"""
