"""Contacts from SAM lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions.predicates import compile_value
from contactloom.operators.rowwise import chrom_rank
from contactloom.operators.walks import TURNED, Alignment, WalkOptions, mismatches, molecule_contacts
from contactloom.runtime import Scratch, ship
from contactloom.schema import EXTRA_COLUMNS, SAM_ENTRY_SEP, SAM_SEP, UNMAPPED_CHROM
from contactloom.sources.sam import sam_table, tag

_TEXT = {"chrom", "strand", "type", "cigar", "mismatches", "seq"}
_TRUTH = {"is_mapped", "is_unique", "is_linear"}
_LONG = {"pos5", "pos3"}


def _field_type(name: str) -> T.DataType:
    if name == "tags":
        return T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
    return T.StringType() if name in _TEXT else T.BooleanType() if name in _TRUTH else T.LongType() if name in _LONG else T.IntegerType()


ALIGNMENT = T.StructType([T.StructField(f.name, _field_type(f.name)) for f in fields(Alignment)])
CONTACT = [
    T.StructField("a1", ALIGNMENT), T.StructField("a2", ALIGNMENT),
    T.StructField("walk_pair_index", T.IntegerType()), T.StructField("walk_pair_type", T.StringType()),
]


def cigar_spans(cigar: Column) -> Column:
    """struct(matched_bp, algn_ref_span, algn_read_span, read_len, clip5, clip3) of a CIGAR. Of M, I, D,
    S and H; other operations count for nothing. A clip before the first match is at the start."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDSH])"), F.lit(1))
    zero = {k: F.lit(0).alias(k) for k in ("matched_bp", "algn_ref_span", "algn_read_span", "read_len", "clip5", "clip3")}

    def step(acc: Column, x: Column) -> Column:
        op, n = F.right(x, F.lit(1)), F.left(x, F.length(x) - 1).cast("int")
        add = lambda k, which: (acc[k] + F.when(op.isin(*which), n).otherwise(0)).alias(k)
        clip = op.isin("S", "H")
        return F.struct(
            add("matched_bp", "M"), add("algn_ref_span", "MD"), add("algn_read_span", "MI"), add("read_len", "MISH"),
            F.when(clip & (acc["matched_bp"] == 0), n).otherwise(acc["clip5"]).alias("clip5"),
            F.when(clip & (acc["matched_bp"] > 0), n).otherwise(acc["clip3"]).alias("clip3"),
        )

    return F.aggregate(ops, F.struct(*zero.values()), step)


def alignments(sam: DataFrame, min_mapq: int = 1, tags: Sequence[str] = (), with_seq: bool = False, with_mismatches: bool = False) -> DataFrame:
    """sam (see sam_table) with algn, a struct for each line, by column expressions. A line without the
    flag for unmapped is mapped, and unique if its mapping quality is at least min_mapq; other
    alignments have no position."""
    # each step is a projection of its own, so that the generated methods stay small enough to be compiled
    sam = sam.withColumns(
        {
            "_c": cigar_spans(F.col("cigar")), "_mapped": F.col("flag").bitwiseAND(4) == 0,
            "_unique": F.col("mapq") >= min_mapq, "_plus": F.col("flag").bitwiseAND(16) == 0,
        }
    ).withColumn("_placed", F.col("_mapped") & F.col("_unique"))
    mapped, unique, placed, plus, c = (F.col(x) for x in ("_mapped", "_unique", "_placed", "_plus", "_c"))
    low, high = F.col("pos"), F.col("pos") - 1 + c["algn_ref_span"]
    end = lambda a, b: F.when(placed, F.when(plus, a).otherwise(b)).otherwise(0).cast("long")
    clip = lambda a, b: F.when(mapped, F.when(plus, c[a]).otherwise(c[b])).otherwise(0)
    differences = F.lit("")
    if with_mismatches:
        ship(sam.sparkSession)
        differences = F.when(placed, _mismatch_udf()("seq", "qual", "cigar", tag(F.col("tags"), "MD"), "pos")).otherwise("")
    values = {
        "chrom": F.when(placed, F.col("rname")).otherwise(UNMAPPED_CHROM), "pos5": end(low, high), "pos3": end(high, low),
        "strand": F.when(placed & plus, "+").otherwise("-"), "mapq": F.col("mapq"), "is_mapped": mapped, "is_unique": unique,
        "is_linear": ~F.exists("tags", lambda t: t.startswith("SA:")),
        "type": F.when(~mapped, "N").when(~unique, "M").otherwise("U"), "cigar": F.col("cigar"),
        "dist_to_5": clip("clip5", "clip3"), "dist_to_3": clip("clip3", "clip5"),
        **{k: c[k] for k in ("algn_ref_span", "algn_read_span", "matched_bp", "read_len")},
        "mismatches": differences, "seq": F.col("seq") if with_seq else F.lit(""),
        "tags": F.array(*[F.struct(F.lit(t).alias("name"), tag(F.col("tags"), t).alias("value")) for t in tags]),
        "read_side": F.lit(0), "algn_idx": F.lit(0), "same_side_algn_count": F.lit(0),
    }
    parts = [values[f.name].cast(f.dataType).alias(f.name) for f in ALIGNMENT.fields]
    # a zero in front instead of a cast that fails, which would cost an exception for each line
    soft = F.concat(F.lit("0"), F.regexp_extract("cigar", r"\A(?:\d+H)?(\d+)S", 1)).cast("int")
    return sam.withColumns({"algn": F.struct(*parts), "_start": soft}).drop("_c", "_mapped", "_unique", "_plus", "_placed")


def _mismatch_udf():
    import re

    @F.pandas_udf(T.StringType())
    def run(seq: pd.Series, qual: pd.Series, cigar: pd.Series, md: pd.Series, pos: pd.Series) -> pd.Series:
        out = []
        for s, q, c, m, p in zip(seq, qual, cigar, md, pos):
            ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", c or "")]
            out.append(mismatches(s, q, ops, m, int(p)) if m and s not in (None, "", "*") else "")
        return pd.Series(out, dtype=object)

    return run


def molecules(algns: DataFrame, readid_transform: str | None = None) -> DataFrame:
    """(readID, molecule, side1, side2, sams1, sams2, all1): the alignments of each read name, those of
    the first read by flag and all others, in the order of their start in the read. Lines of one name
    belong together wherever they stand; molecule is the place of the first of them. Lines without a name
    ('*', '.' or nothing) tell nothing of each other, so each is a molecule of its own."""
    name, nameless = F.col("qname"), F.coalesce(F.col("qname"), F.lit("")).isin("*", ".", "")
    if readid_transform is not None:
        algns = algns.withColumn("readID", F.col("qname"))
        name = compile_value(readid_transform, ["readID"]).cast("string")
    order = F.struct((F.col("flag").bitwiseAND(128) != 0).alias("second"), F.col("_start").alias("start"), F.col("_ord").alias("ord"),
                     (F.col("flag").bitwiseAND(64) != 0).alias("first"), "algn", "sam")
    read = algns.groupBy(name.alias("readID"), F.when(nameless, F.col("_ord")).alias("_alone")).agg(F.min("_ord").alias("molecule"), F.sort_array(F.collect_list(order)).alias("all"))
    first, other = F.filter("all", lambda x: x["first"]), F.filter("all", lambda x: ~x["first"])
    pick = lambda a, k: F.transform(a, lambda x: x[k])
    return read.select(
        "readID", "molecule", pick(first, "algn").alias("side1"), pick(other, "algn").alias("side2"),
        pick(first, "sam").alias("sams1"), pick(other, "sam").alias("sams2"),
    )


def _walk_batches(options: WalkOptions):
    """Batches of molecules to batches of contacts; a molecule's other columns are taken along, once for
    each of its contacts."""
    names = [f.name for f in ALIGNMENT.fields]

    def given(algns: list[dict]) -> list[Alignment]:
        return [Alignment(**{**a, "tags": {t["name"]: t["value"] for t in a["tags"]}}) for a in algns]

    def column(algns: list[Alignment], kind: pa.StructType) -> pa.Array:
        values = {n: [getattr(a, n) for a in algns] for n in names}
        values["tags"] = [[{"name": k, "value": v} for k, v in t.items()] for t in values["tags"]]
        return pa.StructArray.from_arrays([pa.array(values[f.name], f.type) for f in kind], fields=list(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _arrow()
        for batch in batches:
            found, at = [], []
            for n, (s1, s2) in enumerate(zip(batch.column("side1").to_pylist(), batch.column("side2").to_pylist())):
                contacts = molecule_contacts(given(s1), given(s2), options)[0]
                found += contacts
                at += [n] * len(contacts)
            taken = pa.Table.from_batches([batch]).drop_columns(["side1", "side2"]).take(pa.array(at, pa.int64()))
            taken = taken.append_column("a1", column([c.left for c in found], kind)).append_column("a2", column([c.right for c in found], kind))
            taken = taken.append_column("walk_pair_index", pa.array([c.index for c in found], pa.int32()))
            yield from taken.append_column("walk_pair_type", pa.array([c.kind for c in found], pa.string())).combine_chunks().to_batches()

    return run


def _arrow() -> pa.DataType:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}
    tags = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    return pa.struct([(f.name, tags if f.name == "tags" else kinds[f.dataType.simpleString()]) for f in ALIGNMENT.fields])


def _turned(algn: Column, flip_strand: bool, flip_ends: bool) -> Column:
    out = algn
    if flip_strand:
        out = out.withField("strand", F.when(algn["strand"] == "-", "+").otherwise("-"))
    if flip_ends:
        out = out.withField("pos5", algn["pos3"]).withField("pos3", algn["pos5"])
    return out


def contacts(reads: DataFrame, options: WalkOptions) -> DataFrame:
    """reads with a1, a2, walk_pair_index and walk_pair_type for each contact of a molecule.

    Molecules with one alignment on each side and no gap before it, the bulk of a library, are parsed
    by column expressions; the others go through Arrow batches to the walk parser. The molecules are
    written, as both kinds are picked from them and grouping reads shuffles all lines."""
    ship(reads.sparkSession)
    reads = Scratch(reads.sparkSession, "molecules").write(reads)
    gap = options.max_gap
    one = (F.size("side1") == 1) & (F.size("side2") == 1)
    for side in ("side1", "side2"):
        a = F.get(side, F.lit(0))
        if gap is not None:
            one = one & (~a["is_mapped"] | (a["dist_to_5"] <= gap))
    simple = F.lit(False) if options.single_end else F.coalesce(one, F.lit(False))
    out = {}
    for i in (1, 2):
        a = F.get(f"side{i}", F.lit(0)).withField("read_side", F.lit(i)).withField("same_side_algn_count", F.lit(1))
        if options.parse2:
            a = _turned(a, i in TURNED[options.orientation]["R1-2"], i in TURNED[options.position]["R1-2"])
        out[f"a{i}"] = F.struct(*[a[f.name].cast(f.dataType).alias(f.name) for f in ALIGNMENT.fields])
    index = {"walk_pair_index": F.lit(1), "walk_pair_type": F.lit("R1-2")}
    plain = reads.filter(simple).withColumns({**out, **index}).drop("side1", "side2")
    others = reads.filter(~simple)
    kept = [f for f in reads.schema.fields if f.name not in ("side1", "side2")]
    walks = others.mapInArrow(_walk_batches(options), T.StructType([*kept, *CONTACT]))
    return plain.unionByName(walks)


def parse_sam(
    lines: DataFrame, chroms: Sequence[str], options: WalkOptions | None = None, min_mapq: int = 1, flip: bool | None = None,
    add_columns: Sequence[str] = (), add_pair_index: bool = False, drop_readid: bool = False, drop_seq: bool = False,
    drop_sam: bool = False, report_end: str = "5", readid_transform: str | None = None, line: str = "value",
) -> DataFrame:
    """Pairs (or, unless drop_sam, a pairsam table) from SAM lines (value, _ord).

    chroms is the order of chromosomes that sides are flipped to. flip: by default on for parse and
    off for parse2. add_columns: names of alignment fields, mismatches, seq, or two-letter tags, each
    reported for both sides. Repeated lines are alignments of their own; empty input gives no row."""
    options = options or WalkOptions()
    flip = (not options.parse2) if flip is None else flip
    known = {f.name for f in ALIGNMENT.fields} | set(EXTRA_COLUMNS)
    tags = [c for c in add_columns if len(c) == 2 and c.isupper()]
    if unknown := [c for c in add_columns if c not in tags and c not in known]:
        raise ValueError(f"unknown columns {unknown}")
    sam = sam_table(lines, line)
    algns = alignments(sam, min_mapq, tags, "seq" in add_columns, "mismatches" in add_columns)
    if drop_sam:
        algns = algns.withColumn("sam", F.lit(""))
    elif drop_seq:
        cells = F.split("sam", "\t", -1)
        algns = algns.withColumn("sam", F.array_join(F.transform(cells, lambda x, i: F.when(i.isin(9, 10), F.lit("*")).otherwise(x)), "\t"))
    reads = molecules(algns, readid_transform)
    found = contacts(reads.drop("sams1", "sams2") if drop_sam else reads, options)
    pos = "pos5" if report_end == "5" else "pos3"
    a, b = F.col("a1"), F.col("a2")
    if flip:
        order = [UNMAPPED_CHROM, *chroms]
        by_mapping = lambda x: F.struct(x["is_mapped"].cast("int"), x["is_unique"].cast("int"))
        by_place = lambda x: F.struct(chrom_rank(order, x["chrom"]), x[pos])
        both = (a["chrom"] != UNMAPPED_CHROM) & (b["chrom"] != UNMAPPED_CHROM)
        wrong = F.when(both, by_place(a) > by_place(b)).otherwise(by_mapping(a) > by_mapping(b))
        found = found.withColumn("_w", F.coalesce(wrong, F.lit(False)))
        turn = lambda x, y: {x: F.when(F.col("_w"), F.col(y)).otherwise(F.col(x)), y: F.when(F.col("_w"), F.col(x)).otherwise(F.col(y))}
        found = found.withColumns({**turn("a1", "a2"), **({} if drop_sam else turn("sams1", "sams2"))})
    kind = F.concat(a["type"], b["type"])
    out = {
        "readID": F.lit(".") if drop_readid else F.col("readID"), "chrom1": a["chrom"], "pos1": a[pos], "chrom2": b["chrom"], "pos2": b[pos],
        "strand1": a["strand"], "strand2": b["strand"], "pair_type": kind,
    }
    if not drop_sam:
        for i in (1, 2):
            entry = lambda s: F.concat(F.translate(s, "\t", SAM_SEP), F.lit(f"{SAM_SEP}Yt:Z:"), kind)
            out[f"sam{i}"] = F.array_join(F.transform(F.col(f"sams{i}"), entry), SAM_ENTRY_SEP)
    if add_pair_index:
        out |= {"walk_pair_index": F.col("walk_pair_index"), "walk_pair_type": F.col("walk_pair_type")}
    for c in add_columns:
        for i, x in ((1, a), (2, b)):
            out[f"{c}{i}"] = _own_tag(x, c) if c in tags else x[c]
    return found.select(*[v.alias(k) for k, v in out.items()], F.col("molecule").alias("_ord"))


def _own_tag(algn: Column, name: str) -> Column:
    found = F.filter(algn["tags"], lambda t: t["name"] == name)
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


REPORTED = {
    "chrom": pa.string(), "pos5": pa.int64(), "strand": pa.string(), "mapq": pa.int32(), "cigar": pa.string(), "dist_to_5": pa.int32(),
    "algn_read_span": pa.int32(), "matched_bp": pa.int32(),
}


def _sides(lines: DataFrame, options: WalkOptions, min_mapq: int, cells, schema: pa.Schema, kinds: str) -> DataFrame:
    """Rows that cells (read name, side, alignments) gives of both sides of each molecule."""
    ship(lines.sparkSession)
    reads = molecules(alignments(sam_table(lines), min_mapq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, *sides in zip(*(batch.column(i).to_pylist() for i in range(3))):
                given = ([Alignment(**{**a, "tags": {}}) for a in s] for s in sides)
                for side, algns in enumerate(molecule_contacts(*given, options)[1:], 1):
                    rows += cells(name, side, algns)
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return reads.select("readID", "side1", "side2").mapInArrow(run, kinds)


def all_alignments(lines: DataFrame, options: WalkOptions | None = None, min_mapq: int = 1) -> DataFrame:
    """(readID, side, idx, and what describes it) for each alignment of each molecule, before contacts are
    made of them."""
    names = list(REPORTED)
    schema = pa.schema([("readID", pa.string()), ("side", pa.int32()), ("idx", pa.int32()), *REPORTED.items()])
    cells = lambda name, side, algns: [(name, side, i, *(getattr(a, n) for n in names)) for i, a in enumerate(algns)]
    kinds = "readID string, side int, idx int, chrom string, pos5 long, strand string, mapq int, cigar string, dist_to_5 int, algn_read_span int, matched_bp int"
    return _sides(lines, options or WalkOptions(), min_mapq, cells, schema, kinds).withColumn("read_end", F.col("dist_to_5") + F.col("algn_read_span"))


def alignment_lines(lines: DataFrame, options: WalkOptions | None = None, min_mapq: int = 1) -> DataFrame:
    """(value): a line of text for each side of each molecule: its read name, the side, and of each
    alignment in read order chrom, pos5, strand, mapq, cigar, start and end in the read, and matched bases,
    every field followed by a tab."""

    def cells(name: str, side: int, algns: list[Alignment]) -> list[tuple[str]]:
        fields = [name, side]
        for a in sorted(algns, key=lambda a: a.dist_to_5):
            fields += [a.chrom, a.pos5, a.strand, a.mapq, a.cigar, a.dist_to_5, a.dist_to_5 + a.algn_read_span, a.matched_bp]
        return [("".join(f"{x}\t" for x in fields),)]

    return _sides(lines, options or WalkOptions(), min_mapq, cells, pa.schema([("value", pa.string())]), "value string")
