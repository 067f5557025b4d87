"""Command line: python -m contactloom COMMAND ... on pairs, pairsam and SAM files.

Paths are anything Spark reads. Without a path, or with '-', rows come from standard input and go to
standard output; an output path with a suffix of a pairs or text file is one file, any other a folder of
part files. --cmd-in and --cmd-out name programs that inputs and outputs go through. Options that tune
processes, memory or temporary folders of single-machine tools have no counterpart; Spark's own settings
take their place."""

from __future__ import annotations

import argparse
import cProfile
import logging
import pdb
import shlex
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import header as header_module
from contactloom.header import PairsHeader
from contactloom.operators import coverage, intervals, order, rowwise, scaling, stats
from contactloom.operators.dedup import Dedup
from contactloom.operators.parse import alignment_lines, parse_sam
from contactloom.operators.walks import ORIENTATIONS, POLICIES, POSITIONS, WalkOptions
from contactloom.schema import PAIRS_COLUMNS, PAIRSAM_COLUMNS, UPPER_TRIANGLE, WHOLE_MATRIX
from contactloom.sources import pairs_text, sam, stats_text, streams
from contactloom.table import PairsTable

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, *options: tuple):
    """Registers a command. options: (flags, keyword arguments of add_argument)."""

    def add(run):
        def fill(parser: argparse.ArgumentParser) -> None:
            for flags, kw in options:
                parser.add_argument(*flags.split(), **kw)

        COMMANDS[name] = (fill, run)
        return run

    return add


PATH, OUT = ("pairs_path", {"nargs": "?", "default": "-"}), ("-o --output", {"default": "-"})
PATHS = ("pairs_path", {"nargs": "*", "default": ["-"]})
PIPES: dict[str, str | None] = {"in": None, "out": None}
FILTERS = [
    ("--filter", {"action": "append", "default": []}), ("--chrom-subset", {}), ("--startup-code", {}), ("--python", {"action": "store_true"}),
    ("-t --type-cast", {"nargs": 2, "action": "append", "default": []}),
]
BYTILE = ("--bytile-dups", {"action": argparse.BooleanOptionalAction, "default": False})
NAMED = [(f"--{k}", {"default": v}) for k, v in zip(("c1", "p1", "c2", "p2", "s1", "s2"), PAIRS_COLUMNS[1:7])]


def _input(spark: SparkSession, path: str) -> str:
    """A path that Spark can read: standard input and what a program unpacks are put into the shared folder."""
    return streams.stage(spark, path, PIPES["in"]) if path in ("", "-") or PIPES["in"] else path


def _read(spark: SparkSession, path: str, casts: Sequence = ()) -> PairsTable:
    kinds = {"int": "bigint", "float": "double", "str": "string"}
    return pairs_text.read_pairs(spark, _input(spark, path), {c: kinds.get(t, t) for c, t in casts})


def _write(table: PairsTable, path: str, header: bool = True) -> None:
    """path: '-' is standard output; outputs that were not asked for have none."""
    if not path:
        return
    table = table if header else PairsTable(table.df, PairsHeader())
    single = path == "-" or path.endswith((".pairs", ".pairsam", ".txt", ".sam", ".gz", ".bz2", ".lz4")) or PIPES["out"] is not None
    pairs_text.write_pairs(table, path, single=single, command=PIPES["out"])


def _filters(a) -> dict[str, str]:
    return dict(f.split(":", 1) for f in a.filter)


def _options(spark: SparkSession, a) -> dict:
    subset = pairs_text.read_chrom_list(spark, a.chrom_subset) if a.chrom_subset else None
    if a.startup_code and not a.python:
        raise SystemExit("--startup-code runs the given code and needs --python")
    return {"casts": dict(a.type_cast), "chrom_subset": subset, "python": a.python, "startup": a.startup_code}


def _write_stats(df: DataFrame, a, spark: SparkSession, path: str, tiles: DataFrame | None = None) -> None:
    if path:
        o = _options(spark, a)
        subset = o.pop("chrom_subset")
        s = stats.PairStats(df, _filters(a), chrom_subset=subset, **o).once()
        stats_text.write_stats(s.long(), path, a.yaml, stats.full_summary(s, tiles))


@command("select", ("condition", {}), PATH, OUT, ("--output-rest", {"default": ""}), ("-r --remove-columns", {"default": ""}), *FILTERS[1:])
def select(spark, a):
    t, o = _read(spark, a.pairs_path, a.type_cast), _options(spark, a)
    gone = [c for c in a.remove_columns.split(",") if c]
    header = t.header.without_columns(gone) if gone else t.header
    header = header.subset_chroms(o["chrom_subset"]) if o["chrom_subset"] else header
    for f, path in ((rowwise.select, a.output), (rowwise.select_rest, a.output_rest)):
        df = f(t.df, a.condition, gone, **o)
        _write(PairsTable(df.drop("_width") if gone else df, header.add_program("select")), path)


@command("flip", PATH, OUT, ("-c --chroms-path", {"required": True}))
def flip(spark, a):
    t = _read(spark, a.pairs_path)
    out = rowwise.flip(t.df, pairs_text.read_chrom_list(spark, a.chroms_path))
    _write(PairsTable(out, t.header.with_field("shape", UPPER_TRIANGLE).add_program("flip")), a.output)


@command("sort", PATH, OUT, *NAMED[:4], ("--pt", {"default": "pair_type"}), ("--extra-col", {"action": "append", "default": []}))
def sort(spark, a):
    t = order.sort_table(_read(spark, a.pairs_path), [a.c1, a.c2, a.p1, a.p2, a.pt], a.extra_col)
    _write(PairsTable(t.df, t.header.add_program("sort")), a.output)


@command("merge", PATHS, OUT, ("--keep-first-header", {"action": "store_true"}), ("--concatenate", {"action": "store_true"}))
def merge(spark, a):
    files = [f for p in a.pairs_path for f in (["-"] if p == "-" else pairs_text._files(spark, p))]
    t = order.merge_tables([_read(spark, f) for f in files], a.concatenate, a.keep_first_header)
    _write(t if len(files) == 1 else PairsTable(t.df, t.header.add_program("merge", force=True)), a.output)


@command("sample", ("fraction", {"type": float}), PATH, OUT, ("-s --seed", {"type": int}))
def sample(spark, a):
    _write(_read(spark, a.pairs_path).pipe(rowwise.sample, a.fraction, a.seed, program="sample"), a.output)


@command("markasdup", PATH, OUT)
def markasdup(spark, a):
    _write(_read(spark, a.pairs_path).pipe(rowwise.mark_as_dup, program="markasdup"), a.output)


@command("split", PATH, ("--output-pairs", {"default": ""}), ("--output-sam", {"default": ""}))
def split(spark, a):
    t = _read(spark, a.pairs_path)
    header = t.header.add_program("split")
    _write(PairsTable(rowwise.split_pairs(t.df).drop("_width"), header.without_columns(["sam1", "sam2"])), a.output_pairs)
    if a.output_sam:
        _write(PairsTable(rowwise.split_sam(t.df), PairsHeader(tuple(header.samheader()))), a.output_sam)


@command("restrict", PATH, OUT, ("-f --frags", {"required": True}))
def restrict(spark, a):
    t = _read(spark, a.pairs_path)
    _write(t.with_df(intervals.restrict(t.df.drop("_width"), pairs_text.read_bed(spark, a.frags)), "restrict"), a.output)


@command("phase", PATH, OUT, ("--phase-suffixes", {"nargs": 2, "required": True}), ("--clean-output", {"action": "store_true"}),
         ("--tag-mode", {"default": "XB", "choices": ["XB", "XA"]}), ("--report-scores", {"action": "store_true"}))
def phase(spark, a):
    t = _read(spark, a.pairs_path)
    _write(t.with_df(rowwise.phase(t.df.drop("_width"), a.phase_suffixes, a.tag_mode, a.report_scores, a.clean_output), "phase"), a.output)


@command("dedup", PATH, OUT, ("--output-dups", {"default": ""}), ("--output-unmapped", {"default": ""}), ("--output-stats", {"default": ""}),
         ("--output-bytile-stats", {"default": ""}), BYTILE, ("--max-mismatch", {"type": int, "default": 3}), ("--method", {"default": "max", "choices": ["max", "sum"]}),
         ("--backend", {"default": "transitive", "choices": ["transitive", "greedy"]}), ("--mark-dups", {"action": argparse.BooleanOptionalAction, "default": True}),
         ("--keep-parent-id", {"action": "store_true"}), ("--extra-col-pair", {"nargs": 2, "action": "append", "default": []}),
         ("--send-header-to", {"default": "both", "choices": ["dups", "dedup", "both", "none"]}), ("--unmapped-chrom", {"default": "!"}),
         ("--yaml", {"action": "store_true"}), *NAMED, *FILTERS)
def dedup(spark, a):
    t = _read(spark, a.pairs_path)
    columns = t.header.columns()
    name = lambda c: columns[int(c)] if c.isdigit() else c
    d = Dedup(t.df, a.max_mismatch, a.method, a.backend, extra_pairs=[(name(x), name(y)) for x, y in a.extra_col_pair],
              columns=[name(getattr(a, k)) for k in ("c1", "p1", "c2", "p2", "s1", "s2")], unmapped=a.unmapped_chrom)
    parts = d.split(a.mark_dups, a.keep_parent_id)
    header = t.header.add_program("dedup")
    sinks: dict[str, list[str]] = {}
    for part, path in (("dedup", a.output), ("dups", a.output_dups), ("unmapped", a.output_unmapped)):
        path = a.output if path == "-" else path  # '-' is where the kept pairs go
        if path:
            sinks.setdefault(path, []).append(part)
    for path, names in sinks.items():
        df = parts[names[0]]
        for n in names[1:]:
            df = df.unionByName(parts[n], allowMissingColumns=True)
        own = header.append_columns(["parent_readID"]) if "parent_readID" in df.columns else header
        # what is neither kept nor a duplicate always has its header
        shown = a.send_header_to == "both" or a.send_header_to in names or names == ["unmapped"]
        _write(PairsTable(df.drop("_width") if "parent_readID" in df.columns else df, own), path, shown)
    tiles = stats.tile_duplicates(d.marked().filter("duplicate")) if a.bytile_dups or a.output_bytile_stats else None
    if a.output_stats:
        rows = d.marked().unionByName(parts["unmapped"], allowMissingColumns=True)
        rows = rows.withColumn("pair_type", F.when(F.col("duplicate"), "DD").otherwise(F.col("pair_type"))) if a.mark_dups else rows
        _write_stats(rows, a, spark, a.output_stats, tiles)
    if a.output_bytile_stats:
        stats_text.write_tiles(tiles, a.output_bytile_stats)


@command("filterbycov", PATH, OUT, ("--output-highcov", {"default": ""}), ("--output-unmapped", {"default": ""}), ("--output-stats", {"default": ""}),
         ("--max-cov", {"type": int, "default": 8}), ("--max-dist", {"type": int, "default": 500}), ("--method", {"default": "max", "choices": ["max", "sum"]}),
         ("--mark-multi", {"action": "store_true"}), ("--send-header-to", {"default": "both", "choices": ["lowcov", "highcov", "both", "none"]}),
         ("--unmapped-chrom", {"default": "!"}), ("--yaml", {"action": "store_true"}), *NAMED, *FILTERS)
def filterbycov(spark, a):
    t = _read(spark, a.pairs_path)
    columns = t.header.columns()
    ends = [columns[int(c)] if c.isdigit() else c for c in (a.c1, a.p1, a.c2, a.p2)]
    parts = coverage.filter_by_coverage(t.df, a.max_cov, a.max_dist, a.method, a.mark_multi, columns=ends, unmapped=a.unmapped_chrom)
    header = t.header.add_program("filterbycov")
    for part, path in (("lowcov", a.output), ("highcov", a.output_highcov), ("unmapped", a.output_unmapped)):
        _write(PairsTable(parts[part], header), path, a.send_header_to in ("both", part) or part == "unmapped")
    every = parts["lowcov"].unionByName(parts["highcov"]).unionByName(parts["unmapped"])
    _write_stats(every, a, spark, a.output_stats)


@command("stats", PATHS, OUT, ("--merge", {"action": "store_true"}), ("--n-dist-bins-decade", {"type": int, "default": 8}), BYTILE,
         ("--with-chromsizes", {"action": argparse.BooleanOptionalAction, "default": True, "dest": "with_chromsizes"}),
         ("--no-chromsizes", {"action": "store_false", "dest": "with_chromsizes"}), ("--yaml", {"action": "store_true"}), ("--output-bytile-stats", {"default": ""}), *FILTERS)
def stats_command(spark, a):
    if a.merge:
        read = stats_text.read_stats_yaml if a.yaml else stats_text.read_stats
        merged = stats.merge_stats([read(spark, _input(spark, p)) for p in a.pairs_path])
        stats_text.write_stats(merged, a.output, a.yaml, stats.summaries(merged))
        return
    t, o = _read(spark, a.pairs_path[0], a.type_cast), _options(spark, a)
    subset = o.pop("chrom_subset")
    s = stats.PairStats(t.df, _filters(a), a.n_dist_bins_decade, subset, **o).once()
    asked = (a.bytile_dups or a.output_bytile_stats) and "parent_readID" in t.df.columns
    tiles = stats.tile_duplicates(t.df.filter("pair_type = 'DD'")) if asked else None
    more = stats.full_summary(s, tiles)
    if a.with_chromsizes:
        for values in more.values():
            values |= {f"{stats.CHROMSIZES}{c}": n for c, n in t.header.chromsizes().items()}
    stats_text.write_stats(s.long(), a.output, a.yaml, more)
    if tiles is not None and a.output_bytile_stats:
        stats_text.write_tiles(tiles, a.output_bytile_stats)


@command("scaling", PATHS, OUT, ("--view --regions", {"dest": "view"}), ("--dist-range", {"nargs": 2, "type": int, "default": [1, 10**9]}),
         ("--n-dist-bins-decade", {"type": int, "default": 8}), ("--header-chromsizes", {"action": "store_true"}))
def scaling_command(spark, a):
    tables = [_read(spark, p) for p in a.pairs_path]
    df = order.union_pairs([t.df for t in tables])
    sizes = None
    if a.header_chromsizes:
        sizes = spark.createDataFrame(list(tables[0].header.chromsizes().items()), "chrom string, length long")
    view = pairs_text.read_view(spark, a.view) if a.view else None
    s = scaling.Scaling(df, view, sizes, tuple(a.dist_range), a.n_dist_bins_decade)
    streams.write_table(s.table(dense=True), a.output)


PARSE = [
    ("sam_path", {"nargs": "?", "default": "-"}), ("-c --chroms-path", {"required": True}), OUT, ("--assembly", {}), ("--min-mapq", {"type": int, "default": 1}),
    ("--max-inter-align-gap", {"type": int, "default": 20}), ("--add-pair-index", {"action": "store_true"}), ("--add-columns", {"default": ""}),
    ("--drop-readid", {"action": "store_true"}), ("--drop-seq", {"action": "store_true"}), ("--drop-sam", {"action": "store_true"}),
    ("--output-parsed-alignments", {"default": ""}), ("--output-stats", {"default": ""}), ("--readid-transform", {}),
    ("--full-walks", {"action": "store_true"}), ("--yaml", {"action": "store_true"}), *FILTERS,
]


def _parse(spark, a, options: WalkOptions, report_end: str, name: str) -> None:
    if a.sam_path.endswith(".bam"):
        from contactloom.sources.bam import read_bam

        lines, top = read_bam(spark, a.sam_path)
    else:
        lines, top = sam.read_sam(spark, _input(spark, a.sam_path))
    sizes = sam.sam_chroms(top)
    chroms = pairs_text.read_chrom_list(spark, a.chroms_path, list(sizes))
    extra = [c for c in a.add_columns.split(",") if c]
    df = parse_sam(lines, chroms, options, a.min_mapq, a.flip, extra, a.add_pair_index, a.drop_readid, a.drop_seq, a.drop_sam, report_end, a.readid_transform)
    columns = [c for c in df.columns if not c.startswith("_")]
    header = PairsHeader.make(a.assembly, [(c, sizes[c]) for c in chroms if c in sizes], columns, UPPER_TRIANGLE if a.flip else WHOLE_MATRIX, top)
    _write(PairsTable(df, header.add_program(name, force=True)), a.output)
    _write_stats(df, a, spark, a.output_stats)
    if a.output_parsed_alignments:
        streams.write_lines(alignment_lines(lines, options, a.min_mapq), a.output_parsed_alignments)


@command("parse", *PARSE, ("--max-molecule-size", {"type": int, "default": 750}), ("--report-alignment-end", {"default": "5", "choices": ["5", "3"]}),
         ("--walks-policy", {"default": "5unique", "choices": list(POLICIES)}), ("--flip", {"action": argparse.BooleanOptionalAction, "default": True}))
def parse(spark, a):
    _parse(spark, a, WalkOptions(policy=a.walks_policy, max_gap=a.max_inter_align_gap, max_size=a.max_molecule_size, parity=not a.full_walks), a.report_alignment_end, "parse")


@command("parse2", *PARSE, ("--report-position", {"default": "outer", "choices": list(POSITIONS)}), ("--report-orientation", {"default": "pair", "choices": list(ORIENTATIONS)}),
         ("--max-insert-size", {"type": int, "default": 500}), ("--dedup-max-mismatch", {"type": int, "default": 3}), ("--single-end", {"action": "store_true"}),
         ("--expand", {"action": argparse.BooleanOptionalAction, "default": False}), ("--max-expansion-depth", {"type": int}),
         ("--flip", {"action": argparse.BooleanOptionalAction, "default": False}))
def parse2(spark, a):
    o = WalkOptions(True, max_gap=a.max_inter_align_gap, max_size=a.max_insert_size, position=a.report_position, orientation=a.report_orientation,
                    mismatch=a.dedup_max_mismatch, single_end=a.single_end, expand=a.expand, max_depth=a.max_expansion_depth, parity=not a.full_walks)
    _parse(spark, a, o, "5", "parse2")


@command("header", ("action", {"choices": ["generate", "transfer", "set-columns", "validate-columns"]}), PATH, OUT, ("--chroms-path", {}), ("--sam-path", {}),
         ("--columns", {"default": ""}), ("--extra-columns", {"default": ""}), ("--assembly", {}), ("--no-flip", {"action": "store_true"}),
         ("--pairsam", {"action": "store_true"}), ("-r --reference-file", {"default": ""}))
def header(spark, a):
    columns = [c for c in a.columns.split(",") if c]
    t = _read(spark, a.pairs_path)
    reference = PairsHeader.parse(pairs_text.head_lines(spark, a.reference_file)) if a.reference_file else None
    if a.action == "generate":
        if not (a.chroms_path or a.sam_path):
            raise SystemExit("header generate needs --chroms-path or --sam-path")
        top = pairs_text.head_lines(spark, a.sam_path, "@") if a.sam_path else []
        sizes = sam.sam_chroms(top) if a.sam_path else pairs_text.read_chromsizes(spark, a.chroms_path)
        names = columns or [*(PAIRSAM_COLUMNS if a.pairsam else PAIRS_COLUMNS), *[c for c in a.extra_columns.split(",") if c]]
        new = PairsHeader.make(a.assembly, sizes.items(), names, WHOLE_MATRIX if a.no_flip else UPPER_TRIANGLE, top)
    elif a.action == "transfer":
        new = t.header.transfer(reference)
    elif a.action == "set-columns":
        new = t.header.set_column_names(columns)
    else:
        width = t.df.agg(F.max("_width")).first()[0]
        t.header.validate_columns(width, reference.columns() if reference else columns or None)
        new = t.header
    _write(PairsTable(t.df, new), a.output)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="contactloom")
    parser.add_argument("-v", "--verbose", action="count", default=0)
    parser.add_argument("-d", "--debug", "--post-mortem", action="store_true", help="on an error start the debugger")
    parser.add_argument("--output-profile", default="", help="file for a profile of the driver's Python")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (fill, _) in COMMANDS.items():
        own = commands.add_parser(name)
        fill(own)
        own.add_argument("--cmd-in")
        own.add_argument("--cmd-out")
    args = list(sys.argv[1:] if args is None else args)
    a = parser.parse_args(args)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    spark = spark or SparkSession.builder.appName("contactloom").getOrCreate()
    spark.sparkContext.setLogLevel(["ERROR", "WARN", "INFO"][min(a.verbose, 2)])
    PIPES.update({"in": a.cmd_in, "out": a.cmd_out})
    header_module.command_line = shlex.join(["contactloom", *args])
    profile = cProfile.Profile() if a.output_profile else None
    try:
        if profile:
            profile.runcall(COMMANDS[a.command][1], spark, a)
            profile.dump_stats(a.output_profile)
        else:
            COMMANDS[a.command][1](spark, a)
    except Exception:
        if not a.debug:
            raise
        pdb.post_mortem()
        return 1
    finally:
        header_module.command_line = ""
        PIPES.update({"in": None, "out": None})
    return 0


if __name__ == "__main__":
    sys.exit(main())
