"""Operators that look at one row at a time: all are expressions, none shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.predicates import Unsupported, compile_condition, compile_value, python_condition
from contactloom.schema import DUPLICATE, SAM_ENTRY_SEP, SAM_SEP, UNMAPPED_CHROM

Names = Mapping[str, str]


def _plain(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


# --- select ------------------------------------------------------------------------------------


def condition(
    df: DataFrame, text: str, casts: Names | None = None, chrom_subset: Sequence[str] | None = None,
    python: bool = False, startup: str | None = None,
) -> Column:
    """The condition as a column that is never null: what cannot be decided for a row is false.
    python: evaluate in Python what has no Spark counterpart, running the given code."""
    try:
        if startup:
            raise Unsupported("startup code needs Python")
        c = compile_condition(text, _plain(df), casts)
    except Unsupported:
        if not python:
            raise
        c = python_condition(text, _plain(df), casts, startup)
    if chrom_subset is not None:
        c = c & F.col("chrom1").isin(*chrom_subset) & F.col("chrom2").isin(*chrom_subset)
    return F.coalesce(c, F.lit(False))


def select(df: DataFrame, text: str, remove_columns: Iterable[str] = (), **options) -> DataFrame:
    """Rows that meet the condition. Columns to remove are dropped after the condition has seen them."""
    return df.filter(condition(df, text, **options)).drop(*remove_columns)


def select_rest(df: DataFrame, text: str, remove_columns: Iterable[str] = (), **options) -> DataFrame:
    """All rows that select leaves out."""
    return df.filter(~condition(df, text, **options)).drop(*remove_columns)


def transform_read_ids(df: DataFrame, expression: str) -> DataFrame:
    """readID replaced by an expression over it."""
    return df.withColumn("readID", compile_value(expression, ["readID"]).cast("string"))


# --- columns -----------------------------------------------------------------------------------


def rename_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    plain = _plain(df)
    if len(names) != len(plain):
        raise ValueError(f"{len(names)} names for {len(plain)} columns")
    return df.withColumnsRenamed(dict(zip(plain, names)))


def cast_columns(df: DataFrame, casts: Names) -> DataFrame:
    kinds = {"int": "bigint", "float": "double", "str": "string"}
    return df.withColumns({c: F.col(c).try_cast(kinds.get(t, t)) for c, t in casts.items()})


def is_mapped(c1: str = "chrom1", c2: str = "chrom2", unmapped: str = UNMAPPED_CHROM) -> Column:
    """Both sides mapped. A null chromosome counts as unmapped."""
    sides = (F.coalesce(F.col(c), F.lit(unmapped)) != unmapped for c in (c1, c2))
    a, b = sides
    return a & b


# --- flip --------------------------------------------------------------------------------------


def chrom_rank(order: Sequence[str], chrom: Column) -> Column:
    """Place of a chromosome in the order, null if it is not in it. A constant map, so no join."""
    if not order:
        return F.lit(None).cast("int")
    return F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])[chrom]


def wrong_order(df: DataFrame, order: Sequence[str], keep_equal_unlisted: bool = False) -> Column:
    """Whether the sides of a row have to be exchanged: listed chromosomes come before unlisted ones,
    listed ones by place and position, unlisted ones by name. Of two equal unlisted ones the sides
    are always exchanged, as in the common format's tools, unless keep_equal_unlisted is set."""
    order = [UNMAPPED_CHROM, *[c for c in order if c != UNMAPPED_CHROM]]
    r1, r2 = chrom_rank(order, F.col("chrom1")), chrom_rank(order, F.col("chrom2"))
    both = F.struct(r1.alias("r"), F.col("pos1").cast("long").alias("p")) > F.struct(r2.alias("r"), F.col("pos2").cast("long").alias("p"))
    names = F.col("chrom1") > F.col("chrom2") if keep_equal_unlisted else F.col("chrom1") >= F.col("chrom2")
    listed1, listed2 = r1.isNotNull(), r2.isNotNull()
    known = F.col("chrom1").isNotNull() & F.col("chrom2").isNotNull() & F.col("pos1").isNotNull() & F.col("pos2").isNotNull()
    out = F.when(~known, F.lit(False)).when(listed1 & listed2, both).when(listed1, F.lit(False)).when(listed2, F.lit(True)).otherwise(names)
    return out


def flip(df: DataFrame, order: Sequence[str], keep_equal_unlisted: bool = False) -> DataFrame:
    """Sides in the order of chromosomes: all pairs of columns that end in 1 and 2 are exchanged, and
    the letters of pair_type. Rows with a null chromosome or position stay as they are."""
    names = _plain(df)
    wrong = wrong_order(df, order, keep_equal_unlisted)
    df = df.withColumn("_wrong", wrong)
    out: dict[str, Column] = {}
    for a in names:
        b = a[:-1] + "2"
        if a.endswith("1") and b in names:
            out[a] = F.when(F.col("_wrong"), F.col(b)).otherwise(F.col(a))
            out[b] = F.when(F.col("_wrong"), F.col(a)).otherwise(F.col(b))
    if "pair_type" in names:
        turned = F.concat(F.substring("pair_type", 2, 1), F.substring("pair_type", 1, 1))
        out["pair_type"] = F.when(F.col("_wrong") & (F.length("pair_type") >= 2), turned).otherwise(F.col("pair_type"))
    return df.withColumns(out).drop("_wrong")


# --- sample ------------------------------------------------------------------------------------


def sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Each row by itself with the given probability."""
    return df.sample(False, fraction, seed)


def sample_by_hash(df: DataFrame, fraction: float, key: str = "readID", seed: int = 0) -> DataFrame:
    """Rows whose key hashes below the fraction: the same rows whatever the partitioning, and all rows
    of a key together. Null keys hash like empty text."""
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("")))), 1, 8), 16, 10).cast("long")
    return df.filter(unit < F.lit(int(fraction * 2**32)).cast("long"))


# --- pairsam -----------------------------------------------------------------------------------


def _mark_entry(entry: Column) -> Column:
    """A SAM entry with the duplicate bit in its flag and DD as its pair type tag."""
    fields = F.split(entry, SAM_SEP, -1)
    flag = F.get(fields, F.lit(1)).try_cast("int").bitwiseOR(F.lit(1024)).cast("string")
    marked = F.transform(
        fields,
        lambda x, i: F.when((i == 1) & flag.isNotNull(), flag).when(x.startswith("Yt:Z:"), F.lit(f"Yt:Z:{DUPLICATE}")).otherwise(x),
    )
    return F.array_join(marked, SAM_SEP)


def mark_sam(sam: Column) -> Column:
    marked = F.array_join(F.transform(F.split(sam, SAM_ENTRY_SEP, -1), _mark_entry), SAM_ENTRY_SEP)
    return F.when(sam.isNull() | sam.isin("", "."), sam).otherwise(marked)


def mark_as_dup(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows (those where when holds, else all) marked as duplicates, in pair_type and SAM entries."""
    out = {"pair_type": F.lit(DUPLICATE), **{c: mark_sam(F.col(c)) for c in ("sam1", "sam2") if c in df.columns}}
    if when is not None:
        out = {c: F.when(when, v).otherwise(F.col(c)) for c, v in out.items()}
    return df.withColumns(out)


def split_pairs(df: DataFrame) -> DataFrame:
    """A pairsam table without its SAM entries."""
    return df.drop("sam1", "sam2")


def split_sam(df: DataFrame) -> DataFrame:
    """(value): the SAM lines of a pairsam table, those of side 1 before those of side 2; '.' and
    empty entries hold none."""
    entries = F.concat(*[F.split(F.coalesce(F.col(c), F.lit(".")), SAM_ENTRY_SEP, -1) for c in ("sam1", "sam2")])
    kept = F.filter(entries, lambda e: ~e.isin("", "."))
    return df.select(F.explode(kept).alias("entry")).select(F.translate("entry", SAM_SEP, "\t").alias("value"))


# --- phase -------------------------------------------------------------------------------------


def _chrom_phase(chrom: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    phase, base = F.lit("!"), chrom
    for value, suffix in reversed(list(zip("01", suffixes))):
        ends = chrom.endswith(suffix)
        phase = F.when(ends, F.lit(value)).otherwise(phase)
        base = F.when(ends, F.left(chrom, F.length(chrom) - len(suffix))).otherwise(base)
    return phase, base


def _phase_side(side: int, suffixes: Sequence[str], tag_mode: str) -> dict[str, Column]:
    """Phase, chromosome without suffix, and three scores of one side. The best hit is phased when it
    scores above the second. Else it is unphased ('.') if the second is the same place on the other
    haplotype and no third hit is as good; in all other cases the side is multiply mapped."""
    col = lambda name: F.col(f"{name}{side}")
    hits = F.filter(F.split(F.coalesce(col(tag_mode), F.lit("")), ";"), lambda x: F.trim(x) != "")
    hit = lambda i: F.split(F.get(hits, F.lit(i)), ",")
    best, second = col("AS").try_cast("int"), col("XS").try_cast("int")
    phase, base = _chrom_phase(col("chrom"), suffixes)
    other_phase, other_base = _chrom_phase(F.get(hit(0), F.lit(0)), suffixes)
    minus = F.lit(-1)
    if tag_mode == "XB":
        third = F.get(hit(1), F.lit(4)).try_cast("int")
        scores = (best, second, F.when(best > second, minus).otherwise(F.coalesce(third, minus)))
        tie = (third == second) & (second == best)
    else:
        own, alt, third = col("NM").try_cast("int"), F.get(hit(0), F.lit(3)).try_cast("int"), F.get(hit(1), F.lit(3)).try_cast("int")
        scores = (own, F.coalesce(alt, minus), F.when(best > second, minus).otherwise(F.coalesce(third, minus)))
        tie = (third == alt) & (alt == own)
    phased = ~phase.isin("!") & ~other_phase.isin("!")
    homologue = (base == other_base) & phased & (phase != other_phase)
    result = (
        F.when(best > second, F.struct(phase.alias("phase"), base.alias("chrom")))
        .when(F.coalesce(tie, F.lit(False)), F.struct(F.lit("!").alias("phase"), F.lit("!").alias("chrom")))
        .when(F.coalesce(homologue, F.lit(False)), F.struct(F.lit(".").alias("phase"), base.alias("chrom")))
        .otherwise(F.struct(F.lit("!").alias("phase"), F.lit("!").alias("chrom")))
    )
    return {"phase": result["phase"], "chrom": result["chrom"], "scores": F.array(*scores)}


def phase(
    df: DataFrame, suffixes: Sequence[str] = ("_hap1", "_hap2"), tag_mode: str = "XB", report_scores: bool = False,
    clean: bool = False,
) -> DataFrame:
    """Haplotype phases of both sides from the tags of the best hits (columns AS, XS and XB or XA, NM
    with 1 and 2): phase1, phase2 are 0, 1, '.' or '!'. A multiply mapped side becomes unmapped and
    its letter of pair_type M. Unmapped sides have phase '!' and scores -1. Missing tags are an error."""
    tags = ["XB", "AS", "XS"] if tag_mode == "XB" else ["XA", "NM", "AS", "XS"]
    if missing := [f"{t}{i}" for t in tags for i in (1, 2) if f"{t}{i}" not in df.columns]:
        raise ValueError(f"columns {missing} are needed for phasing by {tag_mode}")
    first = df.withColumns(
        {f"_side{i}": F.struct(*[v.alias(k) for k, v in _phase_side(i, suffixes, tag_mode).items()]) for i in (1, 2)}
    )
    out: dict[str, Column] = {}
    letters = {1: F.substring("pair_type", 1, 1), 2: F.substring("pair_type", 2, 1)}
    for i in (1, 2):
        side, mapped = F.col(f"_side{i}"), F.col(f"chrom{i}") != UNMAPPED_CHROM
        lost = mapped & (side["chrom"] == UNMAPPED_CHROM)
        out[f"phase{i}"] = F.when(mapped, side["phase"]).otherwise(F.lit("!"))
        out[f"chrom{i}"] = F.when(mapped, side["chrom"]).otherwise(F.col(f"chrom{i}"))
        out[f"pos{i}"] = F.when(lost, F.lit(0)).otherwise(F.col(f"pos{i}"))
        out[f"strand{i}"] = F.when(lost, F.lit("-")).otherwise(F.col(f"strand{i}"))
        letters[i] = F.when(lost, F.lit("M")).otherwise(letters[i])
        if report_scores:
            for k in range(3):
                name = f"{'S' if tag_mode == 'XB' else 'M'}{k + 1}_{i}"
                out[name] = F.when(mapped, side["scores"][k]).otherwise(F.lit(-1))
    out["pair_type"] = F.concat(letters[1], letters[2])
    result = first.withColumns(out).drop("_side1", "_side2")
    return result.drop(*[f"{t}{i}" for t in tags for i in (1, 2)]) if clean else result
