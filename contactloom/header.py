"""The header of a pairs file: a few lines of metadata that travel beside the DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from contactloom import __version__
from contactloom.schema import FORMAT_LINE, PAIRS_COLUMNS, UPPER_TRIANGLE

#: The command line that provenance records tell, set by the command line only.
command_line = ""
SORTED_LINE = "#sorted: chr1-chr2-pos1-pos2"


class HeaderError(ValueError):
    pass


@dataclass(frozen=True)
class PairsHeader:
    """Header lines in order, without line ends. All methods that change it give a new header."""

    lines: tuple[str, ...] = field(default=())

    # --- reading -------------------------------------------------------------------------------

    @staticmethod
    def parse(lines: Iterable[str]) -> "PairsHeader":
        """The leading lines that begin with '#'; what follows belongs to the body."""
        out = []
        for line in lines:
            if not line.startswith("#"):
                break
            out.append(line.rstrip("\r\n"))
        return PairsHeader(tuple(out))

    @staticmethod
    def make(
        assembly: str | None = None, chromsizes: Iterable[tuple[str, int]] = (), columns: Sequence[str] = PAIRS_COLUMNS,
        shape: str = UPPER_TRIANGLE, samheader: Sequence[str] = (),
    ) -> "PairsHeader":
        sizes = [f"#chromsize: {c} {n}" for c, n in chromsizes]
        top = [FORMAT_LINE, f"#shape: {shape}", f"#genome_assembly: {assembly or 'unknown'}", *sizes]
        return PairsHeader((*top, *(f"#samheader: {s}" for s in samheader), "#columns: " + " ".join(columns)))

    def is_empty(self) -> bool:
        return not self.lines or not self.lines[0].startswith("#")

    def require(self) -> None:
        if self.is_empty():
            raise HeaderError("the input has no header or is empty")

    def values(self, name: str) -> list[str]:
        start = f"#{name}:"
        return [line[len(start) :].strip() for line in self.lines if line.startswith(start)]

    def columns(self, default: Sequence[str] = PAIRS_COLUMNS) -> list[str]:
        found = self.values("columns")
        return found[-1].split() if found and found[-1] else list(default)

    def chromsizes(self) -> dict[str, int]:
        return {c: int(n) for c, n in (v.split()[:2] for v in self.values("chromsize"))}

    def chromosomes(self) -> list[str]:
        listed = self.values("chromosomes")
        return listed[0].split() if listed else list(self.chromsizes())

    def samheader(self) -> list[str]:
        return self.values("samheader")

    def is_sorted(self) -> bool:
        return any(line.startswith("#sorted") for line in self.lines)

    # --- changing ------------------------------------------------------------------------------

    def with_field(self, name: str, value: str) -> "PairsHeader":
        start, line = f"#{name}:", f"#{name}: {value}"
        if any(x.startswith(start) for x in self.lines):
            return PairsHeader(tuple(line if x.startswith(start) else x for x in self.lines))
        at = next((i for i, x in enumerate(self.lines) if x.startswith("#columns")), len(self.lines))
        return PairsHeader((*self.lines[:at], line, *self.lines[at:]))

    def with_columns(self, columns: Sequence[str]) -> "PairsHeader":
        return self.with_field("columns", " ".join(columns))

    def append_columns(self, columns: Sequence[str]) -> "PairsHeader":
        return self.with_columns([*self.columns(), *columns])

    def without_columns(self, columns: Iterable[str]) -> "PairsHeader":
        gone = set(columns)
        return self.with_columns([c for c in self.columns() if c not in gone])

    def with_samheader(self, lines: Sequence[str]) -> "PairsHeader":
        """The SAM header lines, placed before the columns."""
        rest = [x for x in self.lines if not x.startswith("#samheader:")]
        at = next((i for i, x in enumerate(rest) if x.startswith("#columns")), len(rest))
        return PairsHeader((*rest[:at], *(f"#samheader: {s}" for s in lines), *rest[at:]))

    def subset_chroms(self, keep: Iterable[str]) -> "PairsHeader":
        keep, out = set(keep), []
        for x in self.lines:
            if x.startswith("#chromsize:"):
                if x.split()[1] not in keep:
                    continue
            elif x.startswith("#chromosomes:"):
                x = " ".join(["#chromosomes:", *(c for c in x.split()[1:] if c in keep)])
            out.append(x)
        return PairsHeader(tuple(out))

    def mark_sorted(self) -> "PairsHeader":
        self.require()
        lines = list(self.lines)
        if not self.is_sorted():
            lines.insert(1 if lines[0].startswith("##") else 0, SORTED_LINE)
        for i, x in enumerate(lines):
            if x.startswith("#chromosomes:"):
                lines[i] = " ".join(["#chromosomes:", *sorted(x.split()[1:])])
        return PairsHeader(tuple(lines))

    def unmark_sorted(self) -> "PairsHeader":
        return PairsHeader(tuple(x for x in self.lines if not x.startswith("#sorted")))

    def add_program(self, name: str, command: str | None = None, version: str = __version__, force: bool = False) -> "PairsHeader":
        """A provenance record at the end of every chain of programs in the SAM header."""
        self.require()
        command = command_line if command is None else command
        sam = self.samheader()
        chains = program_chains(sam, force)
        records = []
        for i, chain in enumerate(chains, 1):
            own = f"{name}-{i}.{len(chain) + 1}" if len(chains) > 1 else name
            records += [c["raw"] for c in chain]
            parts = {"ID": own, "PN": name, "CL": command, "PP": chain[-1]["ID"] if chain else None, "VN": version}
            records.append("\t".join(["@PG", *(f"{k}:{v}" for k, v in parts.items() if v is not None)]))
        first = [x for x in sam if x[:3] in ("@HD", "@SQ", "@RG")]
        rest = [x for x in sam if x[:3] not in ("@HD", "@SQ", "@RG", "@PG")]
        return self.with_samheader([*first, *records, *rest])

    def transfer(self, reference: "PairsHeader") -> "PairsHeader":
        """The header of another file on this file's rows."""
        return replace(reference)

    def set_column_names(self, names: Sequence[str]) -> "PairsHeader":
        """New names for all columns, as many as there are."""
        if len(names) != len(self.columns()):
            raise HeaderError(f"{len(names)} names for {len(self.columns())} columns")
        return self.with_columns(names)

    def validate_columns(self, width: int | None = None, reference: Sequence[str] | None = None) -> None:
        columns = self.columns()
        if reference is not None and list(reference) != columns:
            raise HeaderError(f"columns are {columns}, not {list(reference)}")
        if width is not None and width != len(columns):
            raise HeaderError(f"rows have {width} fields for {len(columns)} columns")

    def text(self) -> str:
        return "".join(f"{x}\n" for x in self.lines)


def program_chains(samheader: Sequence[str], force: bool = False) -> list[list[dict[str, str]]]:
    """@PG records as chains from their first program on. A record whose PP is missing from the
    header, a repeated ID and a program that several follow are errors unless force is set; then
    such records begin chains of their own. Without records there is one empty chain."""
    records = []
    for line in samheader:
        if line.startswith("@PG"):
            parts = dict(x.split(":", 1) for x in line.rstrip().split("\t")[1:] if ":" in x)
            if "ID" in parts:
                records.append({**parts, "raw": line.rstrip()})
    if not records:
        return [[]]
    by_id: dict[str, dict[str, str]] = {}
    for r in records:
        if r["ID"] in by_id and not force:
            raise HeaderError(f"two programs with the ID {r['ID']}")
        by_id[r["ID"]] = r
    following: dict[str, list[dict[str, str]]] = {}
    heads = []
    for r in records:
        above = r.get("PP")
        if above is None:
            heads.append(r)
        elif above not in by_id:
            if not force:
                raise HeaderError(f"{r['ID']} follows {above}, which is missing")
            heads.append(r)
        else:
            following.setdefault(above, []).append(r)
    if not force and any(len(v) > 1 for v in following.values()):
        raise HeaderError("several programs follow the same one")
    chains, placed = [], set()
    queue = list(heads)
    while queue:
        r = queue.pop(0)
        chain = []
        while r is not None and r["ID"] not in placed:
            placed.add(r["ID"])
            chain.append(r)
            after = following.get(r["ID"], [])
            queue += after[1:]
            r = after[0] if after else None
        if chain:
            chains.append(chain)
    if len(placed) < len(by_id):
        if not force:
            raise HeaderError("programs that follow each other in a loop")
        chains += [[r] for k, r in by_id.items() if k not in placed]
    return chains


def merge_headers(headers: Sequence[PairsHeader], force: bool = False, keep_first: bool = False) -> PairsHeader:
    """One header for the rows of several files.

    Format, order, shape, assembly and columns must be the same in all; chromosomes and their sizes
    are united in the order of their names; other lines are kept once. Of SAM headers at most one @HD
    and the same @SQ lines are allowed, @PG records get the number of their file. force keeps the
    first of what differs in the SAM headers."""
    if not headers:
        raise HeaderError("no header to merge")
    if keep_first or len(headers) == 1:
        return headers[0]
    same = ["## pairs format", "#sorted", "#shape:", "#genome_assembly:", "#columns:"]
    out: list[str] = []
    for key in same:
        found = [[x for x in h.lines if x.startswith(key)] for h in headers]
        if any(x != found[0] for x in found):
            raise HeaderError(f"{key} differs between the files")
        if key != "#columns:":
            out += found[0]
    sizes: dict[str, int] = {}
    for h in headers:
        sizes |= h.chromsizes()
    if any(x.startswith("#chromosomes:") for h in headers for x in h.lines):
        every = sorted({c for h in headers for c in h.chromosomes()} | set(sizes))
        out.append(" ".join(["#chromosomes:", *every]))
    out += [f"#chromsize: {c} {sizes[c]}" for c in sorted(sizes)]
    known = (*same, "#chromosomes:", "#chromsize:", "#samheader:")
    out += sorted({x for h in headers for x in h.lines if not x.startswith(known)})
    out += [x for x in headers[0].lines if x.startswith("#columns:")]
    return PairsHeader(tuple(out)).with_samheader(merge_samheaders([h.samheader() for h in headers], force))


def merge_samheaders(headers: Sequence[Sequence[str]], force: bool = False) -> list[str]:
    first = list(dict.fromkeys(x for h in headers for x in h if x.startswith("@HD")))
    if len(first) > 1 and not force:
        raise HeaderError("more than one @HD line")
    sequences = [[x for x in h if x.startswith("@SQ")] for h in headers]
    if any(set(s) != set(sequences[0]) for s in sequences) and not force:
        raise HeaderError("the @SQ lines differ")
    programs, rest = [], []
    for i, h in enumerate(headers, 1):
        for x in h:
            if x.startswith("@PG"):
                programs.append("\t".join(f"{p}-{i}" if p.startswith(("ID:", "PP:")) else p for p in x.split("\t")))
        rest += dict.fromkeys(x for x in h if not x.startswith(("@HD", "@SQ", "@PG")))
    return [*first[:1], *sequences[0], *programs, *rest]


def chrom_order(names_in_order: Sequence[str], sam_chroms: Iterable[str] | None = None) -> list[str]:
    """The chromosomes of a SAM header in the order of a list; those not listed come after, by name."""
    if sam_chroms is None:
        return list(dict.fromkeys(names_in_order))
    known = set(sam_chroms)
    listed = [c for c in dict.fromkeys(names_in_order) if c in known]
    return [*listed, *sorted(known - set(listed))]
