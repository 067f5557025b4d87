"""Columns, types and sentinels of the pairs tables."""

from __future__ import annotations

# Fixed values of the pairs and pairsam formats.
PAIRS_COLUMNS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type"]
PAIRSAM_COLUMNS = [*PAIRS_COLUMNS, "sam1", "sam2"]
POSITION_COLUMNS = ["pos1", "pos2"]
UNMAPPED_CHROM, UNMAPPED_POS, UNMAPPED_STRAND = "!", 0, "-"
FIELD_SEP, SAM_SEP, SAM_ENTRY_SEP = "\t", "\x19", "\x19NEXT_SAM\x19"
FORMAT_LINE = "## pairs format v1.0.0"
UPPER_TRIANGLE, WHOLE_MATRIX = "upper triangle", "whole matrix"
DUPLICATE, HIGH_COVERAGE = "DD", "FF"
SIDE_INT_COLUMNS = [
    "mapq", "pos5", "pos3", "read_len", "matched_bp", "algn_ref_span", "algn_read_span",
    "dist_to_5", "dist_to_3", "read_side", "algn_idx", "same_side_algn_count",
]
SIDE_TEXT_COLUMNS = ["cigar", "seq", "mismatches"]
EXTRA_COLUMNS = [*SIDE_INT_COLUMNS, *SIDE_TEXT_COLUMNS]
FRAGMENT_COLUMNS = ["rfrag", "rfrag_start", "rfrag_end"]

#: Columns that hold whole numbers; every other column is text.
INT_COLUMNS = {
    *POSITION_COLUMNS, "walk_pair_index", *[f"{c}{i}" for c in [*SIDE_INT_COLUMNS, *FRAGMENT_COLUMNS] for i in (1, 2)]
}
