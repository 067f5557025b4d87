import pytest

from contactloom.functions.complexity import estimate_complexity
from contactloom.operators import stats
from contactloom.sources.stats_text import write_stats

PAIRS = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string"


def test_summary_has_complexity_convergence_and_tiles(frame, tmp_path):
    far = [(f"f{i}", "chr1", 1, "chr1", 50_001, s[0], s[1], "UU") for i, s in enumerate(stats.STRANDS)]
    near = [(f"n{i}", "chr1", 1, "chr1", 2_001, "+", "-", "UU") for i in range(6)]
    dups = [(f"d{i}", "chr1", 1, "chr1", 2_001, "+", "-", "DD") for i in range(4)]
    s = stats.PairStats(frame(far + near + dups, PAIRS))
    tiles = frame([("1:1:1", "1:1:1", 1), ("1:1:1", "1:1:2", 1)], "tile string, parent_tile string, dup_count long")
    got = stats.full_summary(s, tiles)["no_filter"]
    at = "summary/dist_freq_convergence/"
    assert got["summary/frac_cis"] == 1 and got["summary/complexity_naive"] == pytest.approx(estimate_complexity(14, 4, 0))
    assert got["dups_by_tile_median"] == 2 and got["summary/complexity_dups_by_tile_median"] == pytest.approx(estimate_complexity(14, 4, 2))
    assert 2_000 < got[f"{at}convergence_dist"] < 50_000
    assert got[f"{at}n_cis_pairs_below_convergence_dist/+-"] == 6 and got[f"{at}n_cis_pairs_above_convergence_dist_all_strands"] == 4
    assert got[f"{at}frac_total_mapped_in_cis_below_convergence_dist_all_strands"] == pytest.approx(6 / 14)
    path = str(tmp_path / "stats.tsv")
    write_stats(s.long(), path, more={"no_filter": got})
    text = open(path).read()
    assert "summary/complexity_naive\t" in text and f"{at}convergence_dist\t" in text and "total\t14\n" in text
