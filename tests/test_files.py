import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from contactloom import cli
from contactloom.header import HeaderError, PairsHeader, chrom_order, merge_headers, program_chains
from contactloom.operators import stats
from contactloom.sources import bam, pairs_text, stats_text
from contactloom.streaming import pairs_stream

TOP = ["## pairs format v1.0.0", "#shape: upper triangle", "#genome_assembly: x", "#chromosomes: chr2 chr1", "#chromsize: chr2 100", "#chromsize: chr1 200"]
COLUMNS = "#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type"
ROWS = [
    'q"1\tchr1\t7\tchr2\t3\t+\t+\tUU', "#odd\tchr2\t5\tchr2\t9\t+\t-\tUU", "b\t!\t0\tchr1\t3\t-\t+\tNU", "c\tchr1\t7\tchr2\t4\t+\t+\tUU",
    "d\tchr1\t70\tchr2\t40\t+\t+", "e\t!\t0\t!\t0\t-\t-\tWW",
]


@pytest.fixture
def pairs_file(tmp_path):
    path = tmp_path / "in.pairs"
    path.write_text("\n".join([*TOP, COLUMNS, *ROWS]) + "\n")
    return str(path)


# --- header --------------------------------------------------------------------------------------


def test_header_reading_and_changes():
    h = PairsHeader.parse([*TOP, COLUMNS, "row"])
    assert h.columns()[0] == "readID" and h.chromsizes() == {"chr2": 100, "chr1": 200} and h.chromosomes() == ["chr2", "chr1"]
    s = h.mark_sorted()
    assert s.lines[1].startswith("#sorted") and "#chromosomes: chr1 chr2" in s.lines and s.mark_sorted() == s
    assert h.subset_chroms(["chr1"]).chromsizes() == {"chr1": 200} and h.subset_chroms(["chr1"]).chromosomes() == ["chr1"]
    assert h.append_columns(["x"]).columns()[-1] == "x" and h.without_columns(["pos1"]).columns()[2] == "chrom2"
    assert PairsHeader().columns() == COLUMNS.split()[1:]
    with pytest.raises(HeaderError):
        PairsHeader().mark_sorted()
    with pytest.raises(HeaderError):
        h.set_column_names(["a"])
    with pytest.raises(HeaderError):
        h.validate_columns(9)
    with pytest.raises(HeaderError):
        h.validate_columns(reference=["a"])
    h.validate_columns(8, h.columns())
    assert PairsHeader.parse(h.text().splitlines()) == h


def test_programs():
    h = PairsHeader.parse([*TOP, COLUMNS]).add_program("sort", "sort x").add_program("dedup")
    pgs = [x for x in h.samheader() if x.startswith("@PG")]
    assert "PP:sort" in pgs[1] and "PP" not in pgs[0] and h.lines[-1] == COLUMNS
    two = h.with_samheader(["@SQ\tSN:chr1", "@PG\tID:a", "@PG\tID:b", "@CO\tx"]).add_program("m")
    assert [x.split("\t")[1] for x in two.samheader() if x.startswith("@PG")] == ["ID:a", "ID:m-1.2", "ID:b", "ID:m-2.2"]
    for bad in (["@PG\tID:a\tPP:gone"], ["@PG\tID:a", "@PG\tID:a"], ["@PG\tID:a", "@PG\tID:b\tPP:a", "@PG\tID:c\tPP:a"], ["@PG\tID:a\tPP:b", "@PG\tID:b\tPP:a"]):
        with pytest.raises(HeaderError):
            program_chains(bad)
        assert program_chains(bad, force=True)


def test_header_merge():
    a = PairsHeader.parse([*TOP, "#samheader: @SQ\tSN:chr1", "#samheader: @PG\tID:x", COLUMNS])
    b = PairsHeader.parse([*TOP[:4], "#chromsize: chr3 7", "#note: n", "#samheader: @SQ\tSN:chr1", "#samheader: @PG\tID:x\tPP:y", "#samheader: @PG\tID:y", COLUMNS])
    m = merge_headers([a, b])
    assert m.chromosomes() == ["chr1", "chr2", "chr3"] and m.chromsizes()["chr3"] == 7 and "#note: n" in m.lines
    assert [x.split("\t", 1)[1] for x in m.samheader() if x.startswith("@PG")] == ["ID:x-1", "ID:x-2\tPP:y-2", "ID:y-2"]
    with pytest.raises(HeaderError):
        merge_headers([a, b.with_columns(["readID"])])
    with pytest.raises(HeaderError):
        merge_headers([a, b.with_samheader(["@SQ\tSN:other"])])
    assert merge_headers([a, b], keep_first=True) == a == merge_headers([a])
    assert chrom_order(["b", "a", "z"], ["a", "b", "d", "c"]) == ["b", "a", "c", "d"]


# --- files ---------------------------------------------------------------------------------------


def test_reading_and_writing(spark, pairs_file, tmp_path):
    t = pairs_text.read_pairs(spark, pairs_file)
    rows = {r.readID: r for r in t.df.collect()}
    assert set(rows) == {"#odd", 'q"1', "b", "c", "d", "e"} and rows["d"].pair_type is None and rows["b"].chrom1 == "!" and rows["c"].pos1 == 7
    out = str(tmp_path / "out.pairs.gz")
    pairs_text.write_pairs(t, out, single=True)
    assert gzip.open(out, "rt").read() == open(pairs_file).read()
    pairs_text.write_pairs(t, str(tmp_path / "parts"))
    assert (tmp_path / "parts/_header").read_text().splitlines()[-1] == COLUMNS
    assert pairs_text.read_pairs(spark, out).df.count() == 6
    with pytest.raises(ValueError):
        pairs_text.read_pairs(spark, _empty(tmp_path / "x.pairs.lz4"))
    with pytest.raises(FileNotFoundError):
        pairs_text.read_pairs(spark, str(tmp_path / "missing"))


def _empty(path):
    path.write_text("")
    return str(path)


def run(spark, *args):
    assert cli.main([str(a) for a in args], spark) == 0


def body(path):
    return [x for x in open(path).read().splitlines() if not x.startswith(("##", "#s", "#g", "#c"))]


def test_commands(spark, pairs_file, tmp_path):
    out = lambda n: str(tmp_path / n)
    run(spark, "select", "pos1 > 5", pairs_file, "-o", out("s.pairs"), "--output-rest", out("r.pairs"))
    assert len(body(out("s.pairs"))) == 3 and len(body(out("r.pairs"))) == 3
    run(spark, "sort", pairs_file, "-o", out("sorted.pairs"))
    assert [x.split("\t")[0] for x in body(out("sorted.pairs"))] == ["e", "b", 'q"1', "c", "d", "#odd"]
    run(spark, "merge", out("sorted.pairs"), out("sorted.pairs"), "-o", out("m.pairs"))
    assert len(body(out("m.pairs"))) == 12
    run(spark, "dedup", out("sorted.pairs"), "-o", out("d.pairs"), "--output-dups", out("dd.pairs"), "--output-unmapped", out("u.pairs"), "--keep-parent-id", "--output-stats", out("d.tsv"))
    assert len(body(out("d.pairs"))) == 3 and len(body(out("u.pairs"))) == 2
    assert body(out("dd.pairs"))[0].split("\t")[-2:] == ["DD", 'q"1'] and "parent_readID" in open(out("dd.pairs")).read()
    assert "total_dups\t1\n" in open(out("d.tsv")).read()
    (tmp_path / "sizes").write_text("chr2\t100\nchr1\t200\n")
    run(spark, "flip", pairs_file, "-c", out("sizes"), "-o", out("f.pairs"))
    assert any(x.startswith("c\tchr2\t4\tchr1\t7") for x in body(out("f.pairs")))
    (tmp_path / "frags.bed").write_text("chr1\t0\t50\nchr1\t50\t200\nchr2\t0\t100\n")
    run(spark, "restrict", pairs_file, "-f", out("frags.bed"), "-o", out("rf.pairs"))
    assert any(x.endswith("1\t51\t201\t0\t0\t101") for x in body(out("rf.pairs")))
    run(spark, "stats", pairs_file, "-o", out("st.tsv"))
    text = open(out("st.tsv")).read()
    assert "total\t6\n" in text and "summary/frac_cis\t" in text
    run(spark, "stats", "--merge", out("st.tsv"), out("st.tsv"), "-o", out("st2.tsv"))
    assert "total\t12\n" in open(out("st2.tsv")).read()
    run(spark, "stats", pairs_file, "-o", out("st.yml"), "--yaml", "--filter", "a:pos1 > 5", "--filter", "b:True")
    assert stats_text.read_stats_yaml(spark, out("st.yml")).filter("filter = 'b' and key = 'total'").first().value == 6
    run(spark, "scaling", pairs_file, "-o", out("scaling"))
    run(spark, "sample", "1.0", pairs_file, "-o", out("sa.pairs"))
    run(spark, "filterbycov", pairs_file, "--max-cov", "1", "-o", out("lo.pairs"), "--output-highcov", out("hi.pairs"))
    assert len(body(out("lo.pairs"))) + len(body(out("hi.pairs"))) == 4
    run(spark, "header", "set-columns", pairs_file, "-o", out("h.pairs"), "--columns", "a,b,c,d,e,f,g,h")
    assert "#columns: a b c d e f g h" in open(out("h.pairs")).read()
    run(spark, "header", "generate", pairs_file, "--chroms-path", out("sizes"), "-o", out("g.pairs"), "--assembly", "y")
    assert "#genome_assembly: y" in open(out("g.pairs")).read()
    run(spark, "header", "transfer", out("h.pairs"), "-r", pairs_file, "-o", out("t.pairs"))
    assert COLUMNS in open(out("t.pairs")).read()
    with pytest.raises(HeaderError):
        run(spark, "header", "validate-columns", pairs_file, "--columns", "a,b")


def test_stats_text(spark, frame, tmp_path):
    df = frame([("a", "x/y", 1.0), ("a", "z", 0.5), ("b", "z", 2.0)], stats_text.LONG)
    stats_text.write_stats(df, str(tmp_path / "a.yml"), yaml=True)
    back = stats_text.read_stats_yaml(spark, str(tmp_path / "a.yml"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        stats_text.write_stats(df, str(tmp_path / "a.tsv"))
    assert sorted(stats_text.by_filter(df).columns) == ["filter", "x/y", "z"]


# --- BAM and streams -----------------------------------------------------------------------------


def bam_bytes():
    name, tag = b"q1\0", b"NMC\x03" + b"XSZabc\0" + b"ZBBs" + struct.pack("<ihh", 2, -1, 5) + b"FFf" + struct.pack("<f", 1.5)
    record = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 60, 0, 2, 65, 3, 0, 19, 7) + name + struct.pack("<II", 2 << 4, (1 << 4) | 4) + bytes([0x12, 0x40]) + bytes([30, 31, 32]) + tag
    text = b"@SQ\tSN:chr1\tLN:100\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 100)
    data += struct.pack("<i", len(record)) + record
    packed = b""
    for part in (data[:40], data[40:], b""):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed += z.compress(part) + z.flush()
    return packed


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    lines, top = bam.read_bam(spark, str(tmp_path / "x.bam"))
    assert top == ["@SQ\tSN:chr1\tLN:100"]
    assert [r.value for r in lines.collect()] == ["q1\t65\tchr1\t10\t60\t2M1S\t=\t20\t7\tACG\t?@A\tNM:i:3\tXS:Z:abc\tZB:B:s,-1,5\tFF:f:1.5"]


def blocked(data, sizes):
    """data as blocks, each with its size in its head, and the empty block at the end."""
    out, at, k = b"", 0, 0
    while True:
        part = data[at : at + sizes[k % len(sizes)]]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = z.compress(part) + z.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25)
        out += head + raw + struct.pack("<II", zlib.crc32(part), len(part))
        if not part:
            return out
        at, k = at + len(part), k + 1


def many_records(n):
    text = b"@SQ\tSN:chr1\tLN:100000\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 100_000)
    for i in range(n):
        name = b"read%d\0" % i
        seq = 4 + 97 * (i % 11) + (40_000 if i == n // 2 else 0)
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 60, 0, 1, 65, seq, -1, -1, 0) + name + struct.pack("<I", seq << 4)
        body += bytes([0x12]) * ((seq + 1) // 2) + bytes([30]) * seq
        data += struct.pack("<i", len(body)) + body
    return data


@pytest.mark.parametrize("step", [300, 5000, 10**6])
def test_ranges_of_a_bam_file_give_each_record_once(spark, tmp_path, step):
    (tmp_path / "x.bam").write_bytes(blocked(many_records(400), [700, 65, 3000, 20000]))
    lines, top = bam.read_bam(spark, str(tmp_path / "x.bam"), step)
    assert top == ["@SQ\tSN:chr1\tLN:100000"]
    assert [r.value.split("\t")[0] for r in lines.orderBy("_ord").collect()] == [f"read{i}" for i in range(400)]


def test_streams(spark, pairs_file, tmp_path, frame):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(pairs_file, tmp_path / "in/a.pairs")
    rows = pairs_stream.read_pairs_stream(spark, str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    counts = drain(pairs_stream.running_counts(rows), "counts", "complete")
    assert {r.pair_type: r.total for r in counts.collect()} == {"UU": 2, "NU": 1, None: 1, "WW": 1}
    timed = rows.withColumn("at", F.timestamp_seconds(F.col("pos1")))
    assert drain(pairs_stream.drop_exact_copies(timed, "at"), "copies", "append").count() == 3
    drain(pairs_stream.contacts_by_time(timed, "at"), "times", "append")
    batch = pairs_text.read_pairs(spark, pairs_file).df.filter("readID <> '#odd'")
    want = stats.PairStats(batch).counts().filter("key = 'cis'").first().value
    assert counts.agg(F.sum("cis")).first()[0] == want


# --- pipes ---------------------------------------------------------------------------------------


class Pipe:
    def __init__(self, data=b""):
        import io

        self.buffer = io.BytesIO(data)

    def flush(self):
        pass


def through(spark, monkeypatch, data, *args):
    import sys

    out = Pipe()
    monkeypatch.setattr(sys, "stdin", Pipe(data))
    monkeypatch.setattr(sys, "stdout", out)
    run(spark, *args)
    monkeypatch.undo()
    return out.buffer.getvalue()


def test_standard_input_and_output(spark, pairs_file, tmp_path, monkeypatch):
    raw = open(pairs_file, "rb").read()
    out = through(spark, monkeypatch, raw, "select", "pos1 > 5").decode().splitlines()
    assert [x.split("\t")[0] for x in out if not x.startswith(("##", "#s", "#g", "#c"))] == ['q"1', "c", "d"]
    assert any("CL:contactloom select 'pos1 > 5'" in x for x in out)
    again = through(spark, monkeypatch, gzip.compress(raw), "sort", "-", "-o", "-").decode().splitlines()
    assert [x.split("\t")[0] for x in again if not x.startswith(("##", "#s", "#g", "#c"))] == ["e", "b", 'q"1', "c", "d", "#odd"]
    assert b"total\t6\n" in through(spark, monkeypatch, raw, "stats")
    run(spark, "sort", pairs_file, "-o", str(tmp_path / "x.pairs"), "--cmd-in", "cat", "--cmd-out", "tr a-z A-Z")
    assert "B\t!\t0\tCHR1" in (tmp_path / "x.pairs").read_text()
    run(spark, "sort", pairs_file, "-o", str(tmp_path / "x.pairs.bz2"))
    run(spark, "select", "True", str(tmp_path / "x.pairs.bz2"), "-o", str(tmp_path / "y.pairs"))
    assert len(body(str(tmp_path / "y.pairs"))) == 6


def test_headers_of_sinks(spark, pairs_file, tmp_path):
    for to, want in (("dedup", (True, False, True)), ("dups", (False, True, True)), ("both", (True, True, True)), ("none", (False, False, True))):
        names = [str(tmp_path / f"{to}{k}.pairs") for k in range(3)]
        run(spark, "dedup", pairs_file, "-o", names[0], "--output-dups", names[1], "--output-unmapped", names[2], "--send-header-to", to)
        assert tuple(open(n).read().startswith("##") for n in names) == want
    joined = str(tmp_path / "joined.pairs")
    run(spark, "dedup", pairs_file, "-o", joined, "--output-dups", "-", "--output-unmapped", "-")
    assert len(body(joined)) == 6


def test_merged_statistics(spark, pairs_file, tmp_path):
    one, two, both = (str(tmp_path / n) for n in ("1.tsv", "2.tsv", "both.tsv"))
    run(spark, "stats", pairs_file, "-o", one)
    text = open(one).read()
    assert "chromsizes/chr1\t200\n" in text and "summary/complexity_naive\t" in text and "summary/dist_freq_convergence/convergence_dist\t" in text
    run(spark, "stats", "--merge", one, one, "-o", both)
    got = dict(x.split("\t") for x in open(both).read().splitlines())
    alone = dict(x.split("\t") for x in text.splitlines())
    assert got["chromsizes/chr1"] == "200" and got["total"] == "12" and got["summary/frac_cis"] == alone["summary/frac_cis"] and set(got) == set(alone)
    (tmp_path / "2.tsv").write_text(text.replace("chromsizes/chr1\t200", "chromsizes/chr1\t201"))
    with pytest.raises(ValueError):
        run(spark, "stats", "--merge", one, two, "-o", both)
    run(spark, "stats", "--no-chromsizes", pairs_file, "-o", two)
    assert "chromsizes" not in open(two).read()
    run(spark, "stats", "--merge", one, two, "-o", both)
    assert "chromsizes/chr2\t100\n" in open(both).read()
    for n in (one, two):
        run(spark, "stats", pairs_file, "-o", n.replace("tsv", "yml"), "--yaml")
    run(spark, "stats", "--merge", "--yaml", one.replace("tsv", "yml"), two.replace("tsv", "yml"), "-o", both)
    assert stats_text.read_stats_yaml(spark, both).filter("key = 'total'").first().value == 12


def test_other_column_names_in_coverage(spark, pairs_file, tmp_path):
    names = str(tmp_path / "n.pairs")
    run(spark, "header", "set-columns", pairs_file, "-o", names, "--columns", "r,a,b,c,d,e,f,g")
    low, high = str(tmp_path / "l.pairs"), str(tmp_path / "h.pairs")
    run(spark, "filterbycov", names, "--c1", "a", "--p1", "b", "--c2", "3", "--p2", "d", "--max-cov", "1", "-o", low, "--output-highcov", high)
    assert len(body(low)) + len(body(high)) == 4


def test_parsed_alignments_as_lines(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:chr1\tLN:1000\nq\t65\tchr1\t10\t60\t25M25S\t*\t0\t0\t*\t*\nq\t2113\tchr1\t300\t60\t25S25M\t*\t0\t0\t*\t*\nq\t129\tchr1\t500\t60\t50M\t*\t0\t0\t*\t*\n")
    (tmp_path / "sizes").write_text("chr1\t1000\n")
    run(spark, "parse", tmp_path / "x.sam", "-c", tmp_path / "sizes", "-o", tmp_path / "o.pairs", "--output-parsed-alignments", tmp_path / "a.txt")
    assert (tmp_path / "a.txt").read_text().splitlines() == [
        "q\t1\tchr1\t10\t+\t60\t25M25S\t0\t25\t25\tchr1\t300\t+\t60\t25S25M\t25\t50\t25\t", "q\t2\tchr1\t500\t+\t60\t50M\t0\t50\t50\t",
    ]
