"""Readers on small files written here."""

import gzip
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions.sequence import parse_region, regions_frame
from readloom.operators.context import extract_seq_context, tiles
from readloom.plans import queries
from readloom.sources import external, modbam, sinks, tables


def bgzf(data, size=60):
    """Small blocks, so that records span them, and the empty block at the end."""
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, flag, pos, cigar, seq, quality, tags, ref=0):
    ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in cigar]
    packed = bytes(modbam.LETTERS.index(a) << 4 | (modbam.LETTERS.index(b) if b else 0) for a, b in zip(seq[::2], [*seq[1::2], *[""] * (len(seq) % 2)]))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + bytes(quality) + tags
    return struct.pack("<i", len(body)) + body


def mods(mm, ml, qs=None):
    out = b"MMZ" + mm.encode() + b"\0" + b"MLBC" + struct.pack("<i", len(ml)) + bytes(ml)
    return out + (b"qsf" + struct.pack("<f", qs) if qs is not None else b"")


def write_bam(path, records, index=True, cut=0):
    header = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, length in (("chr1", 10_000_000), ("chr2", 5000)):
        header += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    data = bgzf(header + b"".join(records))
    with open(path, "wb") as f:
        f.write(data[: len(data) - cut])
    if index:
        with open(f"{path}.bai", "wb") as f:
            f.write(b"BAI\1" + struct.pack("<i", 2) + struct.pack("<ii", 0, 0) * 2)


ONE = [("8", "M"), ("1", "D"), ("3", "M"), ("2", "I"), ("8", "M")]
TWO = [("12", "M"), ("1", "I"), ("12", "M")]
READS = [
    record("artificial-read-1", 0, 6940000, ONE, "ACCCCCCACCACCCCACCCAC", [13] * 20 + [23], mods("A+a,0,0,1,0;", [34, 97, 185, 255])),
    record("artificial-read-2", 16, 6940000, TWO, "GGGTGGGGGTGGGGGGGTGGGGGGG", [13] * 24 + [19], mods("A+a,2;", [81])),
]
GOLDEN = [
    ("artificial-read-1", 0, 6940000, "+", "a", 0.134765625), ("artificial-read-1", 7, 6940007, "+", "a", 0.380859375), ("artificial-read-1", 10, 6940011, "+", "-", -1.0),
    ("artificial-read-1", 15, 6940014, "+", "a", 0.724609375), ("artificial-read-1", 19, 6940018, "+", "a", 0.998046875), ("artificial-read-2", 21, 6940003, "-", "a", 0.318359375),
    ("artificial-read-2", 15, 6940009, "-", "-", -1.0), ("artificial-read-2", 7, 6940016, "-", "-", -1.0),
]


def rows_of(path, modbase="a", regions=None):
    with modbam.opened(str(path)) as f:
        return [tuple(r.values()) for batch in modbam.decode(f, modbase, regions) for r in batch.to_pylist()]


def test_decoded_records(tmp_path):
    write_bam(tmp_path / "a.bam", READS)
    found = rows_of(tmp_path / "a.bam")
    assert sorted((r[0], r[2], r[3], r[5], r[6], r[8]) for r in found) == sorted(GOLDEN)
    assert {(r[0], round(r[1], 10), r[4], r[7]) for r in found} == {("artificial-read-1", round(283 / 21, 10), "chr1", "A"), ("artificial-read-2", 13.24, "chr1", "A")}
    assert rows_of(tmp_path / "a.bam", "m") == []


def test_explicit_tags_other_codes_and_qscore(tmp_path):
    tags = [mods("A+a?,0;", [10], 7.5), mods("C+mh,0;C+m,1;", [10, 20, 30]), mods("C+h,0;", [9]), mods("C+m,0;C+h,0;", [200, 3])]
    write_bam(tmp_path / "a.bam", [record(f"r{i}", 0, 10, [("4", "M")], "ACCA", [20] * 4, t) for i, t in enumerate(tags)])
    assert [(r[1], r[3], r[6], r[8]) for r in rows_of(tmp_path / "a.bam")] == [(7.5, 10, "a", 10.5 / 256)]
    found = [(r[0], r[3], r[6]) for r in rows_of(tmp_path / "a.bam", "m")]
    assert found == [("r1", 11, "m"), ("r1", 12, "m"), ("r3", 11, "m"), ("r3", 12, "-")]


def test_experiment_from_bam(spark, tmp_path):
    far = record("far", 0, 100, [("3", "M")], "AAC", [9] * 3, mods("A+a,0;", [128]), ref=1)
    write_bam(tmp_path / "a.bam", [*READS, far])
    whole = modbam.read_modbam(spark, {"s": str(tmp_path / "a.bam")}, None, "a")
    assert whole.calls.count() == 10 and whole.positions.count() == 10
    assert {(r.read_id, r.read_ord) for r in whole.reads.collect()} == {("artificial-read-1", 1), ("artificial-read-2", 2), ("far", 3)}
    assert whole.calls.where("mod_prob < 0").isEmpty() and whole.calls.agg(F.min("pos")).first()[0] == 101
    whole.validate()
    twice = modbam.read_modbam(spark, {"s": str(tmp_path / "a.bam")}, ["chr1:6940018-6940020", "chr1:6940019-6940021"], "a")
    assert twice.calls.count() == 8  # whole reads, each once
    none = modbam.read_modbam(spark, {"s": str(tmp_path / "a.bam")}, ["chr1:1-1000"], "a")
    assert none.calls.count() == 0 and [r.n_reads for r in none.samples.collect()] == [0]


def test_bam_errors(tmp_path, spark):
    write_bam(tmp_path / "cut.bam", READS, cut=60)
    with pytest.raises(OSError, match="truncated"):
        rows_of(tmp_path / "cut.bam")
    for bad in (mods("A+a,9;", [1]), mods("A+a,0;A+a,0;A+a,0;A+a,0;A+a,0;A+a,0;", [1] * 6)):
        write_bam(tmp_path / "bad.bam", [record("r", 0, 5, [("2", "M")], "AA", [1, 1], bad)])
        with pytest.raises(ValueError):
            rows_of(tmp_path / "bad.bam")
    write_bam(tmp_path / "plain.bam", READS, index=False)
    reader = lambda **o: modbam.ModBamReader({"modbase": "a", **o}).partitions()
    assert len(reader(path=str(tmp_path / "plain.bam"))) == 1
    for path, regions in (("plain.bam", '[["chr1", 1, 2]]'), ("none.bam", None)):
        with pytest.raises(FileNotFoundError):
            reader(path=str(tmp_path / path), regions=regions)
    write_bam(tmp_path / "a.bam", READS)
    with pytest.raises(ValueError, match="no sequence"):
        reader(path=str(tmp_path / "a.bam"), regions='[["chrX", 1, 2]]')
    with pytest.raises(ValueError):
        modbam.read_modbam(spark, str(tmp_path / "a.bam"), None, "Z")


def test_a_region_reads_to_its_end_only(tmp_path):
    broken = struct.pack("<i", 40) + struct.pack("<ii", 0, 7_000_000) + b"no record at all" * 2
    later = record("later", 0, 6940010, [("3", "M")], "AAC", [9] * 3, mods("A+a,0;", [128]))
    write_bam(tmp_path / "a.bam", [*READS, later, broken])
    regions = [("chr1", 6940001, 6940011)]
    with modbam.opened(str(tmp_path / "a.bam")) as f:
        found = [row["read_id"] for batch in modbam.decode(f, "a", regions, in_order=True) for row in batch.to_pylist()]
    assert set(found) == {"artificial-read-1", "artificial-read-2", "later"} and len(found) == 8 + 2
    with modbam.opened(str(tmp_path / "a.bam")) as f:
        assert [b.num_rows for b in modbam.decode(f, "a", [("chr1", 1, 6940000)], in_order=True)] == []


def bed_line(chrom, start, code, strand, valid, mod):
    return "\t".join(map(str, [chrom, start, start + 1, code, valid, strand, start, start + 1, "0,0,0", valid, 50.0, mod, valid - mod, 0, 0, 0, 0, 0]))


def test_bedmethyl(spark, tmp_path):
    first = [bed_line("chr1", 5, "m", "+", 10, 4), bed_line("chr1", 5, "h", "+", 10, 1), bed_line("chr1", 9, "m", "-", 3, 3)]
    second = [bed_line("chr1", 9, "m", "-", 7, 1), bed_line("chr2", 0, "m", "+", 2, 0)]
    with gzip.open(tmp_path / "a.bed.gz", "wt") as f:
        f.write("\n".join(first) + "\n")
    (tmp_path / "b.bed").write_text("\n".join(second) + "\n")
    files = [str(tmp_path / "a.bed.gz"), str(tmp_path / "b.bed")]
    found = tables.read_bedmethyl(spark, files)
    rows = {(r.sample, r.chrom, r.pos, r.strand): (r.n_mod, r.n_valid) for r in found.pileup.collect()}
    assert rows == {("s1", "chr1", 6, "+"): (1, 10), ("s1", "chr1", 10, "-"): (3, 3), ("s2", "chr1", 10, "-"): (1, 7), ("s2", "chr2", 1, "+"): (0, 2)}
    assert found.positions.count() == 3 and found.dense_pileup().count() == 6
    same = tables.read_bedmethyl(spark, [("x", files[0]), ("x", files[1])], modbase="m")
    assert {(r.pos, r.n_mod, r.n_valid) for r in same.pileup.collect()} == {(6, 4, 10), (10, 4, 10), (1, 0, 2)} and same.samples.first().n_files == 2
    assert tables.read_bedmethyl(spark, files, modbase="x").pileup.count() == 0
    assert tables.read_bedmethyl(spark, files[0], nrows=1).pileup.count() == 1
    with pytest.raises(ValueError, match="seqinfo"):
        tables.read_bedmethyl(spark, files, seqinfo={"chr1": 100})
    with pytest.raises(ValueError):
        tables.read_bedmethyl(spark, files, nrows=0)


HEADER = "read_id\tforward_read_position\tref_position\tchrom\tref_strand\tcall_prob\tcall_code\tfail\n"


def test_modkit_extract(spark, tmp_path):
    lines = [("r2", 5, "+", 0.9, "m", "false"), ("r1", 5, "+", 1.0, "-", "false"), ("r1", 7, "+", 0.6, "-", "true"), ("r1", 8, "+", 0.8, "h", "false"), ("r2", -1, "-", 0.7, "m", "true"), ("r1", 5, "+", 0.25, "m", "false")]
    (tmp_path / "a.tsv").write_text(HEADER + "".join(f"{r}\t0\t{p}\tchr1\t{s}\t{x}\t{c}\t{f}\n" for r, p, s, x, c, f in lines))
    path = str(tmp_path / "a.tsv")
    found = tables.read_modkit_extract(spark, path, "m")
    rows = {(r.read_id, r.pos): round(r.mod_prob, 6) for r in found.calls.collect()}
    assert rows == {("r2", 6): 0.9, ("r1", 6): 0.27, ("r1", 8): 0.4, ("r2", 0): 0.7}
    assert {r.call_code: r.value for r in found.thresholds.collect()} == {"m": 0.7, "-": 0.6}
    assert [(r.read_id, r.read_ord) for r in found.reads.orderBy("read_ord").collect()] == [("r2", 1), ("r1", 2)] and found.samples.first().n_reads == 2
    assert tables.read_modkit_extract(spark, path, "m", "modkit").calls.count() == 2
    strict = tables.read_modkit_extract(spark, path, "m", {"m": 0.7, "-": 0.5})
    assert {(r.read_id, r.pos) for r in strict.calls.collect()} == {("r2", 6), ("r1", 6), ("r1", 8)}
    assert {r.value for r in tables.read_modkit_extract(spark, path, "a").thresholds.where("call_code = 'a'").collect()} == {float("-inf")}
    for wrong in ({"m": 0.5}, "other"):
        with pytest.raises(ValueError):
            tables.read_modkit_extract(spark, path, "m", wrong)


def test_fasta_and_contexts(spark, tmp_path):
    seq = "".join("ACGGTTAC"[i * i % 8] for i in range(53))
    (tmp_path / "r.fa").write_text(f">chr1 first > one\n{seq[:20]}\n{seq[20:].lower()}\n>chr2\nACGT\n")
    reference = tables.read_fasta(spark, str(tmp_path / "r.fa"))
    assert {(r.chrom, r.seq) for r in reference.collect()} == {("chr1", seq), ("chr2", "ACGT")}
    rows = [("chr1", p, s) for p in range(1, 54) for s in "+-*"]
    turn = str.maketrans("ACGTN", "TGCAN")
    for width in (1, 7, 15):
        half = width // 2
        found = extract_seq_context(spark.createDataFrame(rows, "chrom string, pos int, strand string"), width, tiles(reference, 16), tile=16)
        for r in found.collect():
            pre, post = max(0, half - r.pos + 1), max(0, r.pos + half - 53)
            core = seq[r.pos - half + pre - 1 : r.pos + half - post]
            core = core.translate(turn)[::-1] if r.strand == "-" else core
            assert r.seq_context == "N" * pre + core + "N" * post
    with pytest.warns(UserWarning):
        assert len(extract_seq_context(spark.createDataFrame(rows[:1], "chrom string, pos int, strand string"), 6, tiles(reference)).first().seq_context) == 7
    wide = spark.createDataFrame([("chr1", 10, 12)], "chrom string, start int, end int")
    assert extract_seq_context(wide, 3, tiles(reference)).first().seq_context == seq[9:12]


def test_regions_and_external_tool(spark):
    assert parse_region("chr1:1200-1300") == ("chr1", 1200, 1300, "*") and parse_region("c:5:-") == ("c", 5, 5, "-")
    for wrong in ("chr1", "chr1:9-2", "", "chr1:a-b"):
        with pytest.raises(ValueError):
            parse_region(wrong)
    assert [r.region for r in regions_frame(spark, {"one": "chr1:1-2"}).collect()] == ["one"]
    assert external.modkit_version("/nowhere/modkit") is None
    assert external.extract_commands("mk", "a.bam", ["chr1:1-2"], "/t", 5)[0] == ["mk", "extract", "full", "--num-reads", "5", "--region", "chr1:1-2", "a.bam", "/t/0.tsv"]
    assert "--ignore-index" in external.extract_commands("mk", "a.bam", None, "/t", 5)[0]
    if not external.modkit_version():
        with pytest.raises(FileNotFoundError):
            external.modkit_extract(spark, "a.bam", os.devnull)


def test_external_extraction_runs_each_region(spark, tmp_path):
    tool = tmp_path / "modkit"
    tool.write_text('#!/bin/sh\nif [ "$1" = --version ]; then echo 0.1; exit; fi\nfor last; do :; done\nprintf "read_id\\tregion\\nsame\\t-\\nown\\t$4\\n" > "$last"\n')
    tool.chmod(0o755)
    found = external.modkit_extract(spark, "a.bam", str(tmp_path / "out"), ["chr1:1-5", "chr1:4-9", "chr2:1-2"], modkit=str(tool))
    assert {tuple(r) for r in found.collect()} == {("same", "-"), ("own", "chr1:1-9"), ("own", "chr2:1-2")} and found.count() == 3


def test_only_reads_in_several_records_are_summed(spark, tmp_path):
    """all calls were shuffled by read and position, to be summed."""
    plan = lambda e: e.calls._jdf.queryExecution().executedPlan().toString()
    write_bam(tmp_path / "a.bam", READS)
    assert "Exchange" not in plan(modbam.read_modbam(spark, {"s": str(tmp_path / "a.bam")}, None, "a"))
    again = record("artificial-read-1", 256, 6940000, [("1", "M")], "A", [9], mods("A+a?,0;", [34]))
    twice = record("calls-twice", 0, 6940000, [("2", "M")], "AC", [9, 9], mods("A+a?,0;A+a?,0;", [128, 64]))
    write_bam(tmp_path / "b.bam", [*READS, again, twice])
    found = modbam.read_modbam(spark, {"s": str(tmp_path / "b.bam")}, None, "a")
    rows = {(r.read_id, r.pos): r.mod_prob for r in found.calls.collect()}
    assert len(rows) == found.calls.count() == len(GOLDEN) + 1
    assert rows["artificial-read-1", 6940001] == 2 * 0.134765625 and rows["calls-twice", 6940001] == 193 / 256 and rows["artificial-read-1", 6940008] == 0.380859375


def written_calls(spark, n=40, span=50_000):
    rows = [(s, f"{s}-{k}", "chr1", 1 + k * 997 + j * span // 9, "+-"[k % 2], (k * 31 + j) % 256) for s in "AB" for k in range(n) for j in range(10)]
    return spark.createDataFrame(rows, "sample string, read_id string, chrom string, pos int, strand string, quality int"), rows


def test_bam_parts_hold_one_block(tmp_path):
    """a task held all records of a sample, and their compressed bytes."""
    part = sinks.BgzfPart(open(tmp_path / "p", "wb"))  # noqa: SIM115
    for k in range(50):
        one = sinks.modbam_record(f"r{k}", 0, k * 1000, False, np.array([0, 9000]), np.array([1, 2]))
        part.write(one, 0, k * 1000, k * 1000 + 9001)
        assert len(part.held) < sinks.BLOCK_BYTES
    part.close()
    assert part.n == 50 and part.size == (tmp_path / "p").stat().st_size > 0


def test_bam_files_are_written_by_several_tasks(spark, tmp_path):
    calls, rows = written_calls(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_modbam(calls, str(tmp_path / "bam"), {"chr1": 100_000})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in (tmp_path / "bam").iterdir() if not p.name.startswith(".")) == ["A.bam", "A.bam.bai", "B.bam", "B.bam.bai"]
    found = modbam.read_modbam(spark, {s: str(tmp_path / "bam" / f"{s}.bam") for s in "AB"}, None, "a")
    assert {tuple(r) for r in found.calls.collect()} == {(s, r, c, p, t, (q + 0.5) / 256) for s, r, c, p, t, q in rows}
    with modbam.opened(str(tmp_path / "bam" / "A.bam")) as f:
        names = [r["read_id"] for b in modbam.decode(f, "a", what="reads") for r in b.to_pylist()]
    assert names == [f"A-{k}" for k in range(40)]


def test_written_bam_has_windows_that_a_region_begins_at(spark, tmp_path):
    """the index had no windows, so that a region read the file from its first record, in one task."""
    calls, rows = written_calls(spark, 300, 9000)
    sinks.write_modbam(calls, str(tmp_path / "bam"), {"chr1": 400_000})
    path = str(tmp_path / "bam" / "A.bam")
    windows = modbam.read_index(path + ".bai")[0]
    assert len(windows) == (max(r[3] for r in rows) - 1 >> 14) + 1 and all(windows)
    reader = modbam.ModBamReader({"path": path, "modbase": "a", "regions": '[["chr1", 150000, 150010]]'})
    assert reader.partitions()[0].start == windows[149_999 >> 14] > windows[0]
    found = modbam.read_modbam(spark, {"A": path}, ["chr1:150000-150010"], "a")
    inside = {r[1] for r in rows if r[0] == "A" and min(x[3] for x in rows if x[:2] == r[:2]) <= 150_010 and max(x[3] for x in rows if x[:2] == r[:2]) >= 150_000}
    assert {r.read_id for r in found.reads.collect()} == inside and found.calls.count() == 10 * len(inside)


def test_reads_come_a_row_a_record(spark, tmp_path):
    """reads were numbered from all their calls."""
    write_bam(tmp_path / "a.bam", READS)
    with modbam.opened(str(tmp_path / "a.bam")) as f:
        assert [b.num_rows for b in modbam.decode(f, "a", what="reads")] == [2]
    found = modbam.read_modbam(spark, {"s": str(tmp_path / "a.bam")}, None, "a").reads
    assert {(r.read_id, r.read_ord, r.qscore) for r in found.collect()} == {("artificial-read-1", 1, (13 * 20 + 23) / 21), ("artificial-read-2", 2, (13 * 24 + 19) / 25)}


def test_calls_of_bam_files_are_computed_once(spark, tmp_path, monkeypatch):
    """F2, F4 of round 3: the calls were made again for the length of the sequence and for the samples."""
    calls, rows = written_calls(spark, 30, 900)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(queries.views, "view", lambda *_, **__: calls.selectExpr("sample", "read_id", "chrom", "pos", "strand", "(quality + 0.5e0) / 256e0 AS mod_prob").mapInArrow(counted, "sample string, read_id string, chrom string, pos int, strand string, mod_prob double"))
    monkeypatch.setattr(queries, "new_path", lambda _, name: str(tmp_path / name))
    files = queries.bam_files(spark, "", "?")
    assert made.value == len(rows) and sorted(files) == sorted({r[0] for r in rows})
    for sample, path in files.items():
        with modbam.opened(path) as f:
            assert modbam.read_header(modbam.Bgzf(f)) == [("chr1", max(r[3] for r in rows if r[0] == sample))]


def test_calls_of_a_read_are_shuffled_once(spark):
    """F2, F4 of round 3: calls were shuffled by their positions and again by their reads."""
    calls = queries.views.view(spark, "/root/testdata/sf0.001", queries.views.CALLS, by=queries.views.CALLS_READ)
    reads = calls.groupBy("sample", "read_id", "chrom", "strand").agg(F.collect_list("pos"))
    assert reads._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_positions_of_some_bases_of_a_record():
    """As all of them: clipped, inserted and deleted bases, and a record with one operation."""
    cigar = np.array([n << 4 | "MIDNSHP=X".index(o) for n, o in ((3, "H"), (2, "S"), (4, "M"), (1, "I"), (2, "D"), (3, "="), (5, "N"), (2, "X"), (1, "S"))], dtype="<u4")
    at = np.array([0, 1, 2, 5, 6, 7, 9, 10, 11, 12, 13])
    assert modbam.reference_positions(cigar, 100, at).tolist() == [-1, -1, 100, 103, -1, 106, 108, 114, 115, -1, -1]
    assert modbam.reference_positions(cigar[2:3], 7, np.array([0, 3, 4])).tolist() == [7, 10, -1]
