"""Readers and writers on small files, and the simulator's tables against each other."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import cohort, isoforms, segments, simulate
from strandline.sources import bam, text


def test_sam(spark, tmp_path):
    rows = ["@HD\tVN:1.6", *("\t".join([f"r{k // 2}", str(65 + 64 * (k % 2)), "chr1", str(100 + k), "60", "10M", "*", "0", "0", "ACGTACGTAC", "IIIIIIIIII", "NM:i:0", "XA:Z:chr2,+5,10M,0;"]) for k in range(40))]
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    found = text.read_sam(spark, str(tmp_path / "a.sam")).orderBy("file_ord").collect()
    assert [r.pos for r in found] == [100 + k for k in range(40)] and {r.xa for r in found} == {"chr2,+5,10M,0;"}
    assert not bam.is_bam(str(tmp_path / "a.sam"))
    (tmp_path / "bad.sam").write_text("r1\t0\tchr1\n")
    with pytest.raises(Exception, match="no SAM record"):
        text.read_sam(spark, str(tmp_path / "bad.sam")).collect()


def write_bam(path, records, header="@HD\tVN:1.6\tSO:queryname\n", names=("chr1", "chr2"), block=300):
    data = b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", len(names))
    for n in names:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, mapq, ops, seq in records:
        packed = bytes((bam.BASES.index(a) << 4) | bam.BASES.index(b) for a, b in zip(seq[::2], (seq[1::2] + "=")[: len(seq[::2])], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for n, op in ops) + packed + b"\xff" * len(seq) + b"NMC\x01XAZchr2,+1,5M,0;\0"
        data += struct.pack("<i", len(body)) + body
    with open(path, "wb") as f:
        for at in [*range(0, len(data), block), None]:
            chunk = b"" if at is None else data[at : at + block]
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = c.compress(chunk) + c.flush()
            f.write(bam.MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(chunk), len(chunk)))


@pytest.mark.parametrize("shard", [1 << 22, 700])
def test_bam(spark, tmp_path, shard):
    rng = random.Random(5)
    records = [(f"read{k // 2}", 65 + 64 * (k % 2), k % 2, 10 + k, 60, [(5, "S"), (20 + k % 3, "M")], "".join(rng.choice("ACGTN") for _ in range(25 + k % 3))) for k in range(200)]
    path = str(tmp_path / "a.bam")
    write_bam(path, records)
    assert bam.is_bam(path)
    found = bam.read_bam(spark, path, shard).orderBy("file_ord").collect()
    assert [(r.read_id, r.flag, r.chrom, r.pos, r.mapq, r.cigar, r.seq, r.xa) for r in found] == [(n, f, ("chr1", "chr2")[ref], p, q, "".join(f"{x}{o}" for x, o in ops), s, "chr2,+1,5M,0;") for n, f, ref, p, q, ops, s in records]
    write_bam(path, records[:2], "@HD\tVN:1.6\tSO:coordinate\n")
    with pytest.raises(Exception, match="sorted by coordinate"):
        bam.read_bam(spark, path).collect()


def test_reference_annotation_catalog(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 test\nATGC\natgc\n>chr2\nGGGGCCCC\n")
    reference = text.read_fasta(spark, str(tmp_path / "r.fa"))
    assert {(r.chrom, r.length, r.seq) for r in reference.collect()} == {("chr1", 8, "ATGCATGC"), ("chr2", 8, "GGGGCCCC")}
    assert {(r.chrom, r.chunk, r.n, r.seq) for r in text.reference_chunks(reference, 5).collect()} == {("chr1", 0, 8, "ATGCA"), ("chr1", 1, 8, "TGC"), ("chr2", 0, 8, "GGGGC"), ("chr2", 1, 8, "CCC")}
    (tmp_path / "a.gtf").write_text('# x\nchr1\ts\texon\t100\t200\t.\t+\t.\tgene_id "G1";\nchr1\ts\tgene\t1\t900\t.\t+\t.\tgene_id "G1";\n')
    assert [(r.chrom, r.gene_id, r.transcript_id, r.start, r.end) for r in text.read_gtf(spark, str(tmp_path / "a.gtf")).collect()] == [("chr1", "G1", None, 100, 200)]
    (tmp_path / "c.bed").write_text("track x\n#c\nchr1\t9\t20\tn\t5\t+\nchr1\t9\t20\tm\t7\t+\nchr1\t9\t20\tm\t7\t.\n")
    assert {tuple(r) for r in text.read_bed6(spark, str(tmp_path / "c.bed")).collect()} == {("chr1", 10, 20, "+"), ("chr1", 10, 20, "NA")}
    (tmp_path / "bad.bed").write_text("chr1\t9\t5\tn\t5\t+\n")
    with pytest.raises(Exception, match="no catalog line"):
        text.read_bed6(spark, str(tmp_path / "bad.bed")).collect()


def test_results_and_cohort_files(spark, tmp_path):
    line = "\t".join(["chr1:10|20", "chr1", "10", "20", "{}", "1_0_0", "0", "1.00", "exon", "g", "{}", "r1", "1"])
    for folder, reads in (("x", 3), ("y", 2000)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.out").write_text("\t".join(text.RESULT_COLUMNS) + "\n" + line.format(reads, "+") + "\n\n")
    rows = text.read_results(spark, [str(tmp_path / f / "s.out") for f in "xy"])
    assert {(r.sample, r.reads) for r in rows.collect()} == {("s", 3), ("s_2", 2000)}
    text.write_bed6(cohort.catalog_rows(cohort.merge_samples(rows)), str(tmp_path / "out"))
    assert {tuple(r) for r in text.read_bed6(spark, str(tmp_path / "out")).collect()} == {("chr1", 10, 20, "+")}
    (tmp_path / "n.out").write_text(line.format(-1, "+"))
    with pytest.raises(Exception, match="no result line"):
        text.read_results(spark, [str(tmp_path / "n.out")]).collect()
    (tmp_path / "m.txt").write_text("a p1\nb p2\n")
    assert text.read_manifest(spark, str(tmp_path / "m.txt")) == [("a", "p1"), ("b", "p2")]


def test_review_track(spark):
    table = spark.createDataFrame([("r1", "bsj", "c", "chr1", "10-20:+|31-40:+|<bsj>|5-9:+", None), ("r2", "other", "c", "chr1", "1-2:+", None)], "read_id string, type string, circ_id string, chrom string, r1_segments string, r2_segments string")
    rows = segments.review_rows(table).orderBy("qname").collect()
    assert [(r.qname, r.pos, r.cigar, r.mapq, len(r.seq)) for r in rows] == [("r1|bsj|c|R1|part1", 10, "11M10N10M", 60, 21), ("r1|bsj|c|R1|part2", 5, "5M", 60, 5)]
    assert [(r.chrom, r.length) for r in segments.track_lengths(segments.review_rows(table), spark.createDataFrame([("chr1", 30)], "chrom string, length int")).collect()] == [("chr1", 40)]


def test_simulation(spark):
    reference = "ACGT" * 5000
    exons = [("chrT", f"g{i}", f"t{i}", 100 + 1200 * i + 150 * k, 219 + 1200 * i + 150 * k, "+-"[i % 2], 5 * i + k) for i in range(12) for k in range(5)]
    table = spark.createDataFrame(exons, "chrom string, gene_id string, transcript_id string, start int, end int, strand string, line_no long")
    chunks = text.reference_chunks(spark.createDataFrame([("chrT", len(reference), reference)], "chrom string, length int, seq string"), 1000)
    conf = simulate.SimConf(circles=5, error_rate=0.0, coverage=3.0)
    isoforms_of = simulate.choose_circles(table, conf).cache()
    assert isoforms_of.select("circ_id").distinct().count() == 5 and isoforms_of.where(f"length < {conf.read_length}").count() == 0
    seqs = simulate.with_sequence(isoforms_of, chunks, 1000, ["isoform_id"]).cache()
    assert seqs.where("length(seq) <> length").count() == 0
    pairs = simulate.circular_pairs(seqs, conf).cache()
    assert pairs.where(f"length(r1) <> {conf.read_length} or length(r2) <> {conf.read_length}").count() == 0
    whole = {r.isoform_id: r.seq for r in seqs.collect()}
    for r in pairs.collect():
        assert r.r1 in whole[r.isoform_id] * 3 and (r.is_bsj == 1) == (r.r1_is_bsj + r.r2_is_bsj > 0)
    truth = simulate.isoform_truth(seqs, pairs, conf).agg(F.sum("read_cnt"), F.sum("bsj_read_cnt")).first()
    assert tuple(truth) == (pairs.count(), pairs.where("is_bsj = 1").count())
    assert simulate.usage_truth(pairs).groupBy("circ_id").agg(F.sum("usage").alias("u")).where("abs(u - 1) > 1e-9").count() == 0
    assert sorted(pairs.collect()) == sorted(simulate.circular_pairs(seqs.repartition(5), conf).collect())
    linear = simulate.transcripts(table).where("size(exons) = 5").withColumn("isoform_id", F.col("transcript_id"))
    fragments = simulate.linear_pairs(simulate.with_sequence(linear, chunks, 1000, ["isoform_id"]), conf)
    assert fragments.count() > 0 and fragments.where("start + insert > 600").count() == 0


def test_isoforms(spark):
    junctions = spark.createDataFrame([("j1", "chr1", 100, 500, "+", "g"), ("j2", "chr1", 9000, 9100, "+", "g")], "junction_id string, chrom string, start int, end int, strand string, gene_id string")
    exons = spark.createDataFrame([("chr1", 100, 200), ("chr1", 300, 350), ("chr1", 400, 500), ("chr1", 450, 700)], "chrom string, start int, end int")
    blocks = spark.createDataFrame([("r1", "j1", 150, 200), ("r1", "j1", 400, 420)], "read_id string, circ_id string, start int, end int")
    rows = {r.junction_id: r for r in isoforms.isoform_chains(junctions, exons, blocks).collect()}
    assert [tuple(e) for e in rows["j1"].exons] == [(100, 200), (400, 500)] and rows["j1"].evidence == "phased_junction"
    assert [tuple(e) for e in rows["j2"].exons] == [(9000, 9100)] and rows["j2"].type == "estimate"
    assert isoforms.gtf_lines(isoforms.isoform_chains(junctions, exons, blocks)).count() == 3
