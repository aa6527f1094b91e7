"""A small genome with one circle: what both scans find, how it is counted, and that partitions do not matter."""

import random

import pytest

from strandline.config import EngineConf
from strandline.operators import cohort
from strandline.plans.pipeline import cohort_catalog, detect_junctions, second_pass
from strandline.sources.text import reference_chunks

RC = str.maketrans("ACGT", "TGCA")
SITE1, SITE2 = 2001, 2600
COLUMNS = "read_id string, flag int, chrom string, pos int, mapq int, cigar string, seq string, file_ord long"


def genome() -> str:
    rng = random.Random(4)
    g = [rng.choice("ACGT") for _ in range(8000)]
    g[SITE1 - 3 : SITE1 - 1], g[SITE2 : SITE2 + 2] = "AG", "GT"
    return "".join(g)


def reads(g: str) -> list[tuple]:
    out = []

    def add(*row):
        out.append((*row, len(out)))

    for k, left in enumerate((45, 50, 55, 60)):
        seq = g[SITE2 - left : SITE2] + g[SITE1 - 1 : SITE1 - 1 + 100 - left]
        mate_at = SITE1 + 250
        mate = g[mate_at - 1 : mate_at + 99]
        add(f"split{k}", 65 + 32, "chr1", SITE2 - left + 1, 60, f"{left}M{100 - left}S", seq)
        add(f"split{k}", 65 + 32 + 2048, "chr1", SITE1, 60, f"{left}S{100 - left}M", seq)
        add(f"split{k}", 129 + 16, "chr1", mate_at, 60, "100M", mate)
    for k, left in enumerate((80, 78)):
        seq = g[SITE2 - left : SITE2] + g[SITE1 - 1 : SITE1 - 1 + 100 - left]
        mate_at = SITE1 + 200
        add(f"clip{k}", 65 + 32, "chr1", SITE2 - left + 1, 60, f"{left}M{100 - left}S", seq)
        add(f"clip{k}", 129 + 16, "chr1", mate_at, 60, "100M", g[mate_at - 1 : mate_at + 99])
    for k in range(3):
        at = SITE2 - 40 - k
        add(f"linear{k}", 65 + 32, "chr1", at, 60, "100M", g[at - 1 : at + 99])
        add(f"linear{k}", 129 + 16, "chr1", at + 200, 60, "100M", g[at + 199 : at + 299])
    return out


@pytest.fixture(scope="module")
def case(spark):
    g = genome()
    rows = reads(g)
    reference = spark.createDataFrame([("chr1", len(g), g)], "chrom string, length int, seq string")
    return g, rows, reference_chunks(reference, 1 << 10).cache()


CONF = EngineConf(min_span=100, max_span=5000, linear_range=1000)


def test_results(spark, case):
    _, rows, chunks = case
    found = detect_junctions(spark.createDataFrame(rows, COLUMNS), chunks, CONF, chunk=1 << 10)
    first = found.first.where("priority = 1").collect()
    assert {r.read_id for r in first} == {f"split{k}" for k in range(4)}
    assert {(r.chrom, r.site1, r.site2, r.strand, r.signal_left, r.signal_right, r.tag, r.q) for r in first} == {("chr1", SITE1, SITE2, "+", "AG", "GT", 1, 1)}
    second = found.second.where("priority = 1").collect()
    assert {(r.read_id, r.site1, r.site2, r.tag) for r in second} == {("clip0", SITE1, SITE2, 1), ("clip1", SITE1, SITE2, 1)}
    assert [(r.linear_reads) for r in found.linear.collect()] == [3]
    [result] = found.results.collect()
    assert (result.junction_id, result.junction_reads, result.linear_reads, result.ratio, result.score) == (f"chr1:{SITE1}|{SITE2}", 6, 3, 0.8, 4)
    assert result.read_ids == ",".join(sorted(["clip0", "clip1", *(f"split{k}" for k in range(4))]))
    assert [(r.start1, r.end2) for r in found.arcs.collect()] == [(SITE1 - 1, SITE2)]
    assert found.display.count() == found.first.count() + found.second.count()


def test_partitions_do_not_matter(spark, case):
    _, rows, chunks = case
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    one = detect_junctions(spark.createDataFrame(rows, COLUMNS).coalesce(1), chunks, CONF, chunk=1 << 10).results.collect()
    two = detect_junctions(spark.createDataFrame(shuffled, COLUMNS).repartition(7), chunks, CONF, chunk=1 << 10).results.collect()
    assert one == two


def test_second_pass_and_cohort(spark, case):
    _, rows, chunks = case
    clips = [r for r in rows if not r[0].startswith("split")]
    catalog = spark.createDataFrame([("chr1", SITE1, SITE2, "+")], "chrom string, start int, end int, strand string")
    found = second_pass(spark.createDataFrame(clips, COLUMNS), chunks, catalog, CONF, chunk=1 << 10)
    assert {r.read_id for r in found.second.where("priority = 1").collect()} <= {"clip0", "clip1"}
    whole = detect_junctions(spark.createDataFrame(rows, COLUMNS), chunks, CONF, chunk=1 << 10).results
    merged = cohort_catalog({"a": whole, "b": whole}).collect()
    assert [(r.chrom, r.start, r.end, r.strand, r.samples, r.reads, r.cohort_id) for r in merged] == [("chr1", SITE1, SITE2, "+", 2, 12, f"chr1:{SITE1}|{SITE2}:+")]
    assert [(r.start0, r.score) for r in cohort.catalog_rows(cohort_catalog({"a": whole})).collect()] == [(SITE1 - 1, 6)]


def test_no_circle_in_linear_reads(spark, case):
    _, rows, chunks = case
    linear = [r for r in rows if r[0].startswith("linear")]
    assert detect_junctions(spark.createDataFrame(linear, COLUMNS), chunks, CONF, chunk=1 << 10).results.collect() == []


def test_annotation(spark, case):
    _, rows, chunks = case
    exons = spark.createDataFrame([("chr1", "g1", "t1", SITE1, SITE1 + 200, "+", 1), ("chr1", "g1", "t1", SITE2 - 150, SITE2, "+", 2)], "chrom string, gene_id string, transcript_id string, start int, end int, strand string, line_no long")
    [result] = detect_junctions(spark.createDataFrame(rows, COLUMNS), chunks, CONF, exons, chunk=1 << 10).results.collect()
    assert (result.kind, result.gene_id) == ("exon", "g1")
