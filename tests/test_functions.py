"""Functions and kernels: fixed cases, and plain slow versions on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.config import EngineConf
from strandline.functions import cigar as C
from strandline.functions import kernels as K
from strandline.functions import keys, sequence
from strandline.operators import segments


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def slow_class(cigar, read_length, relaxed):
    """The classifier's rules, one after the other, on one string."""
    if cigar == "*":
        return (0, 0, 0, -1)
    parts = re.findall(r"(\d+)([MIDNSHP=X])", cigar)
    if not parts or "".join(n + op for n, op in parts) != cigar:
        return (0, 0, 0, -2)
    n, word = [int(x) for x, _ in parts], "".join(op for _, op in parts).replace("H", "S")
    under = sum(k for k, op in zip(n, word, strict=True) if op in ("MD=X" if relaxed else "MD"))
    ends = word[0] + word[-1]
    if len(word) == 1:
        return (0, 0, 0, read_length if word == "M" and (not relaxed or n[0] == read_length) else -1)
    if len(word) == 2:
        return {"MS": (1, n[0], n[0] - 1, n[0]), "SM": (-1, n[0], 0, n[1])}.get(word, (0, 0, 0, -2))
    if len(word) == 3:
        if ends == "SS" and (relaxed or word == "SMS"):
            return (10, n[0], n[2], n[1])
        return {"MDM": (0, 0, 0, read_length + n[1]), "MIM": (0, 0, 0, read_length - n[1])}.get(word, (0, 0, 0, -2))
    return {"MS": (1, read_length - n[-1], under - 1, under), "SM": (-1, n[0], 0, under), "MM": (0, 0, 0, under), "SS": (10, n[0], n[-1], under)}.get(ends, (0, 0, 0, -2))


def test_classifier_follows_the_rules(spark):
    rng = random.Random(5)
    cases = [(c, 90) for c in ("*", "", "M", "7", "9M4", "90M", "89M", "6H84M")]
    cases += [("".join(f"{rng.randrange(1, 60)}{rng.choice('MMMMSSHDIN=XP')}" for _ in range(rng.randrange(1, 7))), rng.randrange(50, 160)) for _ in range(400)]
    for relaxed in (False, True):
        got = values(spark, cases, "c string, n int", C.classify(F.col("c"), F.col("n"), relaxed=relaxed).alias("k"))
        assert [tuple(k) for (k,) in got] == [slow_class(c, n, relaxed) for c, n in cases]


def test_cigar_functions(spark):
    rows = [("5S10M3N20M2D4M6H", "A" * 39 + "CGTAC")]
    got = values(spark, rows, "c string, s string", C.reference_length(F.col("c")), C.query_length(F.col("c")), C.span_end(F.lit(100), F.col("c")), C.match_to_match_length(F.col("c")), C.shape_class(F.col("c")), C.clip_payload(F.col("c"), F.col("s")), C.spliced_cigar(C.match_blocks(F.lit(1), F.col("c"))))
    assert got == [(39, 39, 138, 36, "SMS", "L:AAAAA", "10M3N20M2N4M")]


def test_sequences_and_keys(spark):
    got = values(spark, [("ACGTNacgtn",)], "s string", sequence.reverse_complement(F.col("s")), sequence.strict_reverse_complement(F.col("s")), sequence.window(F.col("s"), F.lit(-2), F.lit(3)), sequence.window(F.col("s"), F.lit(8), F.lit(12)), sequence.between(F.col("s"), F.lit(8), F.lit(12)))
    assert got == [("nacgtNACGT", "NACGTNACGT", "NNACG", "tnNN", None)]
    assert values(spark, [("chr1\t10",), ("",)], "s string", keys.java_hash(F.col("s"))) == [(752734276,), (0,)]
    order = [r[0] for r in spark.createDataFrame([(c,) for c in ("GL1", "chrUn", "chrM", "chr10", "chr2", "chrX", "1")], "c string").orderBy(keys.result_order(F.col("c"))).collect()]
    assert order == ["chr2", "chr10", "chrX", "chrM", "chrUn", "1", "GL1"]
    assert values(spark, [(0, 0), (3, 4)], "j int, l int", keys.junction_ratio(F.col("j"), F.col("l"))) == [(0.0,), (0.6,)]
    assert values(spark, [('gene_id "g1"; transcript_id "t1";',), ("x",)], "a string", keys.quoted_attribute(F.col("a"), "transcript_id")) == [("t1",), (None,)]


def slow_outward(x, y, least=19):
    """Whether two records (flag, pos, mapq, cigar) face outward, from their spans and end clips."""
    if (x[0] ^ y[0]) & 16 == 0:
        return False
    left, right = (x, y) if x[0] & 16 else (y, x)  # the reverse record must lie left

    def span(r):
        parts = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSH])", r[3])]
        clips = [n if op in "SH" else 0 for n, op in (parts[0], parts[-1])]
        return r[1], r[1] + sum(n for n, op in parts if op in "MDN"), *clips

    (a1, b1, five1, three1), (a2, b2, five2, three2) = span(left), span(right)
    if (a1, b1) == (a2, b2):
        return min(three1, three2, three1 - five2, three2 - five1) >= least
    return a2 - a1 >= least and b2 - b1 >= least


def outward_reads(seed, n=300):
    """Reads of one record of each mate, and of some a supplementary one: at near places, so that many rules are met."""
    rng = random.Random(seed)
    cigar = lambda: rng.choice([f"{k}M" for k in (60, 61, 80)] + ["40M20S", "22S38M", "25S35M20S", "30M15D30M", "20M90N40M"])
    out = {}
    for i in range(n):
        at = rng.randrange(500, 600)
        mate = lambda bit: (1 + bit + rng.choice((0, 16)), at + rng.choice((0, 0, 18, 19, 20, 60, -18, -19, -60)), rng.choice((0, 9, 10, 60)), cigar())
        out[f"q{i}"] = [mate(64), mate(128)] + ([mate(rng.choice((64, 128)) + 2048)] if i % 3 == 0 else [])
    return out


def test_outward_pairs_follow_the_rules(spark):
    reads = outward_reads(9)
    rows = [(name, f, "chr2", p, q, c, "A" * 60, k) for name, records in reads.items() for k, (f, p, q, c) in enumerate(records)]
    table = spark.createDataFrame(rows, "read_id string, flag int, chrom string, pos int, mapq int, cigar string, seq string, file_ord long")
    conf = EngineConf()
    primary = {n for n, r in reads.items() if min(r[0][2], r[1][2]) >= conf.min_mapq and slow_outward(r[0], r[1])}
    crossed = {n: [(x, y) for x in r for y in r if x[0] & 64 and y[0] & 128 and slow_outward(x, y)] for n, r in reads.items()}
    assert {r.read_id for r in segments.outward_primary(table, conf).collect()} == primary
    for mode, mapped in (("relaxed", max), ("supplementary", min)):
        wanted = {n for n, found in crossed.items() if any(mapped(x[2], y[2]) >= conf.min_mapq for x, y in found)}
        assert len(wanted) > 10 and {r.read_id for r in segments.outward_any(table, EngineConf(outward_mode=mode)).collect()} == wanted
    assert len(primary) > 5
    assert segments.outward_any(table, EngineConf(outward_mode="primary")).count() == 0


def slow_alignment(a, b, match, mismatch, gap):
    score = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for r in range(1, len(b) + 1):
        for c in range(1, len(a) + 1):
            score[r][c] = max(0, score[r - 1][c - 1] + (match if b[r - 1] == a[c - 1] else mismatch), score[r - 1][c] + gap, score[r][c - 1] + gap)
    return max(map(max, score))


def test_local_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(30))) for _ in range(2))
        for gap in (-1, -3):
            assert K.local_alignment(a, b, 1, -1, gap)[0] == slow_alignment(a, b, 1, -1, gap)
    assert K.local_alignment("ACGTACGT", "ACGTACGT") == (8, 8) and K.local_alignment("", "A") == (0, 0)


def test_linear_competition():
    rng = random.Random(2)
    ring, rival = ("".join(rng.choice("ACGT") for _ in range(400)) for _ in range(2))
    part = ring[100:160]
    for from_right in (True, False):
        assert K.beats_linear(part, ring, rival, from_right)
        assert not K.beats_linear(part, ring, rival[:200] + part + rival[200:], from_right)
        assert not K.beats_linear(rival[50:110], ring, rival, from_right)
        assert not K.beats_linear("ACG", ring, rival, from_right)
    assert K.tail_fits(ring[10:60], ring) and K.tail_fits("ACGTA", ring) and not K.tail_fits(rival[:80], ring)
    assert K.mate_support(ring[50:150], 1, ring, rival) == 1
    assert K.mate_support(rival[50:150], 1, ring, rival) == -2
    assert K.mate_support("A" * 100, 0, ring, "") == -2 and K.mate_support("A" * 100, 1, ring, "") == -1 and K.mate_support("ACGTAC", 1, ring, "") == 1


def test_difference_strings():
    rng = random.Random(3)
    reference = "".join(rng.choice("ACGT") for _ in range(60))
    query = "TT" + reference[:10] + "GG" + reference[10:14] + ("A" if reference[14] != "A" else "C") + reference[15:20] + reference[23:30] + reference[50:60]
    cigar = "2S10M2I10M3D7M20N10M"
    text = K.difference_string(query, reference, cigar)
    assert K.difference_cigar(text) == cigar[2:]
    assert K.rebuilt_bases(text, reference) == query[2:]
    assert K.parse_difference("?") is None and K.difference_cigar(":5<gt10ag:5") is None
    assert K.clip_places("ACGTTGCATGCC", "GG" + "ACGTTGCATGCC" + "TT") == [(2, 0, 12)]
    assert K.clip_places("ACGT", "ACGT") == []


@pytest.mark.parametrize(("cigar", "side", "held"), [("100M", 150, True), ("100M", 110, False), ("50M200N50M", 150, True), ("50M200D50M", 151, False), ("10M200N90M", 110, False)])
def test_strong_side(cigar, side, held):
    assert K.strong_side(101, cigar, side, 19) == held
