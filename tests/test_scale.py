"""Steps that must share their work out, whatever the input's files are, and kernels that work on many rows at once."""

from dataclasses import replace

import pytest

from strandline.functions import kernels
from strandline.operators import simulate
from strandline.operators.simulate import SimConf


def test_reads_of_a_small_file_are_made_by_many_tasks(spark):
    rows = spark.createDataFrame([(f"t{k}", "ACGT" * 60) for k in range(40)], "transcript_id string, seq string").coalesce(1)
    made = simulate.linear_pairs(rows, SimConf(read_length=100))
    assert made.rdd.getNumPartitions() >= 4 and made.count() == 40 * 12


def test_errors_are_drawn_by_read_and_place(spark):
    conf = SimConf(read_length=100, error_rate=0.05)
    rows = spark.createDataFrame([(f"t{k}", "ACGTN" * 60) for k in range(60)], "transcript_id string, seq string")
    pair = lambda c: {r.read_id: (r.r1, r.r2) for r in simulate.linear_pairs(rows, c).collect()}
    clean, noisy = pair(replace(conf, error_rate=0.0)), pair(conf)
    assert noisy == pair(conf) and clean.keys() == noisy.keys()
    places = [(x, y) for k in clean for a, b in zip(clean[k], noisy[k], strict=True) for x, y in zip(a, b, strict=True)]
    changed = [(x, y) for x, y in places if x != y]
    assert len(changed) / len(places) == pytest.approx(0.05, rel=0.15)
    assert {y for _, y in changed} == set("ACGT") and {x for x, _ in changed} == set("ACGTN")
    alone = simulate.changed_bases(["ACGT" * 25], ["b"], "r1", 0.3, 1)
    assert simulate.changed_bases([None, "", "ACGT" * 25], ["a", "c", "b"], "r1", 0.3, 1) == [None, "", *alone]


def test_alignments_side_by_side_are_those_of_each_pair():
    import random

    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("ACGTN"[: draw.randint(1, 5)]) for _ in range(n))
    pairs = [(word(draw.randint(0, 30)), word(draw.randint(0, 30))) for _ in range(300)] + [(word(40), word(40)) for _ in range(300)] + [("acgt", "ACGT"), ("", "A")]
    for scores in ((1, -1, -1), (1, -1, -3), (2, 0, -1), (1, -1, -900)):
        assert kernels.local_alignments(pairs, *scores, most_cells=1 << 12) == [kernels.local_alignment(a, b, *scores) for a, b in pairs]


def test_alignments_side_by_side_are_quick():
    import time

    pairs = [("ACGTTGCA" * 5, "TTGCAACG" * 5)] * 5000
    began = time.process_time()
    kernels.local_alignments(pairs)
    assert time.process_time() - began < 2.5  # one by one: a table of Python steps for each


@pytest.mark.parametrize("most_hot", [100, 0])
def test_candidates_share_groups_and_hot_ones_are_dealt(spark, monkeypatch, most_hot):
    from strandline.operators import regions

    monkeypatch.setattr(regions, "ROWS_PER_PART", 8)
    monkeypatch.setattr(regions, "MOST_HOT", most_hot)
    sites = [("chr1", 100 * k, 100 * k + 50) for k in range(1, 30)]
    rows = [(f"r{k}", *sites[0]) for k in range(100)] + [(f"s{k}", *s) for k, s in enumerate(sites)] + [("lost", "chr9", 1, 2)]
    table = spark.createDataFrame(rows, "read_id string, chrom string, site1 int, site2 int")
    where = spark.createDataFrame([(*s, s[1] - 10, 9999, "A" * s[1]) for s in sites], "chrom string, site1 int, site2 int, offset int, n int, region string")

    def judge(items):
        return [None if row["read_id"] == "r7" else {**row, "width": len(region.seq), "together": len(items)} for region, row in items]

    found = regions.judge_by_site(table, where, judge, "read_id string, chrom string, site1 int, site2 int, width int, together int", 50).collect()
    assert sorted(r.read_id for r in found) == sorted(r[0] for r in rows if r[0] not in ("lost", "r7"))
    assert all(r.width == r.site1 for r in found)
    assert max(r.together for r in found if r.read_id[0] == "s" and r.read_id != "s0") > 1  # not a group for each candidate


def test_tiles_of_a_small_file_are_not_broadcast(spark):
    from strandline.plans import planted

    plan = planted.alignments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert planted.tiles(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_rows_are_numbered_by_many_tasks(spark):
    from strandline.operators.lineage import numbered

    rows = numbered(spark.range(2000).selectExpr("concat('n', id % 1999) as name", "id"), "name")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert all("__range" in line or "[name" not in line for line in plan.splitlines() if "Window" in line or "SinglePartition" in line)
    got = sorted((r.place, r.name) for r in rows.collect())
    assert [p for p, _ in got] == list(range(1, 2001)) and [n for _, n in got] == sorted(n for _, n in got)


def test_sequences_of_groups_are_shuffled_once(spark):
    from strandline.operators import read_groups
    from strandline.plans.views import view

    groups = read_groups.work_groups(read_groups.with_slots(view(spark, "/root/testdata/sf0.001", "aln")))
    assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_sam_is_written_packed(spark, monkeypatch, tmp_path):
    from pathlib import Path

    from strandline.plans import files

    monkeypatch.setattr(files, "folder", lambda _: str(tmp_path / "sam"))
    n = files.sam_round_trip(spark, "/root/testdata/sf0.001").count()
    assert sum(f.stat().st_size for f in Path(tmp_path / "sam").glob("part-*")) < 100 * n


def test_records_without_clips_stay_out_of_the_pairs_shuffle(spark):
    from strandline.plans import queries

    found = queries.pair_candidates(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".kind = 0)") == 2  # NOT (kind = 0), once for each side


@pytest.mark.parametrize("name", ["backward_pairs", "pair_candidates", "mate_consistency", "segment_candidates", "interval_linear", "strong_linear"])
def test_records_are_classified_once(spark, name):
    from strandline.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line for line in plan.splitlines() if "-999" not in line]
    # The last resort of a classification; sides of a self-join are one exchange.
    assert all(line.count("[0,0,0,-2]") <= 3 for line in nodes)
    assert sum(line.count("[0,0,0,-2]") for line in nodes) <= 6


def test_reads_meet_sites_before_junctions_are_made(spark, monkeypatch):
    from strandline.operators import linear

    junctions = [("c", 100, e) for e in range(200, 260)] + [("c", s, 400) for s in range(90, 110)] + [("c", 120, 120)]
    candidates = spark.createDataFrame(junctions, "chrom string, site1 int, site2 int")
    kind = "read_id string, chrom string, pos int, cigar string, L int, kind int, ref int"
    records = spark.createDataFrame([("a", "c", 60, "100M", 100, 0, 100), ("a", "c", 200, "100M", 100, 0, 100), ("b", "c", 60, "35M100N65M", 100, 0, 200), ("d", "c", 90, "*", 100, 0, -1)], kind)
    spanned = linear.spanned_sites(linear.linear_interval(records), candidates, 88)
    some = {(r.read_id, r.site1, r.site2) for r in spanned.collect()}
    assert len(some) == spanned.count() and ("a", 120, 120) in some and {x for x in some if x[0] == "a"} >= {("a", 100, e) for e in range(200, 260)}
    strong = sorted(map(tuple, linear.strong_spanned(records, candidates, 88, 19).collect()))
    assert strong and strong == sorted(map(tuple, linear.strong_sites(records, spanned, 19).collect())) and len(strong) == len(set(strong))
    monkeypatch.setattr(linear, "MOST_SITES", 0)
    assert strong == sorted(map(tuple, linear.strong_spanned(records, candidates, 88, 19).collect()))


def test_blocks_and_clips_of_any_string(spark):
    from strandline.functions import cigar as C

    rows = spark.createDataFrame([("5S10M2H",), ("10M",), ("3H2S4=",), ("5M2D5M",), ("*",), ("10S",), ("M",), (None,)], "c string").selectExpr("c", "7 as pos")
    got = [(r.c, [tuple(b) for b in r.b], r.e and tuple(r.e)) for r in rows.select("c", C.match_blocks(rows.pos, rows.c).alias("b"), C.end_clips(rows.c).alias("e")).collect()]
    assert got == [("5S10M2H", [(7, 16)], (5, 2)), ("10M", [(7, 16)], (0, 0)), ("3H2S4=", [(7, 10)], (3, 0)), ("5M2D5M", [(7, 11), (14, 18)], (0, 0)), ("*", [], None), ("10S", [], (10, 10)), ("M", [], None), (None, [], None)]


def test_evidence_is_not_multiplied_and_results_are_read_once(spark):
    from strandline.operators import summary
    from strandline.plans import queries

    for name in ("stringency_2", "result_totals"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and "Join Cross" not in plan
    rows = spark.createDataFrame([("a,b",), ("b,c",), (None,)], "read_ids string")
    assert tuple(summary.totals(rows).first()) == (3, 3)
    assert tuple(summary.totals(rows.limit(0)).first()) == (0, 0)


def test_difference_strings_side_by_side_are_those_of_each_alignment():
    import random

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("ACGTacgtN"[: draw.randint(1, 9)]) for _ in range(draw.choice([0, 1, 5, 40, 200, 1500])))
    rows = [("ACGT", "ACGT", "*"), ("ACGT", "AC", "9M2I"), ("AßGT", "ACGT", "4M"), ("ACGT", "ACGTACGT", "2M5N1M9D")]
    for _ in range(400):
        a = word()
        b = word() if draw.random() < 0.5 else a[draw.randint(0, 3) :] + word()
        rows.append((a, b, "".join(f"{draw.choice([0, 1, 2, 9, 10, 30, 120, 1200])}{draw.choice('MMMMIDNSHP=X')}" for _ in range(draw.randint(0, 7)))))
    for most in (1, 300, 1 << 15):
        assert kernels.difference_strings(*map(list, zip(*rows, strict=True)), most_columns=most) == [kernels.difference_string(*r) for r in rows]
    assert kernels.difference_strings([None, "A", "A", "A"], ["A", None, "A", "A"], ["1M", "1M", None, "1M"]) == [None, None, None, ":1"]
    assert kernels.difference_strings([], [], []) == []


def test_difference_strings_side_by_side_are_quick(spark):
    import time

    from strandline.plans import queries
    from strandline.plans.views import view

    reads = view(spark, "/root/testdata/sf0.01", "aln").where("cigar <> '*'").select("file_ord", "seq", "cigar").limit(20_000).collect()
    given = [[r.seq for r in reads], [r.seq[2:] + r.seq[:2] for r in reads], [r.cigar for r in reads]]
    began = time.process_time()
    alone = [kernels.difference_string(*r) for r in zip(*given, strict=True)]
    between = time.process_time()
    together = [x for k in (0, 10_000) for x in kernels.difference_strings(*(g[k : k + 10_000] for g in given))]
    assert together == alone
    assert 2 * (time.process_time() - between) < between - began
    made = {(r.file_ord, r.difference) for r in queries.difference_strings(spark, "/root/testdata/sf0.01").collect()}
    assert {(r.file_ord, x) for r, x in zip(reads, alone, strict=True)} <= made


def test_twins_shuffle_evidence_once(spark):
    from strandline.plans import strings

    plan = strings.twins_absorbed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [100_000, 0])
def test_twins_on_junctions_are_those_on_evidence(spark, monkeypatch, most):
    import random
    from collections import defaultdict

    from strandline.operators import summary

    monkeypatch.setattr(summary, "MOST_SITES", most)
    draw = random.Random(11)
    reference = "".join(draw.choice("ACGT") for _ in range(50)) * 60
    chunks = spark.createDataFrame([("c", 0, len(reference), reference)], "chrom string, chunk int, n int, seq string")
    evidence = set()
    for _ in range(60):
        site1, site2 = draw.choice([1000, 1050, 1100, 1103, 1220]), draw.choice([2000, 2050, 2100, 2117, 2131])
        sure = site1 in (1000, 1103) and draw.random() < 0.3
        for _ in range(draw.randint(1, 3)):
            cigar = draw.choice(["60S40M;60M40S", "70S30M;70M30S", "20S60M20S", "50S50M;*", "90S10M;30M2D60M8S"])
            evidence.add((f"r{draw.randint(0, 20)}", cigar, 1, "c", site1, site2, "+", int(sure)))

    reach = {"60S40M": 40, "70S30M": 30, "50S50M": 50, "90S10M": 10, "60M40S": 60, "70M30S": 70, "*": 0, "30M2D60M8S": 92}

    def slot_of(key, n):
        h, size = 0, 16
        for c in "\t".join(map(str, key)):
            h = (31 * h + ord(c)) % (1 << 32)
        while n > 0.75 * size:
            size *= 2
        return (h ^ (h >> 16)) % size

    def absorbed(rows, moves):
        which, per = moves - 1, defaultdict(lambda: [0, 0])
        for r in rows:
            if ";" in r[1]:
                one = per[r[3:6]]
                one[0] += r[2] == 1 and r[7] == 1
                one[1] = max(one[1], reach[r[1].split(";")[which]])
        groups, taken = defaultdict(list), {}
        for key in per:
            groups[key[2 - which]].append(key)
        for keys in groups.values():
            keys.sort(key=lambda k: (slot_of(k, len(keys)), k))  # noqa: B023
            for strong in (k for k in keys if per[k][0]):
                for weak in (k for k in keys if not per[k][0] and per[k][1] and k not in taken):
                    n = per[weak][1]
                    one, two = (reference[k[2] - n : k[2]] if moves == 2 else reference[k[1] - 1 : k[1] - 1 + n] for k in (strong, weak))
                    score, length = kernels.local_alignment(one, two, 1, -1, -3)
                    if score >= n - 2 - (n - 1) // 10 * 2 and length > n - 2:
                        taken[weak] = strong
        return {(*r[:3], *taken.get(r[3:6], r[3:6]), *r[6:]) for r in rows}, len(taken)

    once, first = absorbed(evidence, 2)
    want, second = absorbed(once, 1)
    assert first and second
    table = spark.createDataFrame(sorted(evidence) + sorted(evidence)[:9], "read_id string, cigar string, tag int, chrom string, site1 int, site2 int, strand string, q int")
    assert sorted(map(tuple, summary.absorb_twins(table, chunks, chunk=len(reference)).collect())) == sorted(want)
