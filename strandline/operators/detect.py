"""Junction evidence: the first scan validates pairs of split alignments, the second rescues clipped reads at its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConf
from ..functions import cigar as C
from ..functions import keys as K
from ..functions import sequence as S
from ..functions.kernels import judge_pair, judge_rescues, junction_signals
from .lineage import cut
from .pairs import candidate_pairs, classified, mate_flag, read_parts
from .read_groups import ORDER, first_hit, last_runs, prioritised, reverse_strand, slot, unclaimed, with_slots, work_groups
from .regions import SITE, cut_regions, judge_by_site

EVIDENCE = ["read_id", "mate", "cigar", "tag", "chrom", "site1", "site2", "strand", "signal_left", "signal_right", "q"]
HIT = "read_id string, slot int, ord_1 int, ord_2 int, cigar string, tag int, chrom string, site1 int, site2 int, strand string, signal_left string, signal_right string, q int"
MATE = "case when slot = 1 then 'R1' else 'R2' end as mate"


def _records(slots: DataFrame) -> DataFrame:
    rows = slots.select("read_id", "slot", F.length("best.seq").alias("L"), F.posexplode("records").alias("ord", "r"))
    rows = rows.select("read_id", "slot", "ord", "L", *(F.col(f"r.{c}").alias(c) for c in ORDER)).withColumn("cigar", C.soft(F.col("cigar")))
    return classified(rows, F.col("L"))


def _mates(slots: DataFrame) -> DataFrame:
    """Of each slot, what its mate needs to know: the sequence and the spans of its records."""
    spans = F.transform("records", lambda r: F.struct(r["chrom"].alias("chrom"), r["mapq"].alias("mapq"), r["flag"].alias("flag"), r["pos"].alias("start"), (r["pos"] + C.reference_length(r["cigar"]) - 1).alias("end")))
    return slots.select("read_id", (1 - F.col("slot")).alias("slot"), F.col("best").alias("mate_best"), spans.alias("mates"))


def exon_offsets(pairs: DataFrame, exon_starts: DataFrame, exon_ends: DataFrame) -> DataFrame:
    """chrom, site1, site2, adj1, adj2, exons: the offsets at which annotated exons of one gene and strand start and end.

    exon_starts, exon_ends: chrom, pos, gene_id, strand.
    """
    keys = [*SITE, "adj1", "adj2"]
    sites = pairs.select(*keys).distinct()
    lead = F.when(F.col("adj2") >= 0, F.col("adj1")).otherwise(-F.col("adj2"))
    count = F.when(F.col("adj2") >= 0, 2 + F.col("adj1") + F.col("adj2")).otherwise(2 - F.col("adj1") - F.col("adj2"))
    each = sites.withColumn("offset", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0)))))
    each = each.withColumn("start", F.col("site1") - lead - 1 + F.col("offset")).withColumn("end", F.col("site2") - lead - 1 + F.col("offset"))
    starts = exon_starts.select("chrom", F.col("pos").alias("start"), "gene_id", "strand")
    ends = exon_ends.select("chrom", F.col("pos").alias("end"), "gene_id", "strand")
    met = each.join(starts, ["chrom", "start"]).join(ends, ["chrom", "end", "gene_id", "strand"])
    return met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("offset", "strand"))).alias("exons"))


def scan_pairs(alignments: DataFrame, chunks: DataFrame, conf: EngineConf, exons: tuple[DataFrame, DataFrame] | None = None, chunk: int = 1 << 20, relaxed: bool = False) -> DataFrame:
    """Evidence of the first scan with priority 1 for a read's own junction and 0 for other ones of its mates.

    A read's own junction is the first valid one: slot 0 before slot 1, then by records.
    """
    slots = work_groups(with_slots(alignments)).where(F.col("best.seq").isNotNull())
    pairs = cut(candidate_pairs(_records(slots), conf, ["read_id", "slot"]))
    pairs = pairs.join(slots.select("read_id", "slot", "best", "n_slots"), ["read_id", "slot"]).join(_mates(slots), ["read_id", "slot"], "left")
    reverse = reverse_strand(F.col("flag"))
    pairs = read_parts(pairs.withColumn("seq", S.oriented(F.col("best.seq"), F.col("best.reverse") == reverse)), F.col("seq"))
    paired = F.col("mates").isNotNull()
    mate = F.when(paired, S.oriented(F.col("mate_best.seq"), F.col("mate_best.reverse") != reverse)).otherwise("")
    pairs = pairs.withColumn("agrees", mate_flag(F.coalesce("mates", F.array()), F.col("chrom"), reverse, F.col("site1"), F.col("site2"), paired, conf))
    pairs = pairs.withColumn("mate", mate).withColumn("reverse", reverse)
    if exons is None:
        pairs = pairs.withColumn("exons", F.array().cast("array<struct<offset:int,strand:string>>"))
    else:
        pairs = pairs.join(exon_offsets(pairs, *exons), [*SITE, "adj1", "adj2"], "left").withColumn("exons", F.coalesce("exons", F.array().cast("array<struct<offset:int,strand:string>>")))
    needed = ["read_id", "slot", "n_slots", "ord_1", "ord_2", "cigars", *SITE, "adj1", "adj2", "left", "right", "tail", "mate", "reverse", "agrees", "q1", "q2", "sum_q", "exons"]
    pairs = cut(pairs.select(*needed))
    regions = cut_regions(pairs.select(*SITE).distinct(), chunks, conf.linear_range, chunk)
    signals, linear_range = (S.RELAXED_SIGNALS if relaxed else S.SIGNALS), conf.linear_range

    def judge_one(region, row):
        found = judge_pair(region, row, junction_signals(region, row, signals, row["exons"]), linear_range)
        if found is None:
            return None
        tag, site1, site2, strand, left, right = found
        return {**{k: row[k] for k in ("read_id", "slot", "n_slots", "ord_1", "ord_2", "chrom")}, "cigar": row["cigars"], "tag": tag, "site1": site1, "site2": site2, "strand": strand, "signal_left": left, "signal_right": right, "q": row["sum_q"]}

    def judge(items):
        return [judge_one(region, row) for region, row in items]

    hits = cut(judge_by_site(pairs, regions, judge, HIT.replace("slot int", "slot int, n_slots long"), linear_range))
    order = ["slot", "ord_1", "ord_2", *SITE]
    judged = hits if conf.judge_first_mate_alone else hits.where((F.col("n_slots") > 1) | (F.col("slot") == 0))
    main = first_hit(judged, ["read_id"], order).selectExpr("*", MATE).select(*EVIDENCE)
    other = first_hit(hits, ["read_id", "slot"], order).selectExpr("*", MATE).select(*EVIDENCE)
    return prioritised(main, other)


def candidates_of(evidence: DataFrame) -> DataFrame:
    """chrom, site1, site2, strand, signal_left, signal_right, ord: the distinct junctions of a scan's own evidence, in the order of
    a hash table of their keys, which decides between candidates that fit a read equally well."""
    from pyspark.sql import Window

    rows = evidence.where("priority = 1").select(*SITE, "strand", "signal_left", "signal_right").distinct()
    key = F.concat_ws("\t", "chrom", "site1", "site2", "strand", "signal_left", "signal_right")
    in_chrom = Window.partitionBy("chrom")
    rows = rows.withColumn("place", K.hash_slot(K.java_hash(key), F.count("*").over(in_chrom)))
    return cut(rows.withColumn("ord", F.row_number().over(in_chrom.orderBy("place", *SITE, "strand", "signal_left", "signal_right"))).drop("place"))


def with_catalog(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """candidates and the junctions of a catalog (chrom, start, end, strand) that are not among them."""
    known = candidates.select("chrom", F.col("site1").alias("start"), F.col("site2").alias("end"), "strand")
    more = catalog.join(known, ["chrom", "start", "end", "strand"], "left_anti")
    more = more.select("chrom", F.col("start").alias("site1"), F.col("end").alias("site2"), "strand", F.lit("").alias("signal_left"), F.lit("").alias("signal_right"))
    return candidates.unionByName(more.withColumn("ord", (1 << 24) + F.pmod(F.xxhash64(*SITE), F.lit(1 << 24)).cast("int")))


def near_sites(records: DataFrame, candidates: DataFrame, place: str, site: str, slack: int, bucket: int) -> DataFrame:
    """records joined with the candidates whose site is within slack of a place: an equi-join on buckets, then the distance."""
    lo, hi = (F.floor((F.col(place) + d) / bucket).cast("long") for d in (-slack, slack))
    left = records.withColumn("low_bucket", lo).withColumn("bucket", F.explode(F.array_distinct(F.array(lo, hi))))
    right = candidates.withColumn("bucket", F.floor(F.col(site) / bucket).cast("long"))
    return left.join(right, ["chrom", "bucket"]).where(F.abs(F.col(site) - F.col(place)) <= slack)


def scan_clips(alignments: DataFrame, candidates: DataFrame, claims: DataFrame, chunks: DataFrame, conf: EngineConf, read_length: int, chunk: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Evidence of the second scan (priority as in the first), and linear keys (read_id, chrom, site1, site2) of reads without any.

    claims: the read_ids that the first scan has. Candidates are tried in the order slot, record, clip on the left before the
    right, sites from the middle of the window outward by bucket; the first that holds is a read's own.
    """
    bucket = max(1, read_length - 12)
    records = last_runs(unclaimed(alignments, claims, ["read_id"])).where(F.col("cigar") != "*")
    records = records.join(candidates.select("chrom").distinct(), "chrom", "left_semi")
    records = classified(records.withColumn("cigar", C.soft(F.col("cigar"))).withColumn("L", F.length("best.seq")), F.col("L"))
    reverse = reverse_strand(F.col("flag"))
    records = records.withColumn("reverse", reverse).withColumn("oriented", S.oriented(F.col("best.seq"), F.col("best.reverse") == reverse)).withColumn("ord", F.col("file_ord"))
    L, a, b = F.col("L"), F.col("a"), F.col("b")
    sub = lambda x, y: F.substring("oriented", x + 1, F.greatest(y - x, F.lit(0)))
    both = F.col("kind") == 10
    left = near_sites(records.where("kind in (-1, 10)").withColumn("end", F.col("pos")), candidates.withColumnRenamed("ord", "cand"), "end", "site1", conf.site_slack, bucket)
    left = left.withColumn("part", F.concat(sub(F.lit(0), a + F.col("site1") - F.col("pos")), "signal_right")).withColumn("tail", F.when(both, sub(L - b, L)).otherwise("*")).withColumn("left_clip", F.lit(True)).withColumn("site", F.col("site1"))
    right = near_sites(records.where("kind in (1, 10)").withColumn("end", F.col("pos") + F.col("ref") - 1), candidates.withColumnRenamed("ord", "cand"), "end", "site2", conf.site_slack, bucket)
    start = F.when(both, L - b).otherwise(a) + F.col("site2") - F.col("end")
    right = right.withColumn("part", F.concat("signal_left", sub(start, L))).withColumn("tail", F.when(both, sub(F.lit(0), a)).otherwise("*")).withColumn("left_clip", F.lit(False)).withColumn("site", F.col("site2"))
    tried = left.unionByName(right)
    low = F.col("bucket") == F.col("low_bucket")
    tried = tried.withColumn("phase", F.when(low, 0).otherwise(1)).withColumn("turn", F.when(low, -F.col("site")).otherwise(F.col("site"))).withColumn("cand", F.when(low, -F.col("cand")).otherwise(F.col("cand")))
    mates = _mates(with_slots(records.select("read_id", *ORDER)))
    tried = tried.join(mates, ["read_id", "slot"], "left")
    paired = F.col("mates").isNotNull()
    tried = tried.withColumn("agrees", mate_flag(F.coalesce("mates", F.array()), F.col("chrom"), F.col("reverse"), F.col("site1"), F.col("site2"), paired, conf))
    tried = tried.withColumn("mate", F.when(paired, S.oriented(F.col("mate_best.seq"), F.col("mate_best.reverse") != F.col("reverse"))).otherwise(""))
    needed = ["read_id", "slot", "ord", "phase", "turn", "cand", "left_clip", *SITE, "strand", "signal_left", "signal_right", "cigar", "part", "tail", "mate", "reverse", "agrees", "mapq"]
    tried = cut(tried.select(*needed))
    regions = cut_regions(tried.select(*SITE).distinct(), chunks, conf.linear_range, chunk)
    linear_range, min_mapq = conf.linear_range, conf.min_mapq

    told = [c for c in needed if c not in ("part", "tail", "mate", "reverse", "agrees", "mapq")]

    def judge(items):
        verdicts = judge_rescues(items, linear_range, min_mapq)
        return [{k: row[k] for k in told} | {"verdict": v} for (_, row), v in zip(items, verdicts, strict=True)]

    schema = "read_id string, slot int, ord long, phase int, turn int, cand int, left_clip boolean, chrom string, site1 int, site2 int, strand string, signal_left string, signal_right string, cigar string, verdict string"
    judged = cut(judge_by_site(tried, regions, judge, schema, linear_range))
    hits = judged.where("length(verdict) > 1").withColumn("tag", F.expr("cast(left(verdict, length(verdict) - 1) as int)")).withColumn("q", F.right("verdict", F.lit(1)).cast("int"))
    order = ["slot", "ord", F.desc("left_clip"), "phase", "turn", "cand", *SITE]
    main = first_hit(hits, ["read_id"], order).selectExpr("*", MATE).select(*EVIDENCE)
    other = first_hit(hits, ["read_id", "slot"], order).selectExpr("*", MATE).select(*EVIDENCE)
    from .linear import linear_keys

    refused = judged.where("verdict = '0'").select("read_id", *SITE)
    linear = linear_keys(records, candidates, conf, bucket, refused)
    return prioritised(main, other), unclaimed(linear, hits, ["read_id"])
