"""Segments of reads without junction evidence, sidecars, and the tables that show evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConf
from ..functions import cigar as C
from ..functions import sequence as S
from .pairs import shaped
from .read_groups import reverse_strand


def outward_geometry(s: str, t: str, least: int) -> Column:
    """Whether records s and t (columns flag_s, start_s, end_s, clips_s) face outward: on different strands, the reverse one left
    of the other at both ends; on the same span, both clipped at their far ends by more than the other's near clip."""
    rev = reverse_strand(F.col(f"flag_{s}"))
    pick = lambda c: (F.when(rev, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")), F.when(rev, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")))
    (start_r, start_f), (end_r, end_f), (clip_r, clip_f) = pick("start"), pick("end"), pick("clips")
    apart = (start_f - start_r >= least) & (end_f - end_r >= least)
    clipped = (clip_r["three"] >= least) & (clip_f["three"] >= least) & (clip_r["three"] - clip_f["five"] >= least) & (clip_f["three"] - clip_r["five"] >= least)
    same = (start_r == start_f) & (end_r == end_f)
    return (rev != reverse_strand(F.col(f"flag_{t}"))) & F.when(same, F.coalesce(clipped, F.lit(False))).otherwise(apart)


def _spans(alignments: DataFrame) -> DataFrame:
    # Exploded, so that filters do not compute them again.
    spans = F.array(F.struct(C.span_end(F.col("pos"), F.col("cigar")).alias("end"), C.end_clips(F.col("cigar")).alias("clips")))
    rows = alignments.withColumn("__spans", spans).withColumn("__span", F.explode_outer("__spans")).select("*", "__span.*").drop("__spans", "__span")
    return rows.withColumn("start", F.col("pos")).withColumn("mate", S.mate_bucket(F.col("flag")))


def outward_primary(alignments: DataFrame, conf: EngineConf) -> DataFrame:
    """read_id of pairs with one primary record of each mate that face outward on one chromosome, both mapped well."""
    bits = F.col("flag").bitwiseAND(0x4 | 0x100 | 0x800)
    rows = _spans(alignments.where(bits == 0)).withColumn("first", F.col("flag").bitwiseAND(64) != 0)
    one = rows.groupBy("read_id").agg(F.count(F.when(F.col("first"), 1)).alias("n1"), F.count(F.when(~F.col("first"), 1)).alias("n2"), *(F.max(F.when(F.col("first"), F.struct("chrom", "mapq", "flag", "start", "end", "clips"))).alias("a"), F.max(F.when(~F.col("first"), F.struct("chrom", "mapq", "flag", "start", "end", "clips"))).alias("b")))
    one = one.where("n1 = 1 and n2 = 1").select("read_id", *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("chrom", "mapq", "flag", "start", "end", "clips")))
    good = (F.col("chrom_a") == F.col("chrom_b")) & (F.col("chrom_a") != "*") & (F.least("mapq_a", "mapq_b") >= conf.min_mapq)
    width = F.greatest("end_a", "end_b") - F.least("start_a", "start_b") + 1
    return one.where(good & outward_geometry("a", "b", conf.min_outward_offset) & (width <= conf.max_segment_span)).select("read_id").distinct()


def outward_any(alignments: DataFrame, conf: EngineConf) -> DataFrame:
    """read_id of reads of which any record of one mate and any of the other, no secondary ones, face outward; by the mode both
    must be mapped well (supplementary, filtered) or one of them (relaxed)."""
    if conf.outward_mode not in ("supplementary", "filtered", "relaxed"):
        return alignments.select("read_id").limit(0)
    rows = _spans(alignments.where((F.col("flag").bitwiseAND(0x4 | 0x100) == 0) & (F.col("chrom") != "*") & (F.col("cigar") != "*"))).where("mate > 0 and end is not null")
    side = lambda s, m: rows.where(F.col("mate") == m).select("read_id", "chrom", *(F.col(c).alias(f"{c}_{s}") for c in ("mapq", "flag", "start", "end", "clips")))
    both = side("a", 1).join(side("b", 2), ["read_id", "chrom"])
    mapped = F.greatest("mapq_a", "mapq_b") if conf.outward_mode == "relaxed" else F.least("mapq_a", "mapq_b")
    width = F.greatest("end_a", "end_b") - F.least("start_a", "start_b") + 1
    return both.where((mapped >= conf.min_mapq) & outward_geometry("a", "b", conf.min_outward_offset) & (width <= conf.max_segment_span)).select("read_id").distinct()


def backward_split(alignments: DataFrame) -> DataFrame:
    """read_id of reads two of whose records, on one strand, lie against the order of the read; the sign is that of a linear gap,
    the opposite of the junction candidates'."""
    n = F.coalesce(F.length("seq"), F.lit(0))
    rows = shaped(alignments.where((F.col("chrom") != "*") & (F.col("cigar") != "*")).withColumn("n", n), F.lit(0), relaxed=True).where("shape.kind <> 0")
    # The read's length is that of the pair's longer sequence. Only a (match, then clip, of four operations and more) depends on it:
    # it is classified with length 0 and moved by the length once the pair is known.
    moved = (F.col("shape.kind") == 1) & (F.length(C.letters(F.col("cigar"))) > 3)
    rows = rows.select("read_id", "chrom", reverse_strand(F.col("flag")).alias("rev"), "pos", "file_ord", "n", "shape.*", moved.alias("moved"))
    side = lambda s: rows.select("read_id", "chrom", "rev", *(F.col(c).alias(f"{c}_{s}") for c in ("pos", "file_ord", "n", "kind", "a", "b", "ref", "moved")))
    both = side("x").join(side("y"), ["read_id", "chrom", "rev"]).where("kind_x < kind_y and file_ord_x <> file_ord_y")
    x, y, L = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y")), F.greatest("n_x", "n_y")
    ax, ay = (v("a") + F.when(v("moved"), L).otherwise(0) for v in (x, y))
    # Both kinds in one number: told apart by side, they would be filters that make two different inputs of the one.
    kinds = 100 * x("kind") + y("kind")
    ends = (kinds == -99) & (F.abs(ax - ay) <= 6) & (y("pos") + y("b") - x("pos") - x("b") < 0)
    left = (kinds == -90) & (F.abs(L - y("b") - ax) <= 6) & (y("pos") + y("ref") - 1 - x("pos") < 0)
    right = (kinds == 110) & (F.abs(ax - ay) <= 6) & (x("pos") + x("ref") - 1 - y("pos") < 0)
    return both.where((L > 0) & (ends | left | right)).select("read_id").distinct()


def segment_reads(alignments: DataFrame, claimed: DataFrame, conf: EngineConf) -> DataFrame:
    """read_id of reads without junction evidence that may show a segment of a circle: outward or backward."""
    # Each rule looks at one read's records only, so claimed reads are taken from what is found, not from all records.
    found = outward_primary(alignments, conf).union(outward_any(alignments, conf)).union(backward_split(alignments)).distinct()
    return found.join(claimed.select("read_id").distinct(), "read_id", "left_anti")


def compact_records(alignments: DataFrame, reads: DataFrame) -> DataFrame:
    """One row for each of the reads: its records in order, with their clipped bases."""
    record = F.struct("file_ord", "flag", "chrom", "pos", "mapq", "cigar", C.clip_payload(F.col("cigar"), F.col("seq")).alias("clips"))
    return alignments.join(reads, "read_id", "left_semi").groupBy("read_id").agg(F.array_sort(F.collect_list(record)).alias("records"))


def evidence_sidecar(alignments: DataFrame, evidence: DataFrame, stage: str) -> DataFrame:
    """Every record of the reads with evidence of a scan, as segments see it."""
    rows = alignments.join(evidence.select("read_id").distinct(), "read_id", "left_semi")
    return rows.select("read_id", F.lit(stage).alias("stage"), S.mate_bucket(F.col("flag")).alias("mate"), "flag", "chrom", "pos", "mapq", "cigar", F.length("seq").alias("seq_len"), C.clip_payload(F.col("cigar"), F.col("seq")).alias("clips"))


def display_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both scans' evidence with the stage, in the order of the display: read, R1 first, priority 1 first, first scan first."""
    both = first.withColumn("stage", F.lit("scan1")).unionByName(second.withColumn("stage", F.lit("scan2")))
    return both.orderBy("read_id", F.when(F.col("mate") == "R1", 0).otherwise(1), F.desc("priority"), "stage", *[c for c in first.columns if c not in ("read_id", "mate", "priority")])


def arc_rows(results: DataFrame) -> DataFrame:
    """BEDPE of results: an anchor of one base at each end; rows whose sites are no numbers or not in order are left out."""
    start, end = F.col("start").cast("string").try_cast("int"), F.col("end").cast("string").try_cast("int")
    rows = results.withColumn("s", start).withColumn("e", end).where("s >= 1 and e >= s")
    return rows.select("chrom", (F.col("s") - 1).alias("start1"), F.col("s").alias("end1"), F.col("chrom").alias("chrom2"), (F.col("e") - 1).alias("start2"), F.col("e").alias("end2"), F.col("junction_id").alias("name"), F.coalesce(F.col("score").cast("string"), F.lit("0")).alias("score"), F.coalesce("strand", F.lit(".")).alias("strand1"), F.coalesce("strand", F.lit(".")).alias("strand2"))


# ---------------------------------------------------------------- review track


def chain_units(chain: Column) -> Column:
    """array<struct<start, end, strand, bsj>> of start-end:strand tokens joined by |, with <bsj> where the circle closes."""
    unit = lambda t: F.struct(F.regexp_extract(t, r"^(\d+)-", 1).try_cast("int").alias("start"), F.regexp_extract(t, r"-(\d+):", 1).try_cast("int").alias("end"), F.regexp_extract(t, r":(.)$", 1).alias("strand"), (t == "<bsj>").alias("bsj"))
    return F.transform(F.filter(F.split(chain, r"[|]"), lambda t: t != ""), unit)


def chain_parts(chains: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of chains (keys, chain): cut where the circle closes and where coordinates go back. keys, part, blocks, strand."""
    units = chains.select(*keys, F.posexplode(chain_units(F.col("chain"))).alias("i", "u")).select(*keys, "i", "u.*")
    by = Window.partitionBy(*keys).orderBy("i")
    back = F.coalesce((F.lag("bsj").over(by)) | (F.col("start") <= F.lag("end").over(by)), F.lit(False))
    rows = units.withColumn("part", F.sum(F.when(F.col("bsj"), 0).otherwise(back.cast("int"))).over(by)).where(~F.col("bsj") & F.col("start").isNotNull())
    parts = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end"))).alias("blocks"), F.array_sort(F.collect_set("strand")).alias("strands"))
    strand = F.when(F.size("strands") == 1, F.col("strands")[0]).otherwise(".")
    return parts.select(*keys, "part", F.transform("blocks", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("blocks"), strand.alias("strand"))


# Mapping quality and colour of a segment's type in the review track.
TRACK = {"bsj": (60, "220,50,47"), "backward": (45, "38,139,210"), "outward": (30, "133,153,0")}


def review_rows(segments: DataFrame) -> DataFrame:
    """SAM fields of the parts of segments (read_id, type, circ_id, chrom, r1_segments, r2_segments), without bases.

    A part's name tells read, type, circle, mate and part; its CIGAR has gaps between its blocks; bases are N.
    """
    mates = F.explode(F.array(F.struct(F.lit("R1").alias("mate"), F.col("r1_segments").alias("chain")), F.struct(F.lit("R2").alias("mate"), F.col("r2_segments").alias("chain"))))
    rows = segments.where(F.col("type").isin(*TRACK)).select("read_id", "type", "circ_id", "chrom", mates.alias("m")).select("read_id", "type", "circ_id", "chrom", "m.mate", "m.chain")
    parts = chain_parts(rows.where("chain is not null and chain not in ('', '*', 'NA')"), ["read_id", "type", "circ_id", "chrom", "mate"])
    by_type = lambda k: F.coalesce(*(F.when(F.col("type") == t, F.lit(v[k])) for t, v in TRACK.items()))
    name = F.concat_ws("|", "read_id", "type", "circ_id", "mate", F.concat(F.lit("part"), (F.col("part") + 1).cast("string")))
    n = F.aggregate("blocks", F.lit(0), lambda s, b: s + b["end"] - b["start"] + 1)
    return parts.select(name.alias("qname"), F.when(F.col("strand") == "-", 16).otherwise(0).alias("flag"), "chrom", F.element_at("blocks", 1)["start"].alias("pos"), by_type(0).alias("mapq"), C.spliced_cigar(F.col("blocks")).alias("cigar"), F.repeat(F.lit("N"), n).alias("seq"), by_type(1).alias("colour"), F.element_at("blocks", -1)["end"].alias("end"))


def track_lengths(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """chrom, length: the longer of the reference's and what the track reaches."""
    seen = rows.groupBy("chrom").agg(F.max("end").alias("seen"))
    return seen.join(reference.select("chrom", "length"), "chrom", "left").select("chrom", F.greatest(F.coalesce("length", F.lit(0)), "seen").alias("length"))
