"""Back-splice candidates from pairs of split alignments of one read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConf
from ..functions import cigar as C
from .read_groups import reverse_strand, slot


def quotient(a: Column, b: int) -> Column:
    """Integer division toward zero."""
    return F.when(a < 0, -F.floor(-a / b)).otherwise(F.floor(a / b)).cast("int")


def classified(records: DataFrame, read_length: Column) -> DataFrame:
    """records plus kind, a, b, ref of their CIGAR."""
    return shaped(records, read_length).select("*", "shape.*").drop("shape")


def shaped(records: DataFrame, read_length: Column, relaxed: bool = False) -> DataFrame:
    """records plus shape, the class of their CIGAR, computed once for each: an exploded column is not put in place of its name in
    what asks for it, as a plain one would be, in filters as often as they name it."""
    rows = records.withColumn("__letters", C.letters(F.col("cigar"))).withColumn("__numbers", F.split("cigar", "[A-Z=]"))
    rows = rows.withColumn("__shape", F.array(C.classify(F.col("cigar"), read_length, relaxed, F.col("__letters"), F.col("__numbers"))))
    return rows.withColumn("shape", F.explode_outer("__shape")).drop("__letters", "__numbers", "__shape")


def candidate_pairs(records: DataFrame, conf: EngineConf, group: list[str]) -> DataFrame:
    """Pairs of records of a group that show a back-splice, with the geometry of the junction.

    records: group columns, ord, flag, chrom, pos, mapq, cigar, L (read length), kind, a, b, ref. Joined by group only, so a
    group's pairs are as many as an aligner's split records of one read allow. For each pair x is the record with the smaller
    kind. site1 and site2 are where the read's parts meet the reference; adj1 and adj2 are the shifts of the two; left_end and
    right_start cut the read, tail is what stands outside.
    """
    # Only clipped records make a pair; the others need not be shuffled. Both sides are the same rows, so they are made once, and
    # the kinds are told apart in the join: x < y of three kinds are the pairs that can fit.
    records = records.where("kind <> 0").withColumn("rev", reverse_strand(F.col("flag")))
    side = lambda s: records.select(*group, "chrom", "rev", *(F.col(c).alias(f"{c}_{s}") for c in ("ord", "flag", "pos", "mapq", "cigar", "kind", "a", "b", "ref", "L")))
    both = side("x").join(side("y"), [*group, "chrom", "rev"]).where("kind_x < kind_y and ord_x <> ord_y")
    both = both.where((F.col("chrom") != "chrM") & ((F.col("mapq_x") >= conf.min_mapq) | (F.col("mapq_y") >= conf.min_mapq)))
    swap = F.col("ord_x") > F.col("ord_y")
    for c in ("ord", "flag", "cigar", "L"):
        both = both.withColumn(f"{c}_1", F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x"))).withColumn(f"{c}_2", F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")))
    x, y = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    L = F.col("L_1")
    style = F.when((x("kind") == -1) & (y("kind") == 1), "ends").when((x("kind") == -1) & (y("kind") == 10), "left").when((x("kind") == 1) & (y("kind") == 10), "right")
    pick = lambda ends, left, right: F.when(F.col("style") == "ends", ends).when(F.col("style") == "left", left).otherwise(right)
    both = both.withColumn("style", style).where("style is not null")
    both = both.withColumn("span", pick(y("pos") + y("b") - x("pos"), y("pos") + y("ref") - 1 - x("pos"), x("pos") + x("ref") - 1 - y("pos")))
    both = both.withColumn("slack", pick(x("a") - y("a"), L - y("b") - x("a"), x("a") - y("a")))
    both = both.withColumn("shift", pick(y("a") - x("a"), y("a") + y("ref") - x("a"), x("a") - y("a")))
    both = both.withColumn("adj1", quotient(F.col("shift"), 2)).withColumn("adj2", F.col("shift") - F.col("adj1"))
    good = (F.col("span") > 0) & F.col("span").between(conf.min_span, conf.max_span) & (F.abs("slack") <= conf.clip_slack) & (F.abs("adj1") <= conf.max_shift)
    both = both.where(good)
    low = pick(x("pos"), x("pos"), y("pos")) + F.col("adj1")
    high = pick(y("pos") + y("ref"), y("pos") + y("ref"), x("pos") + x("ref")) - 1 - F.col("adj2")
    cut = pick(x("a") + F.col("adj1"), x("a") + F.col("adj1"), x("a") - F.col("adj2"))
    flag = lambda q: (q >= conf.min_mapq).cast("int")
    both = both.withColumn("site1", low).withColumn("site2", high).withColumn("cut", cut)
    both = both.withColumn("q1", flag(F.when(F.col("style") == "right", y("mapq")).otherwise(x("mapq")))).withColumn("q2", flag(F.when(F.col("style") == "right", x("mapq")).otherwise(y("mapq"))))
    both = both.withColumn("sum_q", (F.col("q1") + F.col("q2") == 2).cast("int"))
    names = ["chrom", "ord_1", "ord_2", "style", "span", "adj1", "adj2", "site1", "site2", "cut", "a_y", "b_y", "q1", "q2", "sum_q", "flag_1 as flag", "L_1 as L", "concat_ws(';', cigar_1, cigar_2) as cigars"]
    return both.selectExpr(*group, *names)


def mates_of(alignments: DataFrame, found: DataFrame) -> DataFrame:
    """read_id, slot and, as mate_flag takes them, the records of the other mate in order, for the reads of found alone. Records go
    out without their bases, and only those of these reads are put together."""
    names = ["file_ord", "flag", "chrom", "pos", "mapq", "cigar"]
    rows = alignments.select("read_id", (1 - slot(F.col("flag"))).alias("slot"), *names)
    rows = found.select("read_id", "slot").distinct().join(rows, ["read_id", "slot"])
    records = rows.groupBy("read_id", "slot").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("records"))
    span = lambda r: F.struct(r["chrom"].alias("chrom"), r["mapq"].alias("mapq"), r["flag"].alias("flag"), r["pos"].alias("start"), (r["pos"] + C.reference_length(r["cigar"]) - 1).alias("end"))
    return records.select("read_id", "slot", F.transform("records", span).alias("mates"))


def mate_flag(mates: Column, chrom: Column, reverse: Column, site1: Column, site2: Column, paired: Column, conf: EngineConf) -> Column:
    """Whether the other mate agrees: 1 if the first of its records on the chromosome that maps well is on the other strand inside
    the junction, -1 if it is not, 0 if there is none; 1 for reads without a mate. mates: records with span ends (start, end)."""
    near = F.filter(mates, lambda m: (m["chrom"] == chrom) & (m["mapq"] >= conf.min_mapq))

    def judged(found: Column) -> Column:
        m = F.get(found, F.lit(0))
        inside = (m["start"] >= site1 - conf.site_slack) & (m["end"] <= site2 + conf.site_slack) & ((m["flag"].bitwiseAND(16) != 0) != reverse)
        return F.when(F.size(found) == 0, 0).when(inside, 1).otherwise(-1)

    return F.when(~paired, 1).otherwise(C.bind(near, judged))


def read_parts(pairs: DataFrame, seq: Column) -> DataFrame:
    """pairs plus right, left and tail: the read's part after the junction, before it, and outside (* if none)."""
    cut, L = F.col("cut"), F.col("L")
    sub = lambda a, b: F.substring(seq, a + 1, F.greatest(b - a, F.lit(0)))
    zero = F.lit(0)
    by = lambda ends, left, right: F.when(F.col("style") == "ends", ends).when(F.col("style") == "left", left).otherwise(right)
    right = by(sub(cut, L), sub(cut, L), sub(cut, L - F.col("b_y")))
    left = by(sub(zero, cut), sub(F.col("a_y"), cut), sub(zero, cut))
    tail = by(F.lit("*"), sub(zero, F.col("a_y")), sub(L - F.col("b_y"), L))
    return pairs.withColumn("right", right).withColumn("left", left).withColumn("tail", tail)
