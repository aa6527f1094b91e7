"""Results: evidence put together by junction, filtered, annotated and counted against linear reads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import keys as K
from ..functions.kernels import local_alignment
from .lineage import cut
from .linear import MOST_SITES
from .regions import SITE, cut_regions

RESULT = ["junction_id", "chrom", "start", "end", "junction_reads", "shapes", "linear_reads", "ratio", "kind", "gene_id", "strand", "read_ids", "score"]


def _split(cigars: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(F.when(cigars.isNotNull(), F.split(cigars, ";")))))


def aggregate_junctions(evidence: DataFrame) -> DataFrame:
    """One row for each junction of evidence (read_id, cigar, tag, chrom, site1, site2, strand, q): reads and CIGARs for and against.

    true and false evidence is told by tag (1, -1, -2) and, apart, with the least sure rows (q = 3) added.
    """
    sure, yes, no = F.col("q") != 3, F.col("tag") == 1, F.col("tag").isin(-1, -2)
    when = lambda cond, c="cigar": F.when(cond, F.col(c))
    # Rows go out by junction and read once, and are counted by read there: distinct counts of several kinds in one aggregate would
    # multiply all rows, with what is collected beside them. CIGARs and strands are few for each junction.
    rows = evidence.select("read_id", "cigar", "tag", *SITE, "strand", "q").repartition(*SITE, "read_id").distinct()
    named = F.col("read_id").isNotNull()
    some = lambda cond: F.max(F.coalesce(cond, F.lit(False)).cast("int"))
    reads = rows.groupBy(*SITE, "read_id").agg(
        some(yes & sure & named).alias("tp"),
        some(yes & named).alias("tp_all"),
        F.count(F.when((F.col("tag") == -1) & sure, 1)).alias("other"),
        F.count(F.when((F.col("tag") == -2) & sure, 1)).alias("fp"),
        F.count(F.when(yes & (F.col("q") == 1), 1)).alias("score"),
    )
    counts = ("tp", "tp_all", "other", "fp", "score")
    read_ids = F.sort_array(F.collect_list(F.when(F.col("tp_all") == 1, F.col("read_id")))).alias("read_ids")
    whole = reads.groupBy(*SITE).agg(*(F.sum(c).alias(c) for c in counts), read_ids)
    tally = rows.groupBy(*SITE, "strand", "tag", "cigar", sure.alias("sure")).agg(F.count("*").alias("n"))
    votes = tally.groupBy(*SITE, "strand").agg(F.sum("n").alias("n"))
    strand = votes.groupBy(*SITE).agg(F.min_by("strand", F.struct((-F.col("n")).alias("n"), "strand")).alias("strand"))
    sure = F.col("sure")
    texts = tally.groupBy(*SITE).agg(
        _split(when(yes & sure)).alias("cigars"),
        F.collect_set(when(yes & ~sure)).alias("whole_cigars"),
        _split(when(no & sure)).alias("false_cigars"),
        F.collect_set(when(no & ~sure)).alias("whole_false_cigars"),
    )
    whole = whole.join(texts, SITE)
    whole = whole.withColumn("all_cigars", F.array_union("cigars", "whole_cigars")).withColumn("all_false_cigars", F.array_union("false_cigars", "whole_false_cigars"))
    return whole.join(strand, SITE)


def passes(level: int) -> Column:
    """The stringency filter on aggregate_junctions; any level but 1 and 2 is the loosest."""
    tp, fp, other, score, tp_all = (F.col(c) for c in ("tp", "fp", "other", "score", "tp_all"))
    clean = (score > 0) & (F.size("all_false_cigars") == 0) & (tp_all >= 2)
    outvoted = tp > other + fp
    if level == 2:
        return (((tp > 19 * fp) | (fp <= 1)) & outvoted & (F.size("cigars") >= 3) & (tp >= 2)) | (clean & (F.size("all_cigars") >= 3))
    loose = ((tp > 19 * fp) | (F.size("false_cigars") <= 2)) & outvoted
    return (loose & (tp >= 2) if level == 1 else loose) | clean


def shape_counts(cigars: Column) -> Column:
    """SM_MS_SMS: how many of the CIGARs are clipped on the left, on the right and on both sides."""
    classes = F.transform(cigars, lambda c: C.shape_class(c))
    count = lambda k: F.size(F.filter(classes, lambda x: x == k)).cast("string")
    return F.concat_ws("_", count("SM"), count("MS"), count("SMS"))


def annotated(junctions: DataFrame, exon_starts: DataFrame, exon_ends: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """junctions (chrom, site1, site2) plus kind and gene_id.

    exon if one gene has an exon that starts at site1 and one that ends at site2; else the first gene, by start, end and id, that
    holds both: exon if each end is in some exon of it, intron if not; else intergenic_region. Genes meet junctions by the
    stretches of 2 ** 17 bases that they cover, so the join is an equi-join.
    """
    starts = exon_starts.select("chrom", F.col("pos").alias("site1"), F.col("gene_id").alias("g1"))
    ends = exon_ends.select("chrom", F.col("pos").alias("site2"), F.col("gene_id").alias("g2"))
    sites = junctions.select(*SITE).distinct()
    exact = sites.join(starts, ["chrom", "site1"]).join(ends, ["chrom", "site2"]).where("g1 = g2").groupBy(*SITE).agg(F.min("g1").alias("gene_id")).withColumn("kind", F.lit("exon"))
    stretch = lambda c: F.floor(F.col(c) / (1 << 17)).cast("int")
    covered = genes.select("chrom", "gene_id", "start", "end", F.explode(F.sequence(stretch("start"), stretch("end"))).alias("stretch"))
    inside = sites.join(exact, SITE, "left_anti").withColumn("stretch", stretch("site1")).join(covered, ["chrom", "stretch"]).where("start <= site1 and site2 <= end")
    first = inside.groupBy(*SITE).agg(F.min(F.struct("start", "end", "gene_id"))["gene_id"].alias("gene_id"))
    parts = exons.select("gene_id", F.col("start").alias("exon_start"), F.col("end").alias("exon_end"))
    holds = lambda c: F.max((F.col("exon_start") <= F.col(c)) & (F.col("exon_end") >= F.col(c)))
    judged = first.join(parts, "gene_id", "left").groupBy(*SITE, "gene_id").agg(holds("site1").alias("a"), holds("site2").alias("b"))
    judged = judged.select(*SITE, "gene_id", F.when(F.col("a") & F.col("b"), "exon").otherwise("intron").alias("kind"))
    told = exact.select(*SITE, "gene_id", "kind").unionByName(judged)
    return junctions.join(told, SITE, "left").na.fill({"kind": "intergenic_region", "gene_id": "NA"})


def absorb_twins(evidence: DataFrame, chunks: DataFrame, linear_range: int = 0, chunk: int = 1 << 20) -> DataFrame:
    """evidence with the junctions of weak evidence renamed to a strong one that shares a site, where the sequences beside the other
    sites align: first by the same start, then by the same end.

    Strong junctions, in the order of a hash table of their keys, take those without a sure read whose longest matched stretch
    is alike. Rows of a taken junction count as the other's.

    Both rounds are about junctions: evidence is read once to make these, and once to be renamed. Only whether a junction has a
    sure read and its longest stretches matter, so a taken junction's are the other's without its rows, and rows may repeat.
    """
    was = [F.col(c).alias(f"was_{c}") for c in SITE]
    junctions = _junctions(evidence).select("*", *was)
    junctions = cut(_absorb(cut(junctions), chunks, "site2", chunk))
    moved = _absorb(junctions, chunks, "site1", chunk).where("site1 <> was_site1 or site2 <> was_site2")
    moved = cut(moved.select(*(F.col(f"was_{c}").alias(c) for c in SITE), F.col("site1").alias("new1"), F.col("site2").alias("new2")))
    moved = F.broadcast(moved) if moved.count() <= MOST_SITES else moved.hint("merge")
    rows = evidence.join(moved, SITE, "left")
    rows = rows.withColumn("site1", F.coalesce("new1", "site1")).withColumn("site2", F.coalesce("new2", "site2"))
    return rows.select(*evidence.columns).distinct()


def _junctions(evidence: DataFrame) -> DataFrame:
    """The junctions of evidence with two records: SITE, score (sure reads for it), reach1 and reach2 (the longest matched stretch of
    the first and of the second record). A CIGAR is taken apart once for each junction that has it."""
    rows = evidence.where(F.contains("cigar", F.lit(";")))
    rows = rows.groupBy(*SITE, "cigar").agg(F.expr("count_if(tag = 1 and q = 1)").alias("score"))
    reach = lambda which: F.max(C.match_to_match_length(F.element_at(F.split("cigar", ";"), which)))
    return rows.groupBy(*SITE).agg(F.sum("score").alias("score"), reach(1).alias("reach1"), reach(2).alias("reach2"))


def _absorb(junctions: DataFrame, chunks: DataFrame, moves: str, chunk: int) -> DataFrame:
    """junctions (SITE, score, reach1, reach2 and what they were before), cut, with the weak ones renamed."""
    shared = "site1" if moves == "site2" else "site2"
    # The matched stretch beside the site that differs: of the second record by the same start, of the first by the same end.
    reach = "reach2" if moves == "site2" else "reach1"
    per = junctions.groupBy(*SITE).agg(F.sum("score").alias("score"), F.max(reach).alias("reach"))
    key = F.concat_ws("\t", "chrom", "site1", "site2")
    twins = per.groupBy("chrom", shared).agg(F.count("*").alias("n"), F.expr("count_if(score > 0)").alias("strong"), F.expr("count_if(score = 0)").alias("weak")).where("strong > 0 and weak > 0")
    members = cut(per.join(twins, ["chrom", shared]).withColumn("place", K.hash_slot(K.java_hash(key), F.col("n"))))
    regions = cut_regions(members.select(*SITE).distinct(), chunks, 1 << 10, chunk)
    at_end = moves == "site2"

    def greedy(group: pa.Table) -> pa.Table:
        items = sorted(group.to_pylist(), key=lambda r: (r["place"], r["site1"], r["site2"]))
        free = [r for r in items if r["score"] == 0 and r["reach"] > 0]
        out = []

        def beside(r: dict, n: int) -> str:
            site = r[moves]
            a, b = (site - n, site) if at_end else (site - 1, site - 1 + n)
            return r["region"][max(0, a - r["offset"]) : max(0, b - r["offset"])]

        for strong in (r for r in items if r["score"] > 0):
            for weak in list(free):
                n = weak["reach"]
                one, two = beside(strong, n), beside(weak, n)
                if len(one) < n or len(two) < n:
                    continue
                score, length = local_alignment(one, two, 1, -1, -3)
                if score >= n - 2 - (n - 1) // 10 * 2 and length > n - 2:
                    out.append((weak["chrom"], weak["site1"], weak["site2"], strong["site1"], strong["site2"]))
                    free.remove(weak)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("chrom", "site1", "site2", "new1", "new2"), columns, kinds, strict=True)})

    taken = members.select("chrom", "site1", "site2", "score", "reach", "place").join(regions.select(*SITE, "offset", "region"), SITE).groupBy("chrom", shared).applyInArrow(greedy, "chrom string, site1 int, site2 int, new1 int, new2 int")
    moved = junctions.join(taken, SITE, "left")
    return moved.withColumn("site1", F.coalesce("new1", "site1")).withColumn("site2", F.coalesce("new2", "site2")).select(*junctions.columns)


def summarize(evidence: DataFrame, linear: DataFrame, level: int = 0, annotation: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """The result table of evidence with priority 1: RESULT columns, junction reads with the least sure ones counted."""
    found = aggregate_junctions(evidence.where("priority = 1")).where(passes(level))
    found = found.join(linear.select(*SITE, "linear_reads"), SITE, "left").na.fill(0, ["linear_reads"])
    if annotation is None:
        found = found.withColumn("kind", F.lit("intergenic_region")).withColumn("gene_id", F.lit("NA"))
    else:
        found = annotated(found, *annotation)
    return found.select(
        K.junction_id(F.col("chrom"), F.col("site1"), F.col("site2")).alias("junction_id"),
        "chrom",
        F.col("site1").alias("start"),
        F.col("site2").alias("end"),
        F.col("tp_all").alias("junction_reads"),
        shape_counts(F.col("all_cigars")).alias("shapes"),
        "linear_reads",
        K.junction_ratio(F.col("tp_all"), F.col("linear_reads")).alias("ratio"),
        "kind",
        "gene_id",
        "strand",
        F.array_join("read_ids", ",").alias("read_ids"),
        "score",
    )


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(K.result_order(F.col("chrom")), "start", "end", "junction_id")


def totals(results: DataFrame) -> DataFrame:
    """junctions and the distinct reads that support them."""
    # In one pass: each result is counted at its first read.
    reads = results.select(F.posexplode_outer(F.split("read_ids", ",")).alias("i", "read"))
    per_read = reads.groupBy("read").agg(F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).alias("n"))
    return per_read.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("junctions"), F.count("read").alias("reads"))
