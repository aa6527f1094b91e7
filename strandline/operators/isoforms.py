"""Isoforms of circles from segments of reads. This stage is of our own design.

A read's parts are snapped to annotated exons where there are any; chains of exons that start and end at the junction's sites
are counted, and the chain with most reads is the circle's isoform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import chain_parts


def exons_inside(junctions: DataFrame, exons: DataFrame) -> DataFrame:
    """junction_id, start, end of the distinct annotated exons inside each junction (junction_id, chrom, start, end).

    Joined by stretches of 2 ** 17 bases.
    """
    stretch = lambda c: F.floor(F.col(c) / (1 << 17)).cast("int")
    own = junctions.select("junction_id", "chrom", F.col("start").alias("lo"), F.col("end").alias("hi")).withColumn("stretch", F.explode(F.sequence(stretch("lo"), stretch("hi"))))
    parts = exons.select("chrom", "start", "end").distinct().withColumn("stretch", stretch("start"))
    return own.join(parts, ["chrom", "stretch"]).where("start >= lo and end <= hi").select("junction_id", "start", "end").distinct()


def read_chains(segments: DataFrame) -> DataFrame:
    """read_id, circ_id, blocks: the parts of both mates of a read, in order of place."""
    mates = F.explode(F.array("r1_segments", "r2_segments"))
    rows = segments.select("read_id", "circ_id", mates.alias("chain")).where("chain is not null")
    rows = rows.withColumn("mate", F.monotonically_increasing_id())
    parts = chain_parts(rows, ["read_id", "circ_id", "mate"])
    return parts.select("read_id", "circ_id", F.explode("blocks").alias("b")).select("read_id", "circ_id", "b.start", "b.end").distinct()


def isoform_chains(junctions: DataFrame, exons: DataFrame, blocks: DataFrame) -> DataFrame:
    """junction_id, isoform_id, exons, reads, type, evidence: the best chain of each junction.

    An exon is in the chain if a block of a read touches it, or if no block touches any and it lies inside: then the chain is an
    estimate by annotation. Without exons the circle is one block. blocks: circ_id, start, end, read_id.
    """
    inside = exons_inside(junctions, exons)
    b = blocks.select(F.col("circ_id").alias("junction_id"), "read_id", F.col("start").alias("a"), F.col("end").alias("z"))
    touched = inside.join(b, "junction_id", "left").groupBy("junction_id", "start", "end").agg(F.count_distinct(F.when((F.col("a") <= F.col("end")) & (F.col("z") >= F.col("start")), F.col("read_id"))).alias("reads"))
    any_read = F.max("reads").over(Window.partitionBy("junction_id")) > 0
    chosen = touched.withColumn("told", any_read).where(~F.col("told") | (F.col("reads") > 0))
    chains = chosen.groupBy("junction_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"), F.sum("reads").alias("reads"), F.max("told").alias("told"))
    whole = F.array(F.struct("start", "end"))
    rows = junctions.select("junction_id", "chrom", "strand", "gene_id", "start", "end").join(chains, "junction_id", "left")
    rows = rows.withColumn("exons", F.coalesce("exons", whole))
    return rows.select("junction_id", F.concat("junction_id", F.lit(".iso1")).alias("isoform_id"), "chrom", "strand", "gene_id", "exons", F.coalesce("reads", F.lit(0)).alias("reads"), F.when(F.coalesce("told", F.lit(False)), "mature").otherwise("estimate").alias("type"), F.when(F.coalesce("told", F.lit(False)), "phased_junction").when(F.col("reads").isNotNull(), "annotation_guided").otherwise("unphased_junction").alias("evidence"))


def gtf_lines(isoforms: DataFrame) -> DataFrame:
    """value: one line for each exon of isoforms, with its attributes."""
    rows = isoforms.select("*", F.posexplode("exons").alias("i", "x"))
    attributes = F.format_string('gene_id "%s"; transcript_id "%s"; type "%s"; evidence "%s"; bsj_reads "%d"; exon_count "%d";', "gene_id", "isoform_id", "type", "evidence", "reads", F.size("exons"))
    return rows.orderBy("chrom", "x.start", "isoform_id").select(F.concat_ws("\t", "chrom", F.lit("strandline"), F.lit("exon"), F.col("x.start").cast("string"), F.col("x.end").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("value"))
