"""Tables of an annotation's exons (chrom, gene_id, transcript_id, start, end, strand, line_no)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exon_boundaries(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chrom, pos, gene_id, strand) of exon starts and of exon ends; the last line of the file holds where several meet."""
    last = lambda c: exons.groupBy("chrom", F.col(c).alias("pos")).agg(F.max_by(F.struct("gene_id", "strand"), F.struct("line_no", "gene_id", "strand")).alias("x")).select("chrom", "pos", "x.*")
    return last("start"), last("end")


def gene_spans(exons: DataFrame) -> DataFrame:
    return exons.groupBy("chrom", "gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def exon_chains(exons: DataFrame) -> DataFrame:
    """gene_id, transcript_id, chain: each transcript's distinct exons in order."""
    rows = exons.where("transcript_id is not null")
    return rows.groupBy("gene_id", "transcript_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("chain"))


def gene_chains(exons: DataFrame) -> DataFrame:
    """gene_id, chain: the distinct chains of a gene's transcripts."""
    return exon_chains(exons).select("gene_id", "chain").distinct()


def splice_pairs(exons: DataFrame) -> DataFrame:
    """chrom, strand, donor, acceptor: the ends and starts of neighbouring exons of a transcript on one strand."""
    rows = exons.where("transcript_id is not null").select("chrom", "transcript_id", "strand", "start", "end").distinct()
    after = F.lead("start").over(Window.partitionBy("chrom", "transcript_id", "strand").orderBy("start", "end"))
    return rows.select("chrom", "strand", F.col("end").alias("donor"), after.alias("acceptor")).where("acceptor is not null").distinct()
