"""Catalogs of many samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K

KEY = ["chrom", "start", "end", "strand"]


def sample_support(rows: DataFrame) -> DataFrame:
    """chrom, start, end, strand, sample, junction_ids, reads of result rows (sample, junction_id, chrom, start, end, strand,
    reads). Strands other than + and - are NA; negative reads are an error."""
    checked = F.when(F.col("reads") >= 0, F.col("reads")).otherwise(F.raise_error(F.concat(F.lit("negative reads at "), F.col("junction_id"))))
    rows = rows.withColumn("strand", K.strand_or_na(F.col("strand"))).withColumn("reads", checked.cast("long"))
    return rows.groupBy(*KEY, "sample").agg(F.array_join(F.array_sort(F.collect_set("junction_id")), ",").alias("junction_ids"), F.sum("reads").alias("reads"))


def merge_samples(rows: DataFrame) -> DataFrame:
    """chrom, start, end, strand, cohort_id, samples, reads: one row for each junction of the cohort."""
    merged = sample_support(rows).groupBy(*KEY).agg(F.count_distinct("sample").alias("samples"), F.sum("reads").alias("reads"))
    return merged.withColumn("cohort_id", K.junction_id(F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")))


def catalog_order() -> list[Column]:
    return [K.natural_order(F.col("chrom")), F.col("start"), F.col("end"), F.col("strand")]


def catalog_rows(merged: DataFrame) -> DataFrame:
    """BED6 of merge_samples: the start from 0, the score the reads, from 0 to 1000."""
    return merged.select("chrom", (F.col("start") - 1).alias("start0"), "end", F.col("cohort_id").alias("name"), K.clamp(F.col("reads"), 0, 1000).alias("score"), "strand")


def sample_matrix(support: DataFrame, samples: list[str]) -> DataFrame:
    """One column of reads for each of the given samples, zero where it has none."""
    return support.groupBy(*KEY).pivot("sample", samples).agg(F.sum("reads")).na.fill(0)


def run_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("sample").alias("samples"), F.count("*").alias("rows"), F.count_distinct(F.struct(*KEY)).alias("junctions"), F.sum("reads").cast("long").alias("reads"))


def unique_names(samples: DataFrame, name: str = "sample", place: str = "place") -> DataFrame:
    """Names that come again get _2, _3 and so on, in order of place."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(place))
    return samples.withColumn(name, F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), k.cast("string"))))


def usage_of_isoforms(reads: DataFrame) -> DataFrame:
    """sample, junction_id, isoform_id, reads, usage: each isoform's share of its junction's reads in a sample.

    reads: sample, junction_id, isoform_id, reads."""
    per = reads.groupBy("sample", "junction_id", "isoform_id").agg(F.sum("reads").alias("reads"))
    whole = F.sum("reads").over(Window.partitionBy("sample", "junction_id"))
    return per.withColumn("usage", F.col("reads") / F.greatest(whole, F.lit(1)))


def switching(usage: DataFrame, least: float = 0.5) -> DataFrame:
    """junction_id, isoforms, samples: the junctions whose main isoform, with a usage of at least ``least``, differs by sample."""
    main = usage.groupBy("sample", "junction_id").agg(F.max_by("isoform_id", F.struct("usage", "isoform_id")).alias("main"), F.max("usage").alias("usage"))
    told = main.where(F.col("usage") >= least).groupBy("junction_id").agg(F.array_sort(F.collect_set("main")).alias("isoforms"), F.count("*").alias("samples"))
    return told.where(F.size("isoforms") > 1).select("junction_id", F.array_join("isoforms", ",").alias("isoforms"), "samples")
