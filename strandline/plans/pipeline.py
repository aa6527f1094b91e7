"""The detection pipeline on files or tables: both scans, results, catalogs of many samples and the second pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConf
from ..operators import cohort, detect, linear, read_groups, segments, summary
from ..operators.lineage import cut
from ..operators.regions import SITE
from .annotation import exon_boundaries, gene_spans


@dataclass
class Detection:
    """Tables of a run."""

    first: DataFrame
    second: DataFrame
    candidates: DataFrame
    linear: DataFrame
    keys: DataFrame
    results: DataFrame

    @property
    def display(self) -> DataFrame:
        return segments.display_rows(self.first, self.second)

    @property
    def arcs(self) -> DataFrame:
        return segments.arc_rows(self.results)


def detect_junctions(alignments: DataFrame, chunks: DataFrame, conf: EngineConf | None = None, exons: DataFrame | None = None, catalog: DataFrame | None = None, chunk: int = 1 << 20, read_length: int | None = None) -> Detection:
    """Both scans and the results of one sample.

    alignments: read_id, flag, chrom, pos, mapq, cigar, seq, file_ord. chunks: the reference in stretches. exons: an annotation.
    catalog: chrom, start, end, strand of known junctions, for a second pass.
    """
    conf = conf or EngineConf()
    if read_length is None:
        read_length = read_groups.read_counts(alignments).first().read_length
    boundaries = exon_boundaries(exons) if exons is not None else None
    first = detect.scan_pairs(alignments, chunks, conf, boundaries, chunk)
    candidates = detect.candidates_of(first)
    if catalog is not None:
        candidates = detect.with_catalog(candidates, catalog)
    claims = first.where("priority = 1").select("read_id").distinct()
    second, keys = detect.scan_clips(alignments, candidates, claims, chunks, conf, read_length, chunk)
    first, second, keys = cut(first), cut(second), cut(keys)
    evidence = cut(summary.absorb_twins(first.unionByName(second).where("priority = 1"), chunks, chunk=chunk))
    counts = linear.linear_counts(keys, candidates, once=True)
    annotation = (*boundaries, exons, gene_spans(exons)) if exons is not None else None
    return Detection(first, second, candidates, counts, keys, summary.summarize(evidence, counts, conf.stringency, annotation))


def cohort_catalog(results: dict[str, DataFrame]) -> DataFrame:
    """chrom, start, end, strand, cohort_id, samples, reads over the results of samples."""
    rows = None
    for sample, result in results.items():
        part = result.select(F.lit(sample).alias("sample"), "junction_id", "chrom", "start", "end", "strand", F.col("junction_reads").alias("reads"))
        rows = part if rows is None else rows.unionByName(part)
    return cohort.merge_samples(rows)


def second_pass(alignments: DataFrame, chunks: DataFrame, catalog: DataFrame, conf: EngineConf | None = None, exons: DataFrame | None = None, chunk: int = 1 << 20) -> Detection:
    return detect_junctions(alignments, chunks, conf, exons, catalog.select("chrom", "start", "end", "strand"), chunk)


def detect_file(spark: SparkSession, path: str, reference: str, annotation: str | None = None, conf: EngineConf | None = None) -> Detection:
    """As detect_junctions, for a SAM or BAM file, a FASTA and a GTF."""
    from ..sources import bam, text

    alignments = bam.read_bam(spark, path) if bam.is_bam(path) else text.read_sam(spark, path)
    chunks = text.reference_chunks(text.read_fasta(spark, reference))
    exons = text.read_gtf(spark, annotation) if annotation else None
    return detect_junctions(alignments, chunks, conf, exons)


__all__ = ["SITE", "Detection", "cohort_catalog", "detect_file", "detect_junctions", "second_pass"]
