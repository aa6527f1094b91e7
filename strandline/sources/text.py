"""Text formats as DataFrames: SAM, FASTA, GTF, BED6, results, segments; schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K

CHUNK = 1 << 20
RESULT_COLUMNS = ["junction_id", "chrom", "start", "end", "junction_reads", "shapes", "linear_reads", "ratio", "kind", "gene_id", "strand", "read_ids", "score"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line, file_name, line_no: line_no rises within a file (blocks are read in order), without being dense."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("line_no", F.monotonically_increasing_id()).drop("block")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_id, flag, chrom, pos, mapq, cigar, seq, xa, file_ord, file_name of the records; header lines are left out.

    Broken numbers are 0, missing names an error, as is a record of fewer than eleven fields.
    """
    rows = _lines(spark, path).where(~F.col("line").startswith("@") & (F.col("line") != ""))
    f = F.split("line", "\t", 12)
    number = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("int"), F.lit(0))
    text = lambda i: F.get(f, F.lit(i))
    name = F.when((F.size(f) >= 11) & (text(0) != ""), text(0)).otherwise(F.raise_error(F.concat(F.lit("no SAM record: "), F.left("line", F.lit(80)))))
    return rows.select(name.alias("read_id"), number(1).alias("flag"), text(2).alias("chrom"), number(3).alias("pos"), number(4).alias("mapq"), text(5).alias("cigar"), text(9).alias("seq"), K.xa_tag(F.coalesce(text(11), F.lit(""))).alias("xa"), F.col("line_no").alias("file_ord"), "file_name")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, seq: names up to the first blank, bases in upper case.

    A file is split at its records, not at lines, so that each record is a row of its own and files may be of any size; a record
    must fit a row (2 GB).
    """
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("record"))
    head = F.substring_index(F.substring_index("record", "\n", 1), "\r", 1)
    seq = F.upper(F.translate(F.expr("substring(record, length(substring_index(record, '\\n', 1)) + 1)"), "\n\r\t >", ""))
    rows = rows.where(F.trim(F.translate("record", "\n\r", "")) != "").select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("chrom"), seq.alias("seq"))
    return rows.select("chrom", F.length("seq").alias("length"), "seq")


def reference_chunks(reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chrom, chunk, n, seq: stretches of chunk bases of each chromosome, n bases long in all."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest("length", F.lit(1)) - 1) / chunk).cast("int")), lambda k: F.struct(k.alias("chunk"), F.substring("seq", k * chunk + 1, F.lit(chunk)).alias("seq")))
    return reference.select("chrom", F.col("length").alias("n"), F.explode(pieces).alias("p")).select("chrom", "p.chunk", "n", "p.seq")


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    """chrom, feature, gene_id (NA if it is not told), transcript_id, start, end, strand, line_no, raw_line of the features."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(~F.col("line").startswith("#") & (F.size(f) >= 9))
    at = lambda i: F.get(f, F.lit(i))
    rows = rows.select(at(0).alias("chrom"), at(2).alias("feature"), F.coalesce(K.quoted_attribute(at(8), "gene_id"), F.lit("NA")).alias("gene_id"), K.quoted_attribute(at(8), "transcript_id").alias("transcript_id"), at(3).try_cast("int").alias("start"), at(4).try_cast("int").alias("end"), at(6).alias("strand"), "line_no", F.col("line").alias("raw_line"))
    return rows.where(F.col("feature").isin(*features) & F.col("start").isNotNull() & F.col("end").isNotNull())


def read_bed6(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (from 1), end, strand (+, - or NA) of a catalog: distinct, blank and header lines left out, bad ones an error."""
    line = F.trim("line")
    rows = _lines(spark, path).where((line != "") & ~line.rlike("^(#|track|browser)"))
    f = F.split(line, r"\s+")
    start, end = F.get(f, F.lit(1)).try_cast("int"), F.get(f, F.lit(2)).try_cast("int")
    fine = (F.size(f) >= 6) & (start >= 0) & (end > start)
    chrom = F.when(F.coalesce(fine, F.lit(False)), F.get(f, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no catalog line: "), F.col("line"))))
    return rows.select(chrom.alias("chrom"), (start + 1).alias("start"), end.alias("end"), K.strand_or_na(F.get(f, F.lit(5))).alias("strand")).distinct()


def write_bed6(rows: DataFrame, path: str) -> None:
    """One sorted file of catalog_rows."""
    ordered = rows.orderBy(K.natural_order(F.col("chrom")), "start0", "end", "strand")
    ordered.select(F.concat_ws("\t", "chrom", "start0", "end", "name", "score", "strand")).coalesce(1).write.mode("overwrite").text(path)


def sample_name(path: Column) -> Column:
    """A file's name without one .out at the end."""
    return F.regexp_replace(F.url_decode(F.regexp_extract(path, "([^/]+)/?$", 1)), r"\.out$", "")


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sample, junction_id, chrom, start, end, reads, strand of result files; repeated names get _2, _3 in the order of paths.

    Blank lines, comments and headers are left out; short lines and negative or broken reads are an error.
    """
    named = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, place int").withColumn("sample", sample_name(F.col("path")))
    k = F.row_number().over(Window.partitionBy("sample").orderBy("place"))
    names = {r.path: r.sample for r in named.withColumn("sample", F.when(k == 1, F.col("sample")).otherwise(F.concat("sample", F.lit("_"), k))).collect()}
    out = None
    for path in paths:
        line = F.col("line")
        rows = _lines(spark, path).where((F.trim(line) != "") & ~line.startswith("#") & ~line.rlike("^(junction_id|circRNA_ID)\t"))
        f = F.split(line, "\t")
        at = lambda i, f=f: F.get(f, F.lit(i))
        reads = at(4).try_cast("long")
        fine = F.coalesce((F.size(f) >= 11) & (reads >= 0), F.lit(False))
        checked = F.when(fine, reads).otherwise(F.raise_error(F.concat(F.lit("no result line: "), line)))
        part = rows.select(F.lit(names[path]).alias("sample"), at(0).alias("junction_id"), at(1).alias("chrom"), at(2).cast("int").alias("start"), at(3).cast("int").alias("end"), checked.alias("reads"), at(10).alias("strand"))
        out = part if out is None else out.unionByName(part)
    return out


def write_results(results: DataFrame, path: str) -> None:
    """One file with a header, in the order of results; the ratio has two decimals."""
    from ..operators.summary import ordered

    rows = ordered(results).withColumn("ratio", F.format_string("%.2f", "ratio"))
    rows.select(*RESULT_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments by the names in the header; read_id, type, circ_id, chrom, r1_segments and r2_segments must be there."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    missing = {"read_id", "type", "circ_id", "chrom", "r1_segments", "r2_segments"} - set(rows.columns)
    if missing:
        raise ValueError(f"segments without {', '.join(sorted(missing))}")
    return rows


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(sample, prefix) of a sample list: two fields a line, each sample once."""
    out: dict[str, str] = {}
    for row in spark.read.text(path).where(F.trim("value") != "").toLocalIterator():
        fields = row.value.split()
        if len(fields) != 2 or fields[0] in out:
            raise ValueError(f"no sample line: {row.value}")
        out[fields[0]] = fields[1]
    return list(out.items())
