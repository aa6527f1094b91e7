"""Queries that write the derived tables in each file format, to a folder of their own in the shared one, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, simulate
from ..operators.lineage import cut, numbered
from ..sources import text
from .queries import query
from .views import cte, view


def folder(spark: SparkSession) -> str:
    cut(spark.range(1))  # the shared folder is set from now on
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


@query(f"""with {cte('aln')} select read_id, flag, chrom, pos, mapq, cigar, seq, case when pos % 3 = 0 then 'chr2,+' || pos || ',100M,0;' else '*' end as xa from aln""")
def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    xa = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("XA:Z:chr2,+"), "pos", F.lit(",100M,0;")))
    line = F.concat_ws("\t", "read_id", "flag", "chrom", "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.repeat(F.lit("I"), F.length("seq")), F.lit("NM:i:0"), xa, F.lit("MD:Z:1"))
    header = spark.createDataFrame([("@HD\tVN:1.6\tSO:queryname",), ("@SQ\tSN:chr1\tLN:5000",), ("",)], "value string")
    header.unionByName(view(spark, d, "aln").select(line.alias("value"))).write.option("compression", "gzip").text(path)
    return text.read_sam(spark, path).select("read_id", "flag", "chrom", "pos", "mapq", "cigar", "seq", "xa")


@query(f"with {cte('aln')} select 'f' || file_ord || read_id as chrom, cast(length(seq) as int) as length, seq from aln")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    body = F.concat_ws("\n", F.lower(F.substring("seq", 1, 60)), F.expr("substring(seq, 61)"))
    record = F.concat(F.lit(">f"), "file_ord", "read_id", F.lit(" of a > read\n"), body)
    view(spark, d, "aln").select(record).write.text(path)
    return text.read_fasta(spark, path)


GTF_ROWS = """g as (select chrom, 'exon' as feature, gene_id, case when "start" % 7 = 0 then null else transcript_id end as transcript_id, "start", "end", strand from gtf
    union all select chrom, 'gene', gene_id, null, min("start"), max("end"), min(strand) from gtf group by all)"""


@query(f"with {cte('gtf')}, {GTF_ROWS} select * from g")
def gtf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, exons = folder(spark), view(spark, d, "gtf")
    genes = exons.groupBy("chrom", "gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand")).withColumn("feature", F.lit("gene")).withColumn("transcript_id", F.lit(None).cast("string"))
    exons = exons.withColumn("feature", F.lit("exon")).withColumn("transcript_id", F.when(F.col("start") % 7 != 0, F.col("transcript_id"))).drop("line_no")
    named = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; '), F.coalesce(F.concat(F.lit('transcript_id "'), "transcript_id", F.lit('"; ')), F.lit("")), F.lit('gene_name "x";'))
    rows = exons.unionByName(genes).select(F.concat_ws("\t", "chrom", F.lit("src"), "feature", "start", "end", F.lit("."), "strand", F.lit("."), named).alias("value"))
    rows.unionByName(spark.createDataFrame([("#!genome x",), ("chr1\tshort",), ('chr1\tsrc\tCDS\t1\t2\t.\t+\t.\tgene_id "no";',), ('chr1\tsrc\texon\tx\t2\t.\t+\t.\tgene_id "no";',)], "value string")).write.text(path)
    return text.read_gtf(spark, path, ("exon", "gene")).select("chrom", "feature", "gene_id", "transcript_id", "start", "end", "strand")


@query(f"""with {cte('out')} select distinct chrom, "start", "end", case when strand in ('+', '-') then strand else 'NA' end as strand from out""")
def catalog_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    text.write_bed6(cohort.catalog_rows(cohort.merge_samples(view(spark, d, "out"))), path)
    return text.read_bed6(spark, path)


def _sample_results(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "out").groupBy("sample", "chrom", "start", "end").agg(F.sum("reads").alias("junction_reads"), F.min("strand").alias("strand"))
    made = {"junction_id": F.concat("chrom", F.lit(":"), "start", F.lit("|"), "end"), "shapes": F.lit("1_1_0"), "linear_reads": F.col("start") % 9, "ratio": F.round(2.0 * F.col("junction_reads") / (2 * F.col("junction_reads") + F.col("start") % 9), 2), "kind": F.lit("exon"), "gene_id": F.lit("g"), "read_ids": F.lit("a,b"), "score": F.lit(3)}
    return rows.withColumns(made)


RESULT_ROWS = """r as (select sample, chrom, "start", "end", cast(sum(reads) as bigint) as reads, min(strand) as strand from out group by all)"""


@query(f"""with {cte('out')}, {RESULT_ROWS} select sample, chrom || ':' || "start" || '|' || "end" as junction_id, chrom, "start", "end", reads, strand from r where sample in ('s0', 's1')
    union all select 's1_2', chrom || ':' || "start" || '|' || "end", chrom, "start", "end", reads, strand from r where sample = 's2'""")
def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results of three samples, the last in a folder of its own with the second one's name."""
    path, rows = folder(spark), cut(_sample_results(spark, d))
    paths = [f"{path}/s0.out", f"{path}/s1.out", f"{path}/other/s1.out"]
    for k, p in enumerate(paths):
        text.write_results(rows.where(F.col("sample") == f"s{k}").drop("sample"), p)
    return text.read_results(spark, paths)


@query(f"""with {cte('out')}, {RESULT_ROWS}, k as (select *, regexp_replace(chrom, '^chr', '') as b from r where sample = 's3'),
    g as (select *, case when chrom not like 'chr%' then 3 when try_cast(b as int) is not null then 0 when b in ('X', 'Y', 'M') then 1 else 2 end as g, coalesce(try_cast(b as int), case b when 'X' then 23 when 'Y' then 24 else 25 end) as n from k)
    select cast(row_number() over (order by g, case when g < 2 then n else 0 end, case g when 2 then b when 3 then chrom else '' end, "start", "end") as int) as place,
      chrom || ':' || "start" || '|' || "end" || chr(9) || chrom || chr(9) || "start" || chr(9) || "end" || chr(9) || reads || chr(9) || '1_1_0' || chr(9) || ("start" % 9) || chr(9) || printf('%.2f', round(2.0 * reads / (2 * reads + "start" % 9), 2)) || chr(9) || 'exon' || chr(9) || 'g' || chr(9) || strand || chr(9) || 'a,b' || chr(9) || '3' as line from g""")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a result file, as they stand in it."""
    from pyspark.sql import Window

    path = f"{folder(spark)}/s3.out"
    text.write_results(_sample_results(spark, d).where("sample = 's3'").drop("sample"), path)
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("no")).where("no > 0")
    return rows.select(F.row_number().over(Window.orderBy("no")).alias("place"), "line")


@query(f"""with {cte('gtf')} select distinct transcript_id as read_id, 'bsj' as type, gene_id as circ_id, chrom, strand || '1' as r1_segments, 'NA' as r2_segments from gtf""")
def segments_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    rows = view(spark, d, "gtf").select(F.lit("NA").alias("r2_segments"), "chrom", F.col("transcript_id").alias("read_id"), F.lit("bsj").alias("type"), F.lit(7).alias("extra"), F.col("gene_id").alias("circ_id"), F.concat("strand", F.lit("1")).alias("r1_segments")).distinct()
    rows.write.csv(path, sep="\t", header=True, quote="")
    return text.read_segments(spark, path).drop("extra")


@query("select 'c' || c_custkey as sample, '/data/' || c_name as prefix from customer")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("  c"), "c_custkey", F.lit("\t/data/"), "c_name", F.lit(" ")).alias("value"))
    rows.write.text(path)
    return spark.createDataFrame(text.read_manifest(spark, path), "sample string, prefix string")


@query("select cast(row_number() over (order by read_id) as int) as place, read_id || chr(10) || r1 || chr(10) || '+' || chr(10) || repeat('I', length(r1)) as record from (select '@o' || o_orderkey || '/1' as read_id, repeat('ACGT', cast(1 + o_orderkey % 9 as int)) as r1 from orders)")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of one side's reads, as a gzip file holds them."""
    path = folder(spark)
    reads = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("read_id"), F.repeat(F.lit("ACGT"), (1 + F.col("o_orderkey") % 9).cast("int")).alias("r1"))
    simulate.fastq_lines(reads, "r1").write.option("compression", "gzip").text(path)
    rows = spark.read.text(path, lineSep="\n@").select(F.concat(F.lit("@"), F.regexp_replace(F.regexp_replace("value", "^@", ""), "\n$", "")).alias("record"))
    return numbered(rows.withColumn("name", F.substring_index("record", "\n", 1)), "name").select("place", "record")
