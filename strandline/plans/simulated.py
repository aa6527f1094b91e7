"""Queries on the simulator's tables, with DuckDB SQL that draws the same numbers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simulate
from ..operators.simulate import SimConf
from .queries import UNIFORM, query
from .views import cte, view

CONF = SimConf(seed=3, read_length=100, coverage=10.0, error_rate=0.0, circles=40)


def u(stream: str, *keys: str, seed: int = CONF.seed) -> str:
    return UNIFORM.format("concat_ws('|', " + ", ".join([f"'{seed}'", f"'{stream}'", *keys]) + ")")


def insert_sql(length: str, *keys: str) -> str:
    long = f"case when {u('kind', *keys)} < 0.3 then 450.0 else 350.0 end"
    mean = f"case when {length} <= 300 and {u('short', *keys)} < 0.7 then cast({length} as double) else {long} end"
    return f"cast(greatest(round({mean} + 50.0 * (sqrt(-2 * ln(1 - {u('insertu', *keys)})) * cos(2 * pi() * {u('insertv', *keys)}))), {CONF.read_length}) as int)"


@query(f"select p_partkey, cast(p_size * 20 as int) as length, {insert_sql('p_size * 20', 'p_partkey')} as insert from part")
def insert_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * 20).alias("length"))
    return rows.withColumn("insert", simulate.insert_length(F.col("length"), CONF, "p_partkey"))


ISOFORMS = f"""i0 as (select s_suppkey as k, cast('c' || (s_suppkey // 3) as varchar) as circ_id, 'c' || (s_suppkey // 3) || '.iso' || (1 + s_suppkey % 3) as isoform_id, cast(120 + s_suppkey * 7 % 250 as int) as length from supplier),
    iso as (select circ_id, isoform_id, length, substr(repeat(translate(md5(cast(k as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 12), 1, length) as seq,
      row_number() over (partition by circ_id order by isoform_id) as rank, count(*) over (partition by circ_id) as n from i0),
    use as (select *, cast(case when n = 1 then 1.0 when n = 2 then case when rank = 1 then 0.85 else 0.15 end when rank = 1 then 0.9 else 0.1 / (n - 1) end as double) as usage from iso),
    p as (select *, unnest(range(1, cast(greatest(round(greatest(round(length * {CONF.coverage} / {2 * CONF.read_length}), 1) * usage), 1) as bigint) + 1)) as pair from use),
    q as (select *, {insert_sql('length', 'isoform_id', 'pair')} as insert, cast(floor({u('start', 'isoform_id', 'pair')} * length) as int) as start from p),
    pairs as (select isoform_id || ':' || pair as read_id, circ_id, isoform_id, start, insert, substr(repeat(seq, 3), start % length + 1, 100) as r1,
      reverse(translate(substr(repeat(seq, 3), (start + insert - 100) % length + 1, 100), 'ACGT', 'TGCA')) as r2, cast(start % length + 100 > length as int) as r1_is_bsj, cast((start + insert - 100) % length + 100 > length as int) as r2_is_bsj from q)"""


def isoforms(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    circle = F.concat(F.lit("c"), F.floor(key / 3))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(circle.alias("circ_id"), F.concat(circle, F.lit(".iso"), 1 + key % 3).alias("isoform_id"), (120 + key * 7 % 250).cast("int").alias("length"), F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("b"))
    exons = F.array(F.struct(F.lit(11).alias("start"), (10 + F.col("length")).alias("end")))
    return rows.select("circ_id", "isoform_id", "length", F.expr("substring(repeat(b, 12), 1, length)").alias("seq"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), F.lit("g").alias("gene_id"), F.lit("t").alias("transcript_id"), exons.alias("exons"))


@query(f"with {ISOFORMS} select isoform_id, usage, cast(case when n = 1 then 1.0 when n = 2 then case when rank = 2 then 0.85 else 0.15 end when rank = 1 then 0.9 else 0.1 / (n - 1) end as double) as switched from use")
def usage_profile_table(spark: SparkSession, d: str) -> DataFrame:
    rows = isoforms(spark, d)
    other = simulate.usage_profiles(rows, switching=True).select("isoform_id", F.col("usage").alias("switched"))
    return simulate.usage_profiles(rows).select("isoform_id", F.col("usage").cast("double").alias("usage")).join(other.withColumn("switched", F.col("switched").cast("double")), "isoform_id")


@query(f"with {ISOFORMS} select *, greatest(r1_is_bsj, r2_is_bsj) as is_bsj from pairs")
def circular_reads(spark: SparkSession, d: str) -> DataFrame:
    return simulate.circular_pairs(isoforms(spark, d), CONF)


@query(f"""with {ISOFORMS}, c as (select isoform_id, count(*) as read_cnt, cast(sum(greatest(r1_is_bsj, r2_is_bsj)) as bigint) as bsj_read_cnt from pairs group by all)
    select circ_id, isoform_id, 'chr1' as chrom, '+' as strand, 'g' as gene_id, 't' as transcript_id, length, '11-' || (10 + length) || ':+' as isoform_exons, read_cnt, bsj_read_cnt, cast(10.0 as double) as coverage from iso join c using (isoform_id)""")
def isoform_truth_table(spark: SparkSession, d: str) -> DataFrame:
    rows = isoforms(spark, d)
    return simulate.isoform_truth(rows, simulate.circular_pairs(rows, CONF), CONF)


@query(f"""with {ISOFORMS}, c as (select circ_id, isoform_id, count(*) as read_cnt, cast(sum(greatest(r1_is_bsj, r2_is_bsj)) as bigint) as bsj_read_cnt from pairs group by all)
    select *, read_cnt / sum(read_cnt) over (partition by circ_id) as usage from c""")
def usage_truth_table(spark: SparkSession, d: str) -> DataFrame:
    return simulate.usage_truth(simulate.circular_pairs(isoforms(spark, d), CONF))


@query(f"""with s as (select 't' || c_custkey as transcript_id, cast(60 + c_custkey % 340 as int) as length, substr(repeat(translate(md5(cast(c_custkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 13), 1, cast(60 + c_custkey % 340 as int)) as seq from customer),
    p as (select *, unnest(range(1, cast(greatest(round(length * 10.0 / 200), 0) as bigint) + 1)) as pair from s where length >= 100),
    q as (select *, least({insert_sql('length', 'transcript_id', 'pair')}, length) as insert from p),
    r as (select *, cast(floor({u('lstart', 'transcript_id', 'pair')} * (length - insert + 1)) as int) as start from q)
    select transcript_id || ':' || pair as read_id, transcript_id, start, insert, substr(seq, start + 1, 100) as r1, reverse(translate(substr(seq, start + insert - 99, 100), 'ACGT', 'TGCA')) as r2 from r""")
def linear_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("t"), "c_custkey").alias("transcript_id"), (60 + F.col("c_custkey") % 340).cast("int").alias("length"), F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("b"))
    return simulate.linear_pairs(rows.select("transcript_id", F.expr("substring(repeat(b, 13), 1, length)").alias("seq")), CONF)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (greatest(l_partkey % 100 - l_suppkey % 90, 0) >= 19 and greatest(l_partkey % 100 + cast(l_quantity as int) - l_suppkey % 90 - 30, 0) >= 19) as outward from lineitem")
def outward_truth_flags(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_partkey") % 100, F.col("l_suppkey") % 90
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", simulate.outward_truth(a, a + F.col("l_quantity").cast("int"), b, b + 30).alias("outward"))


EXCLUSIVE = f"""x as (select distinct chrom, "start", "end", strand from gtf where {u('exclusive', 'chrom', '"start"', '"end"', 'strand', seed=7)} < 0.6),
    kept as (select * from gtf where not exists (select 1 from x where x.chrom = gtf.chrom and x."start" = gtf."start" and x."end" = gtf."end" and x.strand = gtf.strand))"""


@query(f"""with {cte('gtf')}, {EXCLUSIVE} select chrom, gene_id, transcript_id, "start", "end", strand, line_no from kept""")
def linear_exon_table(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "gtf")
    return simulate.linear_exons(exons, simulate.exclusive_exons(exons, SimConf(seed=7, exclusive_rate=0.6))).select("chrom", "gene_id", "transcript_id", "start", "end", "strand", "line_no")


@query(f"""with {cte('gtf')}, {EXCLUSIVE}, l as (select line_no * 3 + 2 as line_no, 'exon ' || line_no as raw_line from kept
      union all select min(line_no) * 3 + 1, 'transcript ' || transcript_id from gtf group by transcript_id having transcript_id in (select transcript_id from kept)
      union all select min(line_no) * 3, 'gene ' || gene_id from gtf group by gene_id having gene_id in (select gene_id from kept)) select * from l""")
def linear_annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "gtf")
    rows = exons.select((F.col("line_no") * 3 + 2).alias("line_no"), F.concat(F.lit("exon "), "line_no").alias("raw_line"), F.lit("exon").alias("feature"), "chrom", "gene_id", "transcript_id", "start", "end", "strand")
    whole = lambda kind, key, k: exons.groupBy(key).agg((F.min("line_no") * 3 + k).alias("line_no")).select("line_no", F.concat(F.lit(f"{kind} "), key).alias("raw_line"), F.lit(kind).alias("feature"), key)
    lines = rows.unionByName(whole("transcript", "transcript_id", 1), allowMissingColumns=True).unionByName(whole("gene", "gene_id", 0), allowMissingColumns=True)
    return simulate.linear_annotation(lines, exons, simulate.exclusive_exons(exons, SimConf(seed=7, exclusive_rate=0.6)))


@query(f"""with {cte('gtf')}, t as (select chrom, gene_id, transcript_id, strand, list_sort(list_distinct(list({{'s': "start", 'e': "end"}}))) as ex from gtf group by all),
    c as (select *, len(ex) as n, 2 + cast(floor({u('count', 'transcript_id')} * (least(len(ex), 8) - 1)) as int) as cnt from t where len(ex) >= 2),
    f as (select *, cast(floor({u('first', 'transcript_id')} * (n - cnt + 1)) as int) + 1 as first from c),
    w as (select chrom, gene_id, transcript_id, strand, list_slice(ex, first, first + cnt - 1) as ex from f),
    g as (select *, list_sum(list_transform(ex, lambda x: x.e - x.s + 1)) as total, chrom || ':' || ex[1].s || '|' || ex[-1].e as circ_id from w),
    o as (select * from g where total >= 100 qualify row_number() over (partition by circ_id order by transcript_id) = 1),
    k as (select * from o order by {u('pick', 'transcript_id')}, transcript_id limit 40),
    s as (select *, 2 + cast(floor({u('skip', 'circ_id')} * (len(ex) - 2)) as int) as inner_one from k),
    h as (select *, list_concat(list_slice(ex, 1, inner_one - 1), list_slice(ex, inner_one + 1, len(ex))) as without from s),
    z as (select circ_id, transcript_id, gene_id, chrom, strand, 1 as i, ex from h union all
      select circ_id, transcript_id, gene_id, chrom, strand, 2, without from h where len(ex) > 2 and {u('two', 'circ_id')} < 0.5 and list_sum(list_transform(without, lambda x: x.e - x.s + 1)) >= 100)
    select circ_id, circ_id || '.iso' || i as isoform_id, chrom, gene_id, transcript_id, strand, array_to_string(list_transform(ex, lambda x: x.s || '-' || x.e), ',') as exons, cast(list_sum(list_transform(ex, lambda x: x.e - x.s + 1)) as int) as length from z""")
def chosen_circles(spark: SparkSession, d: str) -> DataFrame:
    rows = simulate.choose_circles(view(spark, d, "gtf"), replace(CONF, max_exons=8))
    return rows.withColumn("exons", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))
