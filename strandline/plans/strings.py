"""Queries on sequences, tags, twins, exon offsets, strong linear reads and the review track, with DuckDB SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import keys as K
from ..functions import sequence as S
from ..operators import cohort, linear, segments, summary
from ..operators.detect import candidates_of, exon_offsets
from ..operators.regions import SITE
from .annotation import exon_boundaries
from .queries import CAND, CIG, CONF, ID_SQL, IDS, _classes, _classified_records, query
from .views import cte, view


@query(f"""with {cte('aln')}, s as (select read_id, file_ord, lower(seq[1:30]) || 'nx-' || seq[31:] as s, length(seq) + 3 as n, cast(pos % 140 - 20 as int) as a, cast(mapq as int) as w from aln)
    select read_id, file_ord, reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as strict_rc, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) as rc,
      case when a >= 0 and a + w <= n then substr(s, a + 1, w) end as inside,
      rpad(repeat('N', cast(least(greatest(-a, 0), w) as int)) || substr(s, cast(least(greatest(a, 0), n) as int) + 1, cast(greatest(least(greatest(a + w, 0), n) - least(greatest(a, 0), n), 0) as int)), w, 'N') as padded from s""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    seq = F.concat(F.lower(F.substring("seq", 1, 30)), F.lit("nx-"), F.expr("substring(seq, 31)"))
    rows = view(spark, d, "aln").select("read_id", "file_ord", seq.alias("s"), (F.col("pos") % 140 - 20).cast("int").alias("a"), F.col("mapq").alias("w"))
    s, a, b = F.col("s"), F.col("a"), F.col("a") + F.col("w")
    return rows.select("read_id", "file_ord", S.strict_reverse_complement(s).alias("strict_rc"), S.reverse_complement(s).alias("rc"), S.between(s, a, b).alias("inside"), S.window(s, a, b).alias("padded"))


@query(f"""with {cte('aln')}, {CIG}, m as (select *, length(ls) - length(ltrim(ls, 'IDNSHP=X')) + 1 as i, length(rtrim(ls, 'IDNSHP=X')) as j from p)
    select {ID_SQL}, cast(case when ls like '%M%' then list_sum(list_transform(range(i, j + 1), lambda x: case when ls[x] in ('M', 'D') then ns[x] else 0 end)) else 0 end as int) as between_matches,
      case when mapq > 0 then mapq || 'S' else '' end || '20M' || case when 80 - mapq > 0 then (80 - mapq) || 'S' else '' end as placement,
      case when flag % 3 = 0 then 'chr1,+5,' || cigar || ',0;' else '*' end as xa, case when flag % 2 = 1 then 'g' || mapq end as gene,
      cast(case when mapq + flag > 0 then round(2.0 * mapq / (2 * mapq + flag), 2) else 0 end as double) as ratio from m""")
def tags_and_placements(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln")
    tags = F.when(F.col("flag") % 3 == 0, F.concat(F.lit("NM:i:1\tXA:Z:chr1,+5,"), "cigar", F.lit(",0;\tMD:Z:9"))).otherwise("NM:i:1")
    attributes = F.when(F.col("flag") % 2 == 1, F.concat(F.lit('transcript_id "t"; gene_id "g'), "mapq", F.lit('"; x "y";'))).otherwise('transcript_id "t"')
    return rows.select(*IDS, C.match_to_match_length(F.col("cigar")).alias("between_matches"), C.placement_cigar(F.lit(100), F.col("mapq"), F.lit(20)).alias("placement"), K.xa_tag(tags).alias("xa"), K.quoted_attribute(attributes, "gene_id").alias("gene"), K.junction_ratio(F.col("mapq"), F.col("flag")).alias("ratio"))


# ---------------------------------------------------------------- twins

HASH = """cast(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(concat_ws(chr(9), chrom, site1, site2), ''), lambda c: cast(ascii(c) as bigint))), lambda a, c: (a * 31 + c) % 4294967296) as bigint)"""


def _absorbed(source: str, name: str, shared: str) -> str:
    """Twins over a reference of one letter, where every two stretches align: the first strong junction of a site takes all weak ones."""
    return f"""{name}_j as (select chrom, site1, site2, count(*) filter (where tag = 1 and q = 1) as score, {HASH} as u from {source} where cigar like '%;%' group by all),
      {name}_g as (select *, count(*) over g as n, count(*) filter (where score > 0) over g as strong from {name}_j window g as (partition by chrom, {shared})),
      {name}_p as (select *, xor(u, u >> 16) % (case when n <= 12 then 16 else cast(pow(2, ceil(log2(n / 0.75) - 1e-9)) as bigint) end) as place from {name}_g where strong > 0),
      {name}_f as (select chrom, {shared}, arg_min(site1, (place, site1, site2)) as n1, arg_min(site2, (place, site1, site2)) as n2 from {name}_p where score > 0 group by all),
      {name}_t as (select p.chrom, p.site1, p.site2, n1, n2 from {name}_p p join {name}_f using (chrom, {shared}) where score = 0),
      {name} as (select distinct read_id, cigar, tag, chrom, coalesce(n1, site1) as site1, coalesce(n2, site2) as site2, strand, q from {source} left join {name}_t using (chrom, site1, site2))"""


@query(f"""with {cte('ev')}, base as (select distinct read_id, cigar, tag, chrom, site1, site2, strand, case when (site1 // 50 + site2 // 100) % 3 = 0 then q else least(q, 0) end as q from ev where priority = 1),
    {_absorbed('base', 'one', 'site1')}, {_absorbed('one', 'two', 'site2')} select read_id, cigar, tag, chrom, site1, site2, strand, cast(q as int) as q from two""")
def twins_absorbed(spark: SparkSession, d: str) -> DataFrame:
    sure = (F.floor(F.col("site1") / 50) + F.floor(F.col("site2") / 100)) % 3 == 0
    rows = view(spark, d, "ev").where("priority = 1").withColumn("q", F.when(sure, F.col("q")).otherwise(F.least("q", F.lit(0)))).select("read_id", "cigar", "tag", *SITE, "strand", "q")
    chunks = spark.createDataFrame([(f"chr{k}", 0, 20_000, "A" * 20_000) for k in (1, 2, 3)], "chrom string, chunk int, n int, seq string")
    return summary.absorb_twins(rows, chunks, chunk=20_000)


#: Sites beside the ends of two exons of a gene, in Spark and in DuckDB.
BESIDE = """select distinct a.chrom, cast(a."start" + case when b."end" % 4 >= 1 then a."start" % 5 - 2 else 1 - b."end" % 4 end + 1 - a."start" % 3 as int) as site1,
    cast(b."end" + case when b."end" % 4 >= 1 then a."start" % 5 - 2 else 1 - b."end" % 4 end + 1 - a."start" % 3 as int) as site2, cast(a."start" % 5 - 2 as int) as adj1, cast(b."end" % 4 - 1 as int) as adj2
    from gtf a join gtf b on a.gene_id = b.gene_id and a.chrom = b.chrom and a."start" < b."end\""""


@query(f"""with {cte('gtf')}, s as ({BESIDE}), x as (select *, case when adj2 >= 0 then adj1 else -adj2 end as lead, greatest(case when adj2 >= 0 then 2 + adj1 + adj2 else 2 - adj1 - adj2 end, 0) as n from s),
    o as (select *, unnest(range(0, n + 1)) as off from x), b as (select chrom, "start" as pos, arg_max(gene_id, (line_no, gene_id, strand)) as gene_id, arg_max(strand, (line_no, gene_id, strand)) as strand from gtf group by chrom, "start"),
    e as (select chrom, "end" as pos, arg_max(gene_id, (line_no, gene_id, strand)) as gene_id, arg_max(strand, (line_no, gene_id, strand)) as strand from gtf group by chrom, "end")
    select o.chrom, site1, site2, adj1, adj2, string_agg(off || b.strand, ',' order by off, b.strand) as exons from o join b on o.chrom = b.chrom and b.pos = site1 - lead - 1 + off
      join e on e.chrom = o.chrom and e.pos = site2 - lead - 1 + off and e.gene_id = b.gene_id and e.strand = b.strand group by all""")
def junction_exon_offsets(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "gtf")
    first = exons.select("chrom", "gene_id", F.col("start").alias("s")).distinct()
    both = first.join(exons.select("chrom", "gene_id", F.col("end").alias("e")).distinct(), ["chrom", "gene_id"]).where("s < e")
    both = both.withColumn("adj1", (F.col("s") % 5 - 2).cast("int")).withColumn("adj2", (F.col("e") % 4 - 1).cast("int"))
    move = F.when(F.col("adj2") >= 0, F.col("adj1")).otherwise(-F.col("adj2")) + 1 - F.col("s") % 3
    sites = both.select("chrom", (F.col("s") + move).cast("int").alias("site1"), (F.col("e") + move).cast("int").alias("site2"), "adj1", "adj2").distinct()
    found = exon_offsets(sites, *exon_boundaries(exons))
    return found.select(*SITE, "adj1", "adj2", F.array_join(F.transform("exons", lambda x: F.concat(x["offset"].cast("string"), x["strand"])), ",").alias("exons"))


@query(f"""with {cte('aln', 'ev')}, {CIG}, {CAND}, k as (select *, {_classes(False)} as k from p),
    i as (select read_id, chrom, pos + 6 as lo, pos + (case when cigar = '100M' then 100 else k[4] end) - 7 as hi, case when cigar = '100M' then 0 else k[1] end as style from k where (case when cigar = '100M' then 100 else k[4] end) > 0),
    s as (select distinct chrom, site1, site2, unnest([site1, site2]) as site from cand),
    h as (select distinct read_id, s.chrom, site1, site2 from i join s on i.chrom = s.chrom and (
        (site // 88 = lo // 88 and site >= lo and (site <= hi or style in (1, 10))) or (hi // 88 <> lo // 88 and site // 88 = hi // 88 and site <= hi and (site >= lo or style in (-1, 10))))),
    b as (select read_id, chrom, pos, cigar, unnest(range(1, n + 1)) as i, ns, ls from p),
    m as (select read_id, chrom, pos + coalesce(list_sum(list_transform(range(1, i), lambda j: case when ls[j] in ('M', 'D', 'N', '=', 'X') then ns[j] else 0 end)), 0) as s, ns[i] as w from b where ls[i] in ('M', '=', 'X')),
    g as (select read_id, chrom, pos + ns[1] - 1 as e, pos + ns[1] + ns[2] as f from p where ls = 'MNM' and ns[1] >= 19 and ns[3] >= 19 and ns[2] > 0),
    v as (select h.*, unnest([site1, site2]) as site from h)
    select distinct v.read_id, v.chrom, site1, site2 from v where exists (select 1 from m where m.read_id = v.read_id and m.chrom = v.chrom and site - s + 1 >= 19 and s + w - 1 - site + 1 >= 19)
      or exists (select 1 from g where g.read_id = v.read_id and g.chrom = v.chrom and least(abs(site - e), abs(f - site)) <= 6)""")
def strong_linear(spark: SparkSession, d: str) -> DataFrame:
    """Reads over a junction's site with an anchor on both sides, or at a skipped stretch."""
    records, candidates = _classified_records(spark, d), candidates_of(view(spark, d, "ev"))
    return linear.strong_spanned(records, candidates, 88, 19)


def _segment_reads_sql() -> str:
    from .queries import ORACLE_SQL

    parts = " union ".join(f"select read_id from ({ORACLE_SQL[x]})" for x in ("outward_pairs", "outward_relaxed", "backward_pairs"))
    return f"with {cte('ev')} select read_id from ({parts}) where read_id not in (select read_id from ev where q = 3 and tag < 0)"


@query(_segment_reads_sql())
def segment_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reads without junction evidence that may show a segment, by any of the three rules."""
    return segments.segment_reads(view(spark, d, "aln"), view(spark, d, "ev").where("q = 3 and tag < 0"), CONF)


@query(f"""with {cte('ev')}, e as (select read_id, mate, cigar, tag, chrom, site1, site2, strand, signal_left, signal_right, q, priority, case when q < 2 then 'scan1' else 'scan2' end as stage from ev)
    select *, cast(row_number() over (partition by read_id order by mate, priority desc, stage, cigar, tag, chrom, site1, site2, strand, signal_left, signal_right, q) as int) as place from e""")
def display_order(spark: SparkSession, d: str) -> DataFrame:
    """Both scans' evidence in the order of the display."""
    columns = ["read_id", "mate", "cigar", "tag", *SITE, "strand", "signal_left", "signal_right", "q", "priority"]
    rows = view(spark, d, "ev").select(*columns)
    shown = segments.display_rows(rows.where("q < 2"), rows.where("q >= 2")).withColumn("no", F.monotonically_increasing_id())
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("read_id").orderBy("no"))).drop("no")


@query(f"""with {cte('gtf')}, t as (select distinct transcript_id, gene_id, chrom, strand, "start" as s, "end" as e from gtf), g as (select *, row_number() over (partition by transcript_id order by (s * 7) % 11, s, e, strand) as i from t),
    l as (select *, lag(e) over (partition by transcript_id order by i) as before from g), r as (select *, sum(case when before is not null and s <= before then 1 else 0 end) over (partition by transcript_id order by i rows unbounded preceding) as part from l),
    b as (select transcript_id, gene_id, chrom, part, min(i) as first, count(distinct strand) as n, min(strand) as strand, arg_min(s, i) as pos, arg_max(e, i) as "end", sum(e - s + 1) as w, string_agg(case when prev is null or s - prev <= 1 then '' else (s - prev - 1) || 'N' end || (e - s + 1) || 'M', '' order by i) as cigar
      from (select *, lag(e) over (partition by transcript_id, part order by i) as prev from r) group by transcript_id, gene_id, chrom, part),
    k as (select *, case cast(regexp_extract(gene_id, '[0-9]+') as int) % 4 when 0 then 'bsj' when 1 then 'backward' when 2 then 'outward' end as type from b)
    select transcript_id || '|' || type || '|' || gene_id || '|' || 'R2|part' || cast(part + 1 as bigint) as qname, cast(case when n = 1 and strand = '-' then 16 else 0 end as int) as flag, chrom, cast(pos as int) as pos,
      cast(case type when 'bsj' then 60 when 'backward' then 45 else 30 end as int) as mapq, cigar, repeat('N', cast(w as int)) as seq, case type when 'bsj' then '220,50,47' when 'backward' then '38,139,210' else '133,153,0' end as colour, cast("end" as int) as "end" from k where type is not null""")
def review_track(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "gtf").select("transcript_id", "gene_id", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    token = F.struct(((F.col("s") * 7) % 11).alias("k"), "s", "e", "strand")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda t: F.concat(t["s"], F.lit("-"), t["e"], F.lit(":"), t["strand"])), "|")
    kind = F.element_at(F.array(*map(F.lit, ("bsj", "backward", "outward", "full"))), (F.regexp_extract("gene_id", "[0-9]+", 0).cast("int") % 4 + 1).cast("int"))
    table = rows.groupBy("transcript_id", "gene_id", "chrom").agg(chain.alias("r2_segments")).select(F.col("transcript_id").alias("read_id"), kind.alias("type"), F.col("gene_id").alias("circ_id"), "chrom", F.lit("*").alias("r1_segments"), "r2_segments")
    return segments.review_rows(table)


@query(f"""with {cte('gtf')}, m as (select chrom, max("end") as seen from gtf group by all) select chrom, cast(greatest(case chrom when 'chr1' then 100 when 'chr2' then 100000 else 0 end, seen) as int) as length from m""")
def track_lengths(spark: SparkSession, d: str) -> DataFrame:
    reference = spark.createDataFrame([("chr1", 100), ("chr2", 100_000), ("chr7", 5)], "chrom string, length int")
    return segments.track_lengths(view(spark, d, "gtf"), reference)


@query(f"""with {cte('out')}, s as (select distinct chrom, "start", "end", case when strand in ('+', '-') then strand else 'NA' end as strand, regexp_replace(chrom, '^chr', '') as b from out),
    k as (select *, coalesce(try_cast(b as int), case b when 'X' then 23 when 'Y' then 24 when 'M' then 25 end) as n from s)
    select chrom, "start", "end", strand, cast(dense_rank() over (order by case when n is null then 1 else 0 end, coalesce(n, 0), case when n is null then chrom else '' end, "start", "end", strand) as int) as place from k""")
def cohort_order(spark: SparkSession, d: str) -> DataFrame:
    merged = cohort.merge_samples(view(spark, d, "out")).select("chrom", "start", "end", "strand")
    return merged.withColumn("place", F.dense_rank().over(Window.orderBy(*cohort.catalog_order())))


