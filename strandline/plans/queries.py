"""The registered queries on alignments, evidence and catalogs, each with DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConf
from ..functions import cigar as C
from ..functions import keys as K
from ..functions import sequence as S
from ..operators import cohort, linear, pairs, read_groups, segments, simulate, summary
from ..operators.detect import candidates_of, near_sites, with_catalog
from ..operators.lineage import cut
from ..operators.regions import SITE
from ..operators.simulate import SimConf
from .annotation import exon_boundaries, exon_chains, gene_spans, splice_pairs
from .views import cte, view

CONF = EngineConf(min_span=20, max_span=5000)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A CIGAR's operations, in DuckDB: lengths, letters (H as S), and sums.
CIG = """o as (select *, list_transform(regexp_extract_all(case when regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') then cigar else '' end, '[0-9]+'), lambda x: cast(x as int)) as ns,
    regexp_replace(replace(case when regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') then cigar else '' end, 'H', 'S'), '[0-9]+', '', 'g') as ls from aln),
  p as (select *, length(ls) as n, ns[1] as f, ns[-1] as l, left(ls, 1) || right(ls, 1) as ends,
    coalesce(list_sum(list_transform(range(1, length(ls) + 1), lambda i: case when ls[i] in ('M', 'D') then ns[i] else 0 end)), 0) as md,
    coalesce(list_sum(list_transform(range(1, length(ls) + 1), lambda i: case when ls[i] in ('M', 'D', '=', 'X') then ns[i] else 0 end)), 0) as mdx,
    coalesce(list_sum(list_transform(range(1, length(ls) + 1), lambda i: case when ls[i] in ('M', 'D', 'N', '=', 'X') then ns[i] else 0 end)), 0) as rl from o)"""
IDS = ["read_id", "file_ord", "flag", "chrom", "pos", "cigar"]
ID_SQL = "read_id, file_ord, flag, chrom, pos, cigar"


def _classes(relaxed: bool) -> str:
    lone = "ls = 'M' and ns[1] = 100" if relaxed else "ls = 'M'"
    three = "n = 3 and ends = 'SS'" if relaxed else "ls = 'SMS'"
    s = "mdx" if relaxed else "md"
    return f"""case when cigar = '*' then [0, 0, 0, -1] when n = 0 then [0, 0, 0, -2]
        when n = 1 then case when {lone} then [0, 0, 0, 100] else [0, 0, 0, -1] end
        when ls = 'MS' then [1, f, f - 1, f] when ls = 'SM' then [-1, f, 0, l]
        when {three} then [10, f, l, ns[2]]
        when ls = 'MDM' then [0, 0, 0, 100 + ns[2]] when ls = 'MIM' then [0, 0, 0, 100 - ns[2]]
        when n < 4 then [0, 0, 0, -2]
        when ends = 'MS' then [1, 100 - l, {s} - 1, {s}] when ends = 'SM' then [-1, f, 0, {s}]
        when ends = 'MM' then [0, 0, 0, {s}] when ends = 'SS' then [10, f, l, {s}] else [0, 0, 0, -2] end"""


def _classified(relaxed: bool) -> str:
    return f"with {cte('aln')}, {CIG}, c as (select *, {_classes(relaxed)} as k from p) select {ID_SQL}, cast(k[1] as int) as kind, cast(k[2] as int) as a, cast(k[3] as int) as b, cast(k[4] as int) as ref from c"


@query(f"with {cte('aln')} select read_id, file_ord, replace(cigar, 'H', 'S') as soft_cigar, cigar = '100M' as is_full, (flag // 16) % 2 = 1 as reverse from aln where mapq >= 10 and chrom <> 'chrM' and cigar <> '*'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").where((F.col("mapq") >= CONF.min_mapq) & (F.col("chrom") != "chrM") & (F.col("cigar") != "*"))
    return rows.select("read_id", "file_ord", C.soft(F.col("cigar")).alias("soft_cigar"), C.full_match(F.col("cigar"), F.length("seq")).alias("is_full"), read_groups.reverse_strand(F.col("flag")).alias("reverse"))


@query(_classified(False))
def cigar_classify(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "aln").withColumn("k", C.classify(F.col("cigar"), F.length("seq"))).select(*IDS, "k.*")


@query(_classified(True))
def cigar_classify_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "aln").withColumn("k", C.classify(F.col("cigar"), F.length("seq"), relaxed=True)).select(*IDS, "k.*")


@query(f"""with {cte('aln')}, {CIG} select {ID_SQL}, cast(rl as int) as ref_length,
    cast(coalesce(list_sum(list_transform(range(1, n + 1), lambda i: case when ls[i] in ('M', 'I', 'S', '=', 'X') and not (cigar like '%H' and i = n) then ns[i] else 0 end)), 0) as int) as query_length,
    case when rl > 0 then cast(pos + rl - 1 as int) end as span_end,
    cast(len(list_filter(range(1, n + 1), lambda i: ls[i] in ('M', '=', 'X'))) as int) as n_blocks from p""")
def cigar_span_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    return view(spark, d, "aln").select(*IDS, C.reference_length(c).alias("ref_length"), C.query_length(c).alias("query_length"), C.span_end(F.col("pos"), c).alias("span_end"), F.size(C.match_blocks(F.col("pos"), c)).alias("n_blocks"))


@query(f"""with {cte('aln')}, s as (select distinct chrom, cigar, regexp_replace(cigar, '[^A-Za-z]', '', 'g') as t from aln where cigar <> '*'),
    k as (select chrom, case when t = 'M' then null when regexp_matches(t, '^[^M].*M.*[^M]$') then 'SMS' when t like 'M%' then 'MS' else 'SM' end as shape from s)
    select chrom, shape, count(*) as n from k where shape is not null group by all""")
def cigar_shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").where("cigar <> '*'").select("chrom", "cigar").distinct().withColumn("shape", C.shape_class(F.col("cigar")))
    return rows.where("shape is not null").groupBy("chrom", "shape").agg(F.count("*").alias("n"))


@query(f"with {cte('aln')} select read_id, file_ord, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, case when (flag // 16) % 2 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as oriented from aln")
def revcomp_orient(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "aln").select("read_id", "file_ord", S.reverse_complement(F.col("seq")).alias("rc"), S.oriented(F.col("seq"), ~read_groups.reverse_strand(F.col("flag"))).alias("oriented"))


@query(f"""with {cte('aln')}, {CIG}, q as (select *, concat_ws(',', case when regexp_matches(cigar, '^[0-9]+S') then 'L:' || seq[1:f] end, case when cigar like '%S' then 'R:' || right(seq, l) end) as t from p)
    select {ID_SQL}, case when t = '' then '*' else t end as clips, nullif(regexp_extract(t, 'L:([ACGT]*)', 1), '') as left_clip, nullif(regexp_extract(t, 'R:([ACGT]*)', 1), '') as right_clip from q""")
def clip_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").withColumn("clips", C.clip_payload(F.col("cigar"), F.col("seq")))
    parts = C.clip_parts(F.col("clips"))
    return rows.select(*IDS, "clips", F.try_element_at(parts, F.lit("L")).alias("left_clip"), F.try_element_at(parts, F.lit("R")).alias("right_clip"))


@query(f"""with {cte('aln')}, g as (select *, cast((flag // 64) % 2 as int) as slot from aln)
    select read_id, slot, count(*) as n_records, arg_min(seq, (-length(seq), file_ord, flag)) as best_seq, (arg_min(flag, (-length(seq), file_ord, flag)) // 16) % 2 = 1 as best_reverse,
        string_agg(cigar, '|' order by file_ord, flag, chrom, pos, mapq, cigar, seq) as cigars
    from g group by read_id, slot qualify sum(count(*)) over (partition by read_id) > 2 or count(*) over (partition by read_id) = 1""")
def read_group_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = read_groups.work_groups(read_groups.with_slots(view(spark, d, "aln")))
    return rows.select("read_id", "slot", F.size("records").cast("long").alias("n_records"), F.col("best.seq").alias("best_seq"), F.col("best.reverse").alias("best_reverse"), F.array_join(F.transform("records", lambda r: r["cigar"]), "|").alias("cigars"))


@query(f"""with {cte('aln')}, g as (select *, cast((flag // 64) % 2 as int) as slot from aln),
    s as (select *, coalesce(lag(slot) over w <> slot, true) as sw from g window w as (partition by read_id order by file_ord, flag, chrom, pos, mapq, cigar, seq)),
    r as (select *, sum(cast(sw as int)) over (partition by read_id order by file_ord, flag, chrom, pos, mapq, cigar, seq rows unbounded preceding) as run from s)
    select read_id, slot, file_ord, cast(run as bigint) as run, cigar from r qualify run = max(run) over (partition by read_id, slot)""")
def mate_switch_runs(spark: SparkSession, d: str) -> DataFrame:
    return read_groups.last_runs(view(spark, d, "aln")).select("read_id", "slot", "file_ord", F.col("run").cast("long").alias("run"), "cigar")


def _classified_records(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").withColumn("L", F.length("seq")).withColumn("slot", read_groups.slot(F.col("flag"))).withColumn("ord", F.col("file_ord"))
    return pairs.classified(rows.withColumn("cigar", C.soft(F.col("cigar"))), F.col("L"))


PAIRS = f"""k as (select read_id, cast((flag // 64) % 2 as int) as slot, file_ord as ord, flag, chrom, pos, mapq, replace(cigar, 'H', 'S') as cigar, {_classes(False)} as k from p),
    b as (select x.read_id, x.slot, x.chrom, x.ord as ord_1, y.ord as ord_2, x.k[1] > y.k[1] as swap, x.flag as flag, x.cigar || ';' || y.cigar as cigars,
        case when x.k[1] > y.k[1] then y.k else x.k end as kx, case when x.k[1] > y.k[1] then x.k else y.k end as ky,
        case when x.k[1] > y.k[1] then y.pos else x.pos end as px, case when x.k[1] > y.k[1] then x.pos else y.pos end as py,
        case when x.k[1] > y.k[1] then y.mapq else x.mapq end as mx, case when x.k[1] > y.k[1] then x.mapq else y.mapq end as my
      from k x join k y on x.read_id = y.read_id and x.slot = y.slot and x.ord < y.ord and x.chrom = y.chrom and (x.flag // 16) % 2 = (y.flag // 16) % 2
      where x.chrom <> 'chrM' and (x.mapq >= 10 or y.mapq >= 10) and x.cigar <> '*' and y.cigar <> '*'),
    s as (select *, case when kx[1] = -1 and ky[1] = 1 then 'ends' when kx[1] = -1 and ky[1] = 10 then 'left' when kx[1] = 1 and ky[1] = 10 then 'right' end as style from b),
    t as (select *, case style when 'ends' then py + ky[3] - px when 'left' then py + ky[4] - 1 - px else px + kx[4] - 1 - py end as span,
        case style when 'left' then 100 - ky[3] - kx[2] else kx[2] - ky[2] end as slack,
        case style when 'ends' then ky[2] - kx[2] when 'left' then ky[2] + ky[4] - kx[2] else kx[2] - ky[2] end as shift from s where style is not null),
    u as (select *, cast(trunc(shift / 2.0) as int) as adj1, shift - cast(trunc(shift / 2.0) as int) as adj2 from t where span > 0 and span between 20 and 5000 and abs(slack) <= 6),
    w as (select *, case style when 'right' then py else px end + adj1 as site1, case style when 'right' then px + kx[4] else py + ky[4] end - 1 - adj2 as site2 from u where abs(adj1) <= 4)"""


@query(f"with {cte('aln')}, {CIG}, {PAIRS} select read_id, slot, ord_1, ord_2, style, cast(span as int) as span, adj1, cast(adj2 as int) as adj2, chrom, cast(site1 as int) as site1, cast(site2 as int) as site2, cast((mx >= 10 and my >= 10) as int) as sum_q, cigars from w")
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.candidate_pairs(_classified_records(spark, d), CONF, ["read_id", "slot"])
    return found.select("read_id", "slot", "ord_1", "ord_2", "style", "span", "adj1", "adj2", *SITE, "sum_q", "cigars")


@query(f"""with {cte('aln')}, {CIG}, {PAIRS}, m as (select w.read_id, w.slot, w.ord_1, w.ord_2, w.site1, w.site2, w.flag, list(r order by r.file_ord) filter (where r.chrom = w.chrom and r.mapq >= 10) as near, count(r.read_id) as n
      from w left join p r on r.read_id = w.read_id and cast((r.flag // 64) % 2 as int) = 1 - w.slot group by all)
    select read_id, slot, ord_1, ord_2, cast(site1 as int) as site1, cast(site2 as int) as site2, cast(case when n = 0 then 1 when near is null then 0 when near[1].pos >= site1 - 6 and near[1].pos + near[1].rl - 1 <= site2 + 6 and (near[1].flag // 16) % 2 <> (flag // 16) % 2 then 1 else -1 end as int) as agrees from m""")
def mate_consistency(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.candidate_pairs(_classified_records(spark, d), CONF, ["read_id", "slot"])
    found = cut(found.select("read_id", "slot", "ord_1", "ord_2", *SITE, "flag"))
    rows = found.join(pairs.mates_of(view(spark, d, "aln"), found), ["read_id", "slot"], "left")
    agrees = pairs.mate_flag(F.coalesce("mates", F.array()), F.col("chrom"), read_groups.reverse_strand(F.col("flag")), F.col("site1"), F.col("site2"), F.col("mates").isNotNull(), CONF)
    return rows.select("read_id", "slot", "ord_1", "ord_2", "site1", "site2", agrees.alias("agrees"))


def _signal_sql(signals: tuple) -> str:
    cases = " ".join(f"when x = '{a}' and y = '{b}' then '{s}'" for a, b, s in reversed(signals))
    return f"""with {cte('aln')}, w as (select read_id, file_ord, unnest(range(0, 19)) as i, seq from aln),
        v as (select read_id, file_ord, i, seq[i + 1:i + 2] as x, seq[i + 51:i + 52] as y from w),
        h as (select read_id, file_ord, cast(i as int) as shift, case {cases} end as strand, x as signal_left, y as signal_right from v)
        select read_id, file_ord, shift, strand, signal_left, signal_right from h where strand is not null"""


def _signals(spark: SparkSession, d: str, relaxed: bool) -> DataFrame:
    found = S.signal_rows(view(spark, d, "aln").select("read_id", "file_ord", "seq"), F.substring("seq", 1, 20), F.substring("seq", 51, 20), relaxed)
    return found.select("read_id", "file_ord", "shift", "strand", "signal_left", "signal_right")


@query(_signal_sql(S.SIGNALS))
def splice_signal(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, False)


@query(_signal_sql(S.RELAXED_SIGNALS))
def splice_signal_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, True)


CAND = "cand as (select distinct chrom, site1, site2, strand, signal_left, signal_right from ev where priority = 1)"


@query(f"""with {cte('aln', 'ev')}, {CIG}, {CAND}, k as (select *, {_classes(False)} as k from p)
    select read_id, file_ord, cand.chrom, site1, site2, strand, cast(site1 - pos as int) as distance from k join cand on k.chrom = cand.chrom and abs(site1 - pos) <= 6 where k[1] in (-1, 10)""")
def band_join_sites(spark: SparkSession, d: str) -> DataFrame:
    records = _classified_records(spark, d).where("kind in (-1, 10)")
    found = near_sites(records, candidates_of(view(spark, d, "ev")), "pos", "site1", CONF.site_slack, 88)
    return found.select("read_id", "file_ord", *SITE, "strand", (F.col("site1") - F.col("pos")).alias("distance"))


@query(f"""with {cte('aln', 'ev')}, {CIG}, {CAND}, k as (select *, {_classes(False)} as k from p)
    select read_id, file_ord, cand.chrom, site1, site2, strand from k join cand on k.chrom = cand.chrom and abs(site1 - pos) <= 6 where k[1] in (-1, 10)
    qualify row_number() over (partition by read_id order by file_ord, flag, pos, mapq, cigar, site1, site2, strand) = 1""")
def first_hit(spark: SparkSession, d: str) -> DataFrame:
    records = _classified_records(spark, d).where("kind in (-1, 10)")
    found = near_sites(records, candidates_of(view(spark, d, "ev")), "pos", "site1", CONF.site_slack, 88).withColumnRenamed("ord", "o")
    return read_groups.first_hit(found, ["read_id"], ["file_ord", "flag", "pos", "mapq", "cigar", "site1", "site2", "strand"]).select("read_id", "file_ord", *SITE, "strand")


@query(f"""with {cte('aln', 'ev')}, {CIG}, {CAND}, k as (select *, {_classes(False)} as k from p),
    i as (select read_id, chrom, pos + 6 as lo, pos + (case when cigar = '100M' then 100 else k[4] end) - 7 as hi, case when cigar = '100M' then 0 else k[1] end as style from k where (case when cigar = '100M' then 100 else k[4] end) > 0),
    s as (select distinct chrom, site1, site2, unnest([site1, site2]) as site from cand),
    h as (select distinct read_id, s.chrom, site1, site2 from i join s on i.chrom = s.chrom and (
        (site // 88 = lo // 88 and site >= lo and (site <= hi or style in (1, 10))) or
        (hi // 88 <> lo // 88 and site // 88 = hi // 88 and site <= hi and (site >= lo or style in (-1, 10))))),
    c as (select chrom, site1, site2, count(*) as n from h group by all)
    select d.chrom, d.site1, d.site2, cast(coalesce(n, 0) as bigint) as linear_reads from (select distinct chrom, site1, site2 from cand) d left join c using (chrom, site1, site2)""")
def interval_linear(spark: SparkSession, d: str) -> DataFrame:
    candidates = candidates_of(view(spark, d, "ev"))
    keys = linear.spanned_sites(linear.linear_interval(_classified_records(spark, d)), candidates, 88)
    return linear.linear_counts(keys, candidates, once=True)


@query(f"""with {cte('aln', 'ev')}, {CIG}, {CAND}, b as (select read_id, chrom, pos, unnest(range(1, n + 1)) as i, ns, ls from p),
    m as (select read_id, chrom, pos + coalesce(list_sum(list_transform(range(1, i), lambda j: case when ls[j] in ('M', 'D', 'N', '=', 'X') then ns[j] else 0 end)), 0) as s, ns[i] as w from b where ls[i] = 'M'),
    s2 as (select distinct chrom, site1, site2, unnest([site1, site2]) as site from cand)
    select distinct read_id, m.chrom, site1, site2 from m join s2 on m.chrom = s2.chrom and site - s + 1 >= 19 and s + w - 1 - site + 1 >= 19""")
def direct_linear(spark: SparkSession, d: str) -> DataFrame:
    return linear.matched_sites(_classified_records(spark, d), candidates_of(view(spark, d, "ev")), 88, 19)


@query(f"with {cte('ev')} select read_id, mate, cigar, site1, site2 from ev a where priority = 0 and not exists (select 1 from ev b where b.priority = 1 and b.read_id = a.read_id and b.mate = a.mate)")
def anti_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev")
    return read_groups.unclaimed(rows.where("priority = 0"), rows.where("priority = 1"), ["read_id", "mate"]).select("read_id", "mate", "cigar", "site1", "site2")


@query(f"with {cte('ev')} select read_id, mate, cigar, tag, chrom, site1, site2, strand, max(priority) as priority from ev group by all")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev").select("read_id", "mate", "cigar", "tag", *SITE, "strand", "priority")
    return read_groups.prioritised(rows.where("priority = 1").drop("priority"), rows.where("priority = 0").drop("priority"))


AGG = """e as (select distinct read_id, cigar, tag, chrom, site1, site2, strand, q from ev where priority = 1),
    a as (select chrom, site1, site2, count(distinct case when tag = 1 and q <> 3 then read_id end) as tp, count(distinct case when tag = 1 then read_id end) as tp_all,
        count(case when tag = -1 and q <> 3 then 1 end) as other, count(case when tag = -2 and q <> 3 then 1 end) as fp, count(case when tag = 1 and q = 1 then 1 end) as score,
        coalesce(list_distinct(flatten(list(string_split(cigar, ';')) filter (where tag = 1 and q <> 3))), []) as cigars,
        coalesce(list_distinct(list(cigar) filter (where tag = 1 and q = 3)), []) as wc,
        coalesce(list_distinct(flatten(list(string_split(cigar, ';')) filter (where tag < 0 and q <> 3))), []) as false_cigars,
        coalesce(list_distinct(list(cigar) filter (where tag < 0 and q = 3)), []) as wf,
        array_to_string(list_sort(list_distinct(coalesce(list(read_id) filter (where tag = 1), []))), ',') as read_ids
      from e group by all),
    z as (select *, list_distinct(list_concat(cigars, wc)) as all_cigars, list_distinct(list_concat(false_cigars, wf)) as all_false from a),
    v as (select chrom, site1, site2, strand, count(*) as n from e group by all),
    t as (select chrom, site1, site2, arg_min(strand, (-n, strand)) as strand from v group by all)"""


@query(f"with {cte('ev')}, {AGG} select z.chrom, z.site1, z.site2, t.strand, tp, tp_all, other, fp, score, cast(len(all_cigars) as int) as n_cigars, cast(len(all_false) as int) as n_false_cigars, read_ids from z join t using (chrom, site1, site2)")
def junction_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = summary.aggregate_junctions(view(spark, d, "ev").where("priority = 1"))
    return rows.select(*SITE, "strand", "tp", "tp_all", "other", "fp", "score", F.size("all_cigars").alias("n_cigars"), F.size("all_false_cigars").alias("n_false_cigars"), F.array_join("read_ids", ",").alias("read_ids"))


def _level_sql(level: int) -> str:
    clean = "score > 0 and len(all_false) = 0 and tp_all >= 2"
    rule = {
        2: f"((tp > 19 * fp or fp <= 1) and tp > other + fp and len(cigars) >= 3 and tp >= 2) or ({clean} and len(all_cigars) >= 3)",
        1: f"((tp > 19 * fp or len(false_cigars) <= 2) and tp > other + fp and tp >= 2) or ({clean})",
        0: f"((tp > 19 * fp or len(false_cigars) <= 2) and tp > other + fp) or ({clean})",
    }[level]
    shape = lambda c: f"len(list_filter(list_transform(all_cigars, lambda c: regexp_replace(c, '[^A-Za-z]', '', 'g')), lambda t: {c}))"
    sms = "t <> 'M' and regexp_matches(t, '^[^M].*M.*[^M]$')"
    return f"""with {cte('ev')}, {AGG} select z.chrom || ':' || z.site1 || '|' || z.site2 as junction_id, tp_all as junction_reads,
        {shape(f"t <> 'M' and not ({sms}) and t not like 'M%'")} || '_' || {shape("t <> 'M' and t like 'M%'")} || '_' || {shape(sms)} as shapes, t.strand, score, read_ids
        from z join t using (chrom, site1, site2) where {rule}"""


def _stringency(spark: SparkSession, d: str, level: int) -> DataFrame:
    rows = view(spark, d, "ev")
    none = linear.linear_counts(rows.select("read_id", *SITE).limit(0), candidates_of(rows))
    return summary.summarize(rows, none, level).select("junction_id", "junction_reads", "shapes", "strand", "score", "read_ids")


@query(_level_sql(0))
def stringency_0(spark: SparkSession, d: str) -> DataFrame:
    return _stringency(spark, d, 0)


@query(_level_sql(1))
def stringency_1(spark: SparkSession, d: str) -> DataFrame:
    return _stringency(spark, d, 1)


@query(_level_sql(2))
def stringency_2(spark: SparkSession, d: str) -> DataFrame:
    return _stringency(spark, d, 2)


@query(f"""with {cte('gtf', 'ev')}, s as (select distinct chrom, site1, site2 from ev),
    es as (select chrom, "start" as site1, arg_max(gene_id, line_no) as g1 from gtf group by all), ee as (select chrom, "end" as site2, arg_max(gene_id, line_no) as g2 from gtf group by all),
    g as (select chrom, gene_id, min("start") as gs, max("end") as ge from gtf group by all),
    x as (select s.*, g1 from s join es using (chrom, site1) join ee using (chrom, site2) where g1 = g2),
    c as (select s.*, g.gene_id from s join g on s.chrom = g.chrom and gs <= site1 and site2 <= ge qualify row_number() over (partition by s.chrom, site1, site2 order by gs, ge, g.gene_id) = 1),
    y as (select c.*, (exists (select 1 from gtf e where e.gene_id = c.gene_id and e."start" <= site1 and e."end" >= site1)) and (exists (select 1 from gtf e where e.gene_id = c.gene_id and e."start" <= site2 and e."end" >= site2)) as inside from c)
    select s.chrom, s.site1, s.site2, case when g1 is not null then 'exon' when y.gene_id is null then 'intergenic_region' when inside then 'exon' else 'intron' end as kind, coalesce(g1, y.gene_id, 'NA') as gene_id
    from s left join x using (chrom, site1, site2) left join y using (chrom, site1, site2)""")
def annotate_sites(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "gtf")
    starts, ends = exon_boundaries(exons)
    return summary.annotated(view(spark, d, "ev").select(*SITE).distinct(), starts, ends, exons, gene_spans(exons)).select(*SITE, "kind", "gene_id")


@query(f"""with {cte('gtf')} select gene_id, transcript_id, array_to_string(list_transform(list_sort(list_distinct(list({{'s': "start", 'e': "end"}}))), lambda x: x.s || '-' || x.e), ',') as chain from gtf group by all""")
def exon_chain_table(spark: SparkSession, d: str) -> DataFrame:
    rows = exon_chains(view(spark, d, "gtf"))
    return rows.select("gene_id", "transcript_id", F.array_join(F.transform("chain", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("chain"))


@query(f"""with {cte('gtf')}, e as (select distinct chrom, transcript_id, strand, "start" as s, "end" as e from gtf),
    n as (select chrom, transcript_id, strand, e as donor, lead(s) over (partition by chrom, transcript_id, strand order by s, e) as acceptor from e)
    select distinct chrom, strand, donor, acceptor from n where acceptor is not null""")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return splice_pairs(view(spark, d, "gtf"))


def _order_query(spark: SparkSession, d: str, key) -> DataFrame:
    from pyspark.sql import Window

    rows = view(spark, d, "out").select("chrom").distinct().union(spark.createDataFrame([("7",), ("X",), ("chrM",), ("chrUn",), ("MT",)], "chrom string")).distinct()
    return rows.withColumn("place", F.dense_rank().over(Window.orderBy(key(F.col("chrom")))))


CHROMS = f"with {cte('out')}, c as (select distinct chrom, regexp_replace(chrom, '^chr', '') as b from (select chrom from out union all values ('7'), ('X'), ('chrM'), ('chrUn'), ('MT'))), k as (select chrom, b, try_cast(b as int) as n, case b when 'X' then 23 when 'Y' then 24 when 'M' then 25 when 'MT' then 25 end as r from c)"


@query(f"{CHROMS} select chrom, cast(dense_rank() over (order by case when coalesce(n, r) is null then 1 else 0 end, coalesce(n, r, 0), case when coalesce(n, r) is null then chrom else '' end) as int) as place from k")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    return _order_query(spark, d, K.natural_order)


@query(f"""{CHROMS}, g as (select *, case when chrom not like 'chr%' then 3 when n is not null then 0 when r is not null then 1 else 2 end as g from k)
    select chrom, cast(dense_rank() over (order by g, case when g < 2 then coalesce(n, r) else 0 end, case g when 2 then b when 3 then chrom else '' end) as int) as place from g""")
def result_order(spark: SparkSession, d: str) -> DataFrame:
    return _order_query(spark, d, K.result_order)


@query(f"""with {cte('ev')}, {CAND}, h as (select *, cast(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(concat_ws(chr(9), chrom, site1, site2, strand, signal_left, signal_right), ''), lambda c: cast(ascii(c) as bigint))), lambda a, c: (a * 31 + c) % 4294967296) as bigint) as u, count(*) over (partition by chrom) as n from cand),
    s as (select *, case when n <= 12 then 16 else cast(pow(2, ceil(log2(n / 0.75) - 1e-9)) as bigint) end as cap from h)
    select chrom, site1, site2, strand, cast(case when u >= 2147483648 then u - 4294967296 else u end as int) as hash, cast(row_number() over (partition by chrom order by xor(u, u >> 16) % cap, site1, site2, strand, signal_left, signal_right) as int) as ord from s""")
def java_order(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates_of(view(spark, d, "ev"))
    return rows.select(*SITE, "strand", K.java_hash(F.concat_ws("\t", *SITE, "strand", "signal_left", "signal_right")).alias("hash"), "ord")


@query(f"""with {cte('out')}, s as (select chrom, "start", "end", case when strand in ('+', '-') then strand else 'NA' end as strand, sample, reads from out)
    select chrom, "start", "end", strand, count(distinct sample) as samples, cast(sum(reads) as bigint) as reads, chrom || ':' || "start" || '|' || "end" || ':' || strand as cohort_id from s group by all""")
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    return cohort.merge_samples(view(spark, d, "out"))


@query(f"""with {cte('out')}, s as (select chrom, "start", "end", case when strand in ('+', '-') then strand else 'NA' end as strand, sum(reads) as reads from out group by 1, 2, 3, 4)
    select chrom, cast("start" - 1 as int) as start0, "end", chrom || ':' || "start" || '|' || "end" || ':' || strand as name, cast(least(greatest(reads, 0), 1000) as bigint) as score, strand from s""")
def catalog_bed(spark: SparkSession, d: str) -> DataFrame:
    return cohort.catalog_rows(cohort.merge_samples(view(spark, d, "out")))


@query(f"""with {cte('ev', 'out')}, {CAND}, k as (select distinct chrom, site1, site2, strand from cand),
    c as (select distinct chrom, "start" as site1, "end" as site2, case when strand in ('+', '-') then strand else 'NA' end as strand from out)
    select * from k union select * from c""")
def catalog_second_pass(spark: SparkSession, d: str) -> DataFrame:
    merged = cohort.merge_samples(view(spark, d, "out"))
    return with_catalog(candidates_of(view(spark, d, "ev")), merged.select("chrom", "start", "end", "strand")).select(*SITE, "strand").distinct()


@query(f"""with {cte('out')} select chrom, cast("start" - 1 as int) as start1, "start" as end1, chrom as chrom2, cast("end" - 1 as int) as start2, "end" as end2, junction_id as name, cast(reads as string) as score, strand as strand1, strand as strand2 from out where "end" >= "start" and "start" >= 1""")
def bedpe_track(spark: SparkSession, d: str) -> DataFrame:
    return segments.arc_rows(view(spark, d, "out").withColumn("score", F.col("reads")))


OUTWARD = """(a.flag // 16) % 2 <> (b.flag // 16) % 2 and case when (case when (a.flag // 16) % 2 = 1 then a.pos = b.pos and a.pos + a.rl = b.pos + b.rl else a.pos = b.pos and a.pos + a.rl = b.pos + b.rl end)
        then coalesce(least(case when (a.flag // 16) % 2 = 1 then a.c3 else b.c3 end, case when (a.flag // 16) % 2 = 1 then b.c3 else a.c3 end,
            case when (a.flag // 16) % 2 = 1 then a.c3 - b.c5 else b.c3 - a.c5 end, case when (a.flag // 16) % 2 = 1 then b.c3 - a.c5 else a.c3 - b.c5 end) >= 19, false)
        else case when (a.flag // 16) % 2 = 1 then b.pos - a.pos >= 19 and b.pos + b.rl - a.pos - a.rl >= 19 else a.pos - b.pos >= 19 and a.pos + a.rl - b.pos - b.rl >= 19 end end"""
CLIPS = "x as (select *, case when ls[1] = 'S' then f else 0 end as c5, case when ls[-1] = 'S' then l else 0 end as c3 from p)"


@query(f"""with {cte('aln')}, {CIG}, {CLIPS}, f as (select * from x where (flag // 4) % 2 = 0 and (flag // 256) % 2 = 0 and (flag // 2048) % 2 = 0),
    pr as (select read_id from f group by 1 having count(*) filter (where (flag // 64) % 2 = 1) = 1 and count(*) filter (where (flag // 64) % 2 = 0) = 1)
    select a.read_id from f a join f b on a.read_id = b.read_id and (a.flag // 64) % 2 = 1 and (b.flag // 64) % 2 = 0 join pr on pr.read_id = a.read_id
    where a.chrom = b.chrom and a.chrom <> '*' and a.mapq >= 10 and b.mapq >= 10 and a.rl > 0 and b.rl > 0 and {OUTWARD}""")
def outward_pairs(spark: SparkSession, d: str) -> DataFrame:
    return segments.outward_primary(view(spark, d, "aln"), CONF)


def _outward_sql(mapped: str) -> str:
    return f"""with {cte('aln')}, {CIG}, {CLIPS}, f as (select * from x where (flag // 4) % 2 = 0 and (flag // 256) % 2 = 0 and cigar <> '*' and rl > 0)
        select distinct a.read_id from f a join f b on a.read_id = b.read_id and a.chrom = b.chrom and (a.flag // 64) % 2 = 1 and (b.flag // 64) % 2 = 0 and (b.flag // 128) % 2 = 1 where {mapped}(a.mapq, b.mapq) >= 10 and {OUTWARD}"""


@query(_outward_sql("greatest"))
def outward_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return segments.outward_any(view(spark, d, "aln"), CONF)


@query(_outward_sql("least"))
def outward_supplementary(spark: SparkSession, d: str) -> DataFrame:
    return segments.outward_any(view(spark, d, "aln"), EngineConf(outward_mode="supplementary"))


@query(f"""with {cte('aln')}, {CIG}, k as (select read_id, chrom, file_ord, flag, pos, {_classes(True)} as k from p where cigar <> '*'),
    b as (select a.read_id, case when a.k[1] > b.k[1] then b.k else a.k end as x, case when a.k[1] > b.k[1] then a.k else b.k end as y, case when a.k[1] > b.k[1] then b.pos else a.pos end as px, case when a.k[1] > b.k[1] then a.pos else b.pos end as py
      from k a join k b on a.read_id = b.read_id and a.chrom = b.chrom and (a.flag // 16) % 2 = (b.flag // 16) % 2 and a.file_ord < b.file_ord)
    select distinct read_id from b where (x[1] = -1 and y[1] = 1 and abs(x[2] - y[2]) <= 6 and py + y[3] - px - x[3] < 0) or (x[1] = -1 and y[1] = 10 and abs(100 - y[3] - x[2]) <= 6 and py + y[4] - 1 - px < 0)
      or (x[1] = 1 and y[1] = 10 and abs(x[2] - y[2]) <= 6 and px + x[4] - 1 - py < 0)""")
def backward_pairs(spark: SparkSession, d: str) -> DataFrame:
    return segments.backward_split(view(spark, d, "aln"))


@query(f"""with {cte('gtf')}, t as (select distinct transcript_id, strand, "start" as s, "end" as e from gtf), g as (select *, row_number() over (partition by transcript_id order by (s * 7) % 11, s, e, strand) as i from t),
    l as (select *, lag(e) over (partition by transcript_id order by i) as before from g), r as (select *, sum(case when before is not null and s <= before then 1 else 0 end) over (partition by transcript_id order by i rows unbounded preceding) as part from l)
    select transcript_id, cast(part as bigint) as part, count(*) as n_blocks, case when count(distinct strand) = 1 then min(strand) else '.' end as strand,
        string_agg(case when prev is null or s - prev <= 1 then '' else (s - prev - 1) || 'N' end || (e - s + 1) || 'M', '' order by i) as cigar
    from (select *, lag(e) over (partition by transcript_id, part order by i) as prev from r) group by all""")
def segment_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "gtf").select("transcript_id", "strand", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    token = F.struct(((F.col("s") * 7) % 11).alias("k"), "s", "e", "strand")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda t: F.concat(t["s"], F.lit("-"), t["e"], F.lit(":"), t["strand"])), "|")
    parts = segments.chain_parts(rows.groupBy("transcript_id").agg(chain.alias("chain")), ["transcript_id"])
    return parts.select("transcript_id", F.col("part").cast("long").alias("part"), F.size("blocks").cast("long").alias("n_blocks"), "strand", C.spliced_cigar(F.col("blocks")).alias("cigar"))


@query("""with u as (select 's' || (l_suppkey % 4) as sample, 'j' || (l_partkey % 40) as junction_id, 'i' || (l_orderkey % 3) as isoform_id, cast(sum(cast(l_quantity as bigint)) as bigint) as reads from lineitem group by all)
    select *, round(reads / sum(reads) over (partition by sample, junction_id), 6) as usage from u""")
def isoform_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("concat('s', cast(l_suppkey % 4 as string)) as sample", "concat('j', cast(l_partkey % 40 as string)) as junction_id", "concat('i', cast(l_orderkey % 3 as string)) as isoform_id", "cast(l_quantity as bigint) as reads")
    return cohort.usage_of_isoforms(rows).withColumn("usage", F.round("usage", 6))


@query("""with u as (select 's' || (l_suppkey % 4) as sample, 'j' || (l_partkey % 40) as junction_id, 'i' || (l_orderkey % 3) as isoform_id, sum(cast(l_quantity as bigint)) as reads from lineitem group by all),
    v as (select *, reads / sum(reads) over (partition by sample, junction_id) as usage from u), m as (select sample, junction_id, arg_max(isoform_id, (usage, isoform_id)) as main, max(usage) as usage from v group by all)
    select junction_id, array_to_string(list_sort(list_distinct(list(main))), ',') as isoforms, count(*) as samples from m where usage >= 0.35 group by all having count(distinct main) > 1""")
def usage_switching(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("concat('s', cast(l_suppkey % 4 as string)) as sample", "concat('j', cast(l_partkey % 40 as string)) as junction_id", "concat('i', cast(l_orderkey % 3 as string)) as isoform_id", "cast(l_quantity as bigint) as reads")
    return cohort.switching(cohort.usage_of_isoforms(rows), 0.35)


@query(f"""with {cte('out')}, s as (select chrom, "start", "end", case when strand in ('+', '-') then strand else 'NA' end as strand, sample, reads from out)
    select chrom, "start", "end", strand, cast(coalesce(sum(reads) filter (where sample = 's0'), 0) as bigint) as s0, cast(coalesce(sum(reads) filter (where sample = 's1'), 0) as bigint) as s1, cast(coalesce(sum(reads) filter (where sample = 's2'), 0) as bigint) as s2 from s group by all having true""")
def sample_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cohort.sample_matrix(cohort.sample_support(view(spark, d, "out")), ["s0", "s1", "s2"])


@query(f"""with {cte('out')} select count(distinct sample) as samples, count(*) as rows, count(distinct (chrom, "start", "end", strand)) as junctions, cast(sum(reads) as bigint) as reads from out""")
def cohort_totals(spark: SparkSession, d: str) -> DataFrame:
    return cohort.run_totals(view(spark, d, "out"))


@query(f"with {cte('aln')} select count(distinct read_id) as reads, max(length(seq)) as read_length from aln")
def read_totals(spark: SparkSession, d: str) -> DataFrame:
    return read_groups.read_counts(view(spark, d, "aln")).withColumn("read_length", F.col("read_length").cast("long"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of the derived evidence, filtered, counted against linear reads, annotated and in order."""
    evidence, exons = view(spark, d, "ev"), view(spark, d, "gtf")
    candidates = candidates_of(evidence)
    keys = linear.spanned_sites(linear.linear_interval(_classified_records(spark, d)), candidates, 88)
    found = summary.summarize(evidence, linear.linear_counts(keys, candidates, once=True), 0, (*exon_boundaries(exons), exons, gene_spans(exons)))
    return summary.ordered(found)


UNIFORM = "(cast('0x' || left(md5({}), 8) as bigint) / 4294967296.0)"


@query(f"""with {cte('gtf')} select distinct chrom, "start", "end", strand from gtf where {UNIFORM.format("concat_ws('|', '7', 'exclusive', chrom, \"start\", \"end\", strand)")} < 0.25""")
def exclusive_exons(spark: SparkSession, d: str) -> DataFrame:
    return simulate.exclusive_exons(view(spark, d, "gtf"), SimConf(seed=7, exclusive_rate=0.25))


@query(f"""with {cte('gtf')}, x as (select distinct chrom, "start", "end", strand from gtf where {UNIFORM.format("concat_ws('|', '7', 'exclusive', chrom, \"start\", \"end\", strand)")} < 0.25)
    select distinct gene_id, transcript_id from gtf where not exists (select 1 from x where x.chrom = gtf.chrom and x."start" = gtf."start" and x."end" = gtf."end" and x.strand = gtf.strand)""")
def surviving_transcripts(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "gtf")
    return simulate.surviving_transcripts(exons, simulate.exclusive_exons(exons, SimConf(seed=7, exclusive_rate=0.25)))


@query("select p_partkey, greatest(cast(round(p_size * 100 * 7.0 / 300.0) as bigint), 1) as circular_pairs, greatest(cast(round(p_size * 7.0 / 300.0) as bigint), 0) as linear_pairs from part")
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    pairs_of = lambda n, least: simulate.pair_count(n, F.lit(7.0), 150, least)
    return rows.select("p_partkey", pairs_of(F.col("p_size") * 100, 1).alias("circular_pairs"), pairs_of(F.col("p_size"), 0).alias("linear_pairs"))


@query()
def local_alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and length of the local alignment of two stretches of each read."""

    def run(batches):
        import pyarrow as pa

        from strandline.functions.kernels import local_alignments

        for batch in batches:
            found = local_alignments([(s[:40], s[30:70]) for s in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())], names=["file_ord", "score", "length"])

    return view(spark, d, "aln").select("file_ord", "seq").mapInArrow(run, "file_ord long, score int, length int")


@query()
def difference_strings(spark: SparkSession, d: str) -> DataFrame:
    """Each read's difference string against itself, moved by two bases."""

    def run(batches):
        import pyarrow as pa

        from strandline.functions.kernels import difference_strings

        for batch in batches:
            reads = batch.column(1).to_pylist()
            found = difference_strings(reads, [s and s[2:] + s[:2] for s in reads], batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["file_ord", "difference"])

    return view(spark, d, "aln").where("cigar <> '*'").select("file_ord", "seq", "cigar").mapInArrow(run, "file_ord long, difference string")


@query(f"""with {cte('gtf')} select chrom, gene_id, min("start") as "start", max("end") as "end" from gtf group by all""")
def gene_span_table(spark: SparkSession, d: str) -> DataFrame:
    return gene_spans(view(spark, d, "gtf"))


@query(f"""with {cte('gtf')} select chrom, "start" as pos, arg_max(gene_id, (line_no, gene_id, strand)) as gene_id, arg_max(strand, (line_no, gene_id, strand)) as strand, 'start' as side from gtf group by chrom, "start"
    union all select chrom, "end", arg_max(gene_id, (line_no, gene_id, strand)), arg_max(strand, (line_no, gene_id, strand)), 'end' from gtf group by chrom, "end" """)
def exon_boundary_table(spark: SparkSession, d: str) -> DataFrame:
    starts, ends = exon_boundaries(view(spark, d, "gtf"))
    return starts.withColumn("side", F.lit("start")).unionByName(ends.withColumn("side", F.lit("end")))


@query(f"""with {cte('out')}, s as (select distinct sample, chrom from out), k as (select chrom as sample, dense_rank() over (order by sample, chrom) as place from s)
    select case when row_number() over (partition by sample order by place) = 1 then sample else sample || '_' || row_number() over (partition by sample order by place) end as sample, cast(place as int) as place from k""")
def sample_names(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = view(spark, d, "out").select("sample", "chrom").distinct()
    rows = rows.withColumn("place", F.dense_rank().over(Window.orderBy("sample", "chrom"))).select(F.col("chrom").alias("sample"), "place")
    return cohort.unique_names(rows)


@query(f"""with {cte('aln', 'ev')}, {CIG}, q as (select *, concat_ws(',', case when regexp_matches(cigar, '^[0-9]+S') then 'L:' || seq[1:f] end, case when cigar like '%S' then 'R:' || right(seq, l) end) as t from p)
    select read_id, 'scan1' as stage, cast(case when (flag // 64) % 2 = 1 then 1 when (flag // 128) % 2 = 1 then 2 else 0 end as int) as mate, flag, chrom, pos, mapq, cigar, cast(length(seq) as int) as seq_len, case when t = '' then '*' else t end as clips
    from q where read_id in (select read_id from ev where priority = 1)""")
def evidence_sidecar(spark: SparkSession, d: str) -> DataFrame:
    return segments.evidence_sidecar(view(spark, d, "aln"), view(spark, d, "ev").where("priority = 1"), "scan1")


@query(f"""with {cte('aln', 'ev')}, g as (select distinct read_id from ev where priority = 0)
    select read_id, count(*) as n, string_agg(flag || '|' || chrom || '|' || pos || '|' || mapq || '|' || cigar, ';' order by file_ord, flag, chrom, pos, mapq, cigar) as records from aln where read_id in (select read_id from g) group by all""")
def compact_records(spark: SparkSession, d: str) -> DataFrame:
    reads = view(spark, d, "ev").where("priority = 0").select("read_id").distinct()
    rows = segments.compact_records(view(spark, d, "aln"), reads)
    text = F.array_join(F.transform("records", lambda r: F.concat_ws("|", r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"])), ";")
    return rows.select("read_id", F.size("records").cast("long").alias("n"), text.alias("records"))


@query(f"""with {cte('ev')}, {AGG}, f as (select * from z where ((tp > 19 * fp or len(false_cigars) <= 2) and tp > other + fp) or (score > 0 and len(all_false) = 0 and tp_all >= 2))
    select (select count(*) from f) as junctions, count(distinct r) as reads from (select unnest(string_split(read_ids, ',')) as r from f)""")
def result_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev")
    none = linear.linear_counts(rows.select("read_id", *SITE).limit(0), candidates_of(rows))
    return summary.totals(summary.summarize(rows, none, 0))


# More queries, each module adding its own to QUERIES and ORACLE_SQL.
from . import files, planted, simulated, strings  # noqa: E402, F401
