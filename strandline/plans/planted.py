"""A genome with a circle for each customer and a read for each order, from the driver's tables, and what detection must find there.

Each customer has a tile of TILE bases from digests of its key, with splice signals around a circle in its middle. An order's kind says
how its read lies: split over the junction with its mate inside the circle (0), behind it (1) or like nothing (2); split without a mate,
as second (3) or first read (4) of a pair; clipped at the circle's end (5) or start (6); straight over the end (7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConf
from ..operators.lineage import spread
from .queries import AGG, query

TILE, START, END, LENGTH = 3000, 1000, 1600, 100
CONF = EngineConf(min_span=100, max_span=5000, linear_range=300)
ALIGNMENT = "read_id", "flag", "chrom", "pos", "mapq", "cigar", "seq", "file_ord"


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """customer, chrom, chunk, n, seq."""
    key = F.col("c_custkey")
    digests = F.transform(F.sequence(F.lit(0), F.lit(TILE // 32)), lambda i: F.md5(F.concat_ws("|", key, i).cast("binary")))
    bases = F.translate(F.array_join(digests, ""), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey").select(key.alias("customer"), bases.alias("b"))
    part = lambda a, b: F.substring("b", a + 1, b - a)
    seq = F.concat(part(0, START - 2), F.lit("AG"), part(START, END), F.lit("GT"), part(END + 2, TILE))
    return rows.select("customer", F.concat(F.lit("chr"), 1 + F.col("customer") % 3).alias("chrom"), F.floor(F.col("customer") / 3).cast("int").alias("chunk"), F.lit(1 << 30).alias("n"), seq.alias("seq"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """The reads' records, in SAM's terms."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"))
    # Reads need the circle and what follows it. Tiles are made of a small file, by whose size they would be broadcast.
    near = tiles(spark, d).withColumn("seq", F.substring("seq", START + 1, END - START + 2 * LENGTH)).hint("merge")
    rows = orders.join(near, "customer").withColumn("kind", F.col("k") % 8).withColumn("base", F.col("chunk") * TILE)
    kind, base = F.col("kind"), F.col("base")
    left = (40 + F.col("customer") % 21).cast("int")
    kept = (78 + F.col("k") % 5).cast("int")

    def bases(start: Column | int, end: Column | int) -> Column:
        start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
        return F.substring("seq", (start - START + 1).cast("int"), (end - start).cast("int"))

    def record(flag: Column | int, at: Column | int, mapq: Column | int, cigar: Column, seq: Column, chrom: Column | None = None) -> Column:
        column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(column(flag).cast("int").alias("flag"), (F.col("chrom") if chrom is None else chrom).alias("chrom"), (base + column(at) + 1).cast("int").alias("pos"), column(mapq).cast("int").alias("mapq"), cigar.alias("cigar"), seq.alias("read"))

    word = lambda *x: F.concat(*(y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x))
    around = F.concat(bases(END - left, END), bases(START, START + LENGTH - left))
    first = F.when(kind == 3, 129).when(kind == 4, 65).otherwise(97)
    low = F.when((kind == 0) & (F.floor(F.col("k") / 8) % 2 == 1), 5).otherwise(60)
    split = [record(first, END - left, 60, word(left, "M", LENGTH - left, "S"), around), record(first + 2048, START, low, word(left, "S", LENGTH - left, "M"), around)]
    full = F.lit(f"{LENGTH}M")
    mate = lambda at: record(145, at, 60, full, bases(at, at + LENGTH))
    elsewhere = record(145, 0, 60, full, F.repeat(F.lit("ACGTN"), F.lit(LENGTH // 5)), F.lit("chr9"))
    at_end = record(97, END - kept, 60, word(kept, "M", LENGTH - kept, "S"), F.concat(bases(END - kept, END), bases(START, START + LENGTH - kept)))
    at_start = record(97, START, 60, word(LENGTH - kept, "S", kept, "M"), F.concat(bases(END - LENGTH + kept, END), bases(START, START + kept)))
    straight = record(97, END - 50, 60, full, bases(END - 50, END + 50))
    inside = mate(START + 250)
    reads = [F.array(*split, inside), F.array(*split, mate(END + 100)), F.array(*split, elsewhere), F.array(*split), F.array(*split), F.array(at_end, inside), F.array(at_start, inside), F.array(straight, inside)]
    records = F.coalesce(*(F.when(kind == i, x) for i, x in enumerate(reads)))
    rows = rows.select("k", F.posexplode(records).alias("i", "r"))
    rows = rows.select(F.concat(F.lit("o"), "k").alias("read_id"), "r.flag", "r.chrom", "r.pos", "r.mapq", "r.cigar", F.col("r.read").alias("seq"), (F.col("k").cast("long") * 4 + F.col("i")).alias("file_ord"))
    return rows.select(*ALIGNMENT)


#: The same reads in DuckDB: what each scan must say of them.
TRUTH = f"""placed as (select o_orderkey as k, o_custkey as c, o_orderkey % 8 as kind, 40 + o_custkey % 21 as l, 78 + o_orderkey % 5 as m,
      'chr' || (1 + o_custkey % 3) as chrom, cast((o_custkey // 3) * {TILE} + {START} + 1 as int) as site1, cast((o_custkey // 3) * {TILE} + {END} as int) as site2 from orders),
    e1 as (select 'o' || k as read_id, case when kind = 3 then 'R2' else 'R1' end as mate, l || 'M' || ({LENGTH} - l) || 'S;' || l || 'S' || ({LENGTH} - l) || 'M' as cigar,
      cast(case kind when 1 then -2 when 2 then -1 else 1 end as int) as tag, chrom, site1, site2, '+' as strand, 'AG' as signal_left, 'GT' as signal_right,
      cast(case when kind = 0 and (k // 8) % 2 = 1 then 0 else 1 end as int) as q, cast(case when kind = 4 then 0 else 1 end as int) as priority from placed where kind <= 4),
    known as (select distinct chrom, site1, site2 from e1 where priority = 1),
    e2 as (select 'o' || k as read_id, 'R1' as mate, case kind when 4 then l || 'M' || ({LENGTH} - l) || 'S' when 5 then m || 'M' || ({LENGTH} - m) || 'S' else ({LENGTH} - m) || 'S' || m || 'M' end as cigar,
      cast(1 as int) as tag, chrom, site1, site2, '+' as strand, 'AG' as signal_left, 'GT' as signal_right, cast(2 as int) as q, cast(1 as int) as priority
      from placed join known using (chrom, site1, site2) where kind in (4, 5, 6)),
    linear as (select 'o' || k as read_id, chrom, site1, site2 from placed join known using (chrom, site1, site2) where kind = 7),
    counts as (select chrom, site1, site2, count(read_id) as linear_reads from known left join linear using (chrom, site1, site2) group by all)"""
EVIDENCE = "read_id, mate, cigar, tag, chrom, site1, site2, strand, signal_left, signal_right, q, priority"


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..operators.detect import scan_pairs
    from ..operators.lineage import cut

    records, chunks = cut(alignments(spark, d)), cut(tiles(spark, d).drop("customer"))
    return records, chunks, scan_pairs(records, chunks, CONF, None, TILE)


def _second(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..operators.detect import candidates_of, scan_clips
    from ..operators.lineage import cut

    records, chunks, first = _first(spark, d)
    first = cut(first)
    candidates = candidates_of(first)
    claims = first.where("priority = 1").select("read_id").distinct()
    return candidates, *scan_clips(records, candidates, claims, chunks, CONF, LENGTH, TILE)


@query(f"with {TRUTH} select {EVIDENCE} from e1")
def first_scan(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of pairs of split alignments, by the reads' own sequences and the reference."""
    return _first(spark, d)[2].select(*EVIDENCE.split(", "))


@query(f"with {TRUTH} select {EVIDENCE} from e2")
def second_scan(spark: SparkSession, d: str) -> DataFrame:
    """Clipped reads rescued at the first scan's junctions, on either end."""
    return _second(spark, d)[1].select(*EVIDENCE.split(", "))


@query(f"with {TRUTH} select read_id, chrom, site1, site2 from linear")
def second_scan_linear(spark: SparkSession, d: str) -> DataFrame:
    """Reads straight over a site of a junction, that are no evidence for one."""
    return _second(spark, d)[2].select("read_id", "chrom", "site1", "site2")


def _results_sql(columns: str, order: str = "") -> str:
    rule = "((tp > 19 * fp or len(false_cigars) <= 2) and tp > other + fp) or (score > 0 and len(all_false) = 0 and tp_all >= 2)"
    return f"""with {TRUTH}, ev as (select * from e1 where priority = 1 union all select * from e2), {AGG},
        r as (select z.chrom || ':' || z.site1 || '|' || z.site2 as junction_id, z.chrom, z.site1 as "start", z.site2 as "end", tp_all as junction_reads, linear_reads,
          cast(round(2.0 * tp_all / (2 * tp_all + linear_reads), 2) as double) as ratio, t.strand, read_ids, score
          from z join t using (chrom, site1, site2) join counts using (chrom, site1, site2) where {rule}) select {columns} from r {order}"""


@query(_results_sql('junction_id, chrom, "start", "end", junction_reads, linear_reads, ratio, strand, read_ids, score'))
def detected_results(spark: SparkSession, d: str) -> DataFrame:
    """Both scans, twins and results from alignments and a reference."""
    from ..operators.lineage import cut
    from .pipeline import detect_junctions

    found = detect_junctions(cut(alignments(spark, d)), cut(tiles(spark, d).drop("customer")), CONF, chunk=TILE, read_length=LENGTH)
    return found.results.select("junction_id", "chrom", "start", "end", "junction_reads", "linear_reads", "ratio", "strand", "read_ids", "score")


@query(f"with {TRUTH} select k, c, seq_offset, cast(site1 as int) as site1, cast(site2 as int) as site2 from (select o_orderkey as k, o_custkey as c, cast(greatest((o_custkey // 3) * {TILE} + {START} + 1 - 668, 0) as int) as seq_offset, (o_custkey // 3) * {TILE} + {START} + 1 as site1, (o_custkey // 3) * {TILE} + {END} as site2 from orders)")
def region_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where the stretch of the reference of each order's circle begins; rows whose ends in it are not the circle's drop out."""
    from ..operators.regions import cut_regions

    chunks = tiles(spark, d)
    sites = chunks.select("chrom", (F.col("chunk") * TILE + START + 1).alias("site1"), (F.col("chunk") * TILE + END).alias("site2"), "customer", "seq")
    found = cut_regions(sites.select("chrom", "site1", "site2"), chunks.drop("customer"), CONF.linear_range, TILE).join(sites, ["chrom", "site1", "site2"])
    whole = F.substring("region", (F.col("site1") - F.col("offset")).cast("int"), F.lit(END - START)) == F.substring("seq", START + 1, END - START)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"))
    return orders.join(found.where(whole), "customer").select("k", F.col("customer").alias("c"), F.col("offset").alias("seq_offset"), "site1", "site2")
