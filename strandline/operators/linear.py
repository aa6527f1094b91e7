"""Linear reads over candidate sites, counted once for each read and junction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConf
from ..functions import cigar as C
from .lineage import cut
from .regions import SITE

#: The most junctions that go to each task as a table.
MOST_SITES = 100_000
RANGES = "array<struct<low:long,high:long,kind:string>>"


def linear_interval(records: DataFrame, keep: bool = False) -> DataFrame:
    """records plus lo and hi, what an alignment spans less six bases, and style, on which side it may be open. Records that span
    nothing are left out or, with keep, told by spanning."""
    full = C.full_match(F.col("cigar"), F.col("L"))
    length = F.when(full, F.col("L")).otherwise(F.col("ref"))
    rows = records.withColumn("lo", F.col("pos") + 6).withColumn("hi", F.col("pos") + length - 7).withColumn("style", F.when(full, 0).otherwise(F.col("kind")))
    return rows.withColumn("spanning", F.coalesce(length > 0, F.lit(False))) if keep else rows.where(length > 0)


def _junctions(candidates: DataFrame):
    """The distinct junctions with each of their sites (SITE, site), cut, and how a join takes them: up to MOST_SITES junctions go
    to each task as a table, more are met by key."""
    junctions = cut(candidates.select(*SITE).distinct())
    few = junctions.count() <= MOST_SITES
    ends = junctions.select(*SITE, F.explode(F.array_distinct(F.array("site1", "site2"))).alias("site"))
    return ends, few


def _given(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table.hint("merge")


def _met(records: DataFrame, ranges: Column, ends: DataFrame, few: bool, bucket: int, *kinds: str) -> DataFrame:
    """read_id, chrom and, for each kind, the set of sites in the ranges of that kind (an array of low, high, kind) of the read's
    records. The join is by bucket, with sites, not junctions: a site is one row however many junctions share it."""
    sites = ends.select("chrom", "site").distinct().withColumn("bucket", F.floor(F.col("site") / bucket).cast("long"))
    if few:
        records = records.repartition("read_id", "chrom")  # The only shuffle: sets and junctions are made where a read's rows are.
    # An outer generator: from any other one a filter is inferred, which makes all ranges a second time.
    rows = records.select("read_id", "chrom", ranges.alias("ranges")).select("read_id", "chrom", F.inline_outer("ranges")).where("low <= high")
    step = lambda c: F.floor(F.col(c) / bucket).cast("long")
    rows = rows.select("*", F.explode(F.sequence(step("low"), step("high"))).alias("bucket"))
    met = rows.join(_given(sites, few), ["chrom", "bucket"]).where("site between low and high")
    return met.groupBy("read_id", "chrom").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("site"))).alias(k) for k in kinds))


def _opened(met: DataFrame, kind: str, ends: DataFrame, few: bool) -> DataFrame:
    """met with the junctions of the sites of a kind, each once: by its second site only where the first one is not met."""
    rows = met.select("*", F.explode(kind).alias("site")).join(_given(ends, few), ["chrom", "site"])
    return rows.where((F.col("site") == F.col("site1")) | ~F.array_contains(kind, F.col("site1")))


def _range(low: Column, high: Column, kind: str) -> Column:
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(kind).alias("kind"))


def span_ranges(bucket: int, full_span: bool = False) -> Column:
    """The ranges in which an interval (lo, hi, style) asks for sites.

    An alignment that is clipped on a side is open there as far as the bucket of that end goes; buckets strictly between the two
    ends are looked into only with full_span.
    """
    lo, hi, style = F.col("lo"), F.col("hi"), F.col("style")
    first, last = F.floor(lo / bucket).cast("long"), F.floor(hi / bucket).cast("long")
    top = (first + 1) * bucket - 1
    ranges = [
        _range(lo, F.when(style.isin(1, 10), top).otherwise(F.least(hi.cast("long"), top)), "spans"),
        _range(F.when(style.isin(-1, 10), last * bucket).otherwise(F.greatest(lo.cast("long"), last * bucket)), F.when(first != last, hi).otherwise(last * bucket - 1), "spans"),
    ]
    return F.array(*ranges, *([_range((first + 1) * bucket, last * bucket - 1, "spans")] if full_span else []))


def block_ranges(pos: Column, cigar: Column, anchor: int) -> Column:
    """The ranges inside the matched blocks of an alignment, with an anchor on both sides."""
    return F.transform(C.match_blocks(pos, cigar), lambda b: _anchored(b, anchor))


def held_ranges(pos: Column, cigar: Column, anchor: int, slack: int = 6) -> Column:
    """block_ranges and those at a skipped stretch between two blocks that hold an anchor each."""
    size = lambda b: b["end"] - b["start"] + 1

    def skip(x: Column, y: Column) -> Column:
        good = (size(x) >= anchor) & (size(y) >= anchor) & (y["start"] - x["end"] > 1)
        return F.when(good, F.array(_range(x["end"] - slack, x["end"] + slack, "held"), _range(y["start"] - slack, y["start"] + slack, "held")))

    def ranges(blocks: Column) -> Column:
        n = F.greatest(F.size(blocks) - 1, F.lit(0))
        skips = F.zip_with(F.slice(blocks, 1, n), F.slice(blocks, 2, n), skip)
        return F.concat(F.transform(blocks, lambda b: _anchored(b, anchor)), F.flatten(F.filter(skips, lambda s: s.isNotNull())))

    jumps = F.contains(cigar, F.lit("N")) & ~cigar.rlike("D|I")
    return F.when(jumps, C.bind(C.match_blocks(pos, cigar), ranges)).otherwise(block_ranges(pos, cigar, anchor))


def _anchored(block: Column, anchor: int) -> Column:
    return _range(block["start"] + (anchor - 1), block["end"] - (anchor - 1), "held")


def spanned_sites(intervals: DataFrame, candidates: DataFrame, bucket: int, full_span: bool = False) -> DataFrame:
    """read_id and the junctions one of whose sites lies in the read's interval, each once."""
    ends, few = _junctions(candidates)
    met = _met(intervals, span_ranges(bucket, full_span), ends, few, bucket, "spans")
    return _opened(met, "spans", ends, few).select("read_id", *SITE)


def matched_sites(records: DataFrame, candidates: DataFrame, bucket: int, anchor: int) -> DataFrame:
    """read_id and the junctions one of whose sites lies inside a matched block, with an anchor on both sides, each once."""
    ends, few = _junctions(candidates)
    met = _met(records, block_ranges(F.col("pos"), F.col("cigar"), anchor), ends, few, bucket, "held")
    return _opened(met, "held", ends, few).select("read_id", *SITE)


def strong_spanned(records: DataFrame, candidates: DataFrame, bucket: int, anchor: int, full_span: bool = False) -> DataFrame:
    """The spanned junctions of which some alignment of the read has a site with an anchor on both sides, each once: inside a
    matched block, or at a skipped stretch between two blocks. Both are asked of a read's sites before junctions are made."""
    ends, few = _junctions(candidates)
    spans = F.when(F.col("spanning"), span_ranges(bucket, full_span)).otherwise(F.array().cast(RANGES))
    ranges = F.concat(spans, held_ranges(F.col("pos"), F.col("cigar"), anchor))
    met = _met(linear_interval(records, keep=True), ranges, ends, few, bucket, "spans", "held")
    both = F.array_contains("spans", F.col("site1")) | F.array_contains("spans", F.col("site2"))
    return _opened(met, "held", ends, few).where(both).select("read_id", *SITE)


def strong_sites(records: DataFrame, spanned: DataFrame, anchor: int, bucket: int = 88) -> DataFrame:
    """Those of the given junctions of reads (read_id, SITE) of which some alignment of the read holds a site, as strong_spanned has
    it."""
    ends, few = _junctions(spanned)
    held = _met(records, held_ranges(F.col("pos"), F.col("cigar"), anchor), ends, few, bucket, "held")
    rows = spanned.select("read_id", *SITE).distinct().join(held, ["read_id", "chrom"])
    return rows.where(F.array_contains("held", F.col("site1")) | F.array_contains("held", F.col("site2"))).select("read_id", *SITE)


def linear_keys(records: DataFrame, candidates: DataFrame, conf: EngineConf, bucket: int, refused: DataFrame) -> DataFrame:
    """read_id, chrom, site1, site2: the linear evidence of a scan by the chosen policy. refused: junctions whose verdict on a clip
    was linear; direct evidence does without them."""
    if conf.linear_mode == "direct":
        return matched_sites(records, candidates, bucket, conf.anchor)
    if conf.linear_mode == "strong":
        keys = strong_spanned(records, candidates, bucket, conf.anchor, conf.full_span)
        keys = keys.unionByName(strong_sites(records, refused, conf.anchor, bucket)).distinct()
    else:
        keys = spanned_sites(linear_interval(records), candidates, bucket, conf.full_span).unionByName(refused).distinct()
    if conf.rescue_anchor is not None:
        keys = keys.unionByName(matched_sites(records, candidates, bucket, conf.rescue_anchor)).distinct()
    return keys


def linear_counts(keys: DataFrame, candidates: DataFrame, once: bool = False) -> DataFrame:
    """chrom, site1, site2, linear_reads for every candidate, zero where no read goes over it. once: no key is there twice."""
    keys = keys.select("read_id", *SITE)
    counted = (keys if once else keys.distinct()).groupBy(*SITE).agg(F.count("*").alias("linear_reads"))
    return candidates.select(*SITE).distinct().join(counted, SITE, "left").na.fill(0, ["linear_reads"])
