"""Stretches of the reference for candidates, cut once for each candidate, and work dealt out by groups of candidates."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Region

#: Rows that are judged together, of one candidate or of many, and bases of reference that go with them.
ROWS_PER_PART, BASES_PER_PART = 4096, 8 << 20
#: Groups of a hot candidate's rows before they are dealt, and the most hot candidates that go to each task as a table.
SALTS, MOST_HOT = 64, 100_000
SITE = ["chrom", "site1", "site2"]


def cut_regions(sites: DataFrame, chunks: DataFrame, linear_range: int, chunk: int) -> DataFrame:
    """chrom, site1, site2, offset, n, region: the junction and its linear competitors on both sides.

    chunks: chrom, chunk (number of the stretch), n (the chromosome's length), seq. Each candidate meets the chunks it needs.
    """
    reach = F.greatest(F.lit(linear_range), F.col("site2") - F.col("site1") + 5) + 64
    want = sites.withColumn("lo", F.greatest(F.col("site1") - reach, F.lit(0))).withColumn("hi", F.col("site2") + reach)
    want = want.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / chunk).cast("int"), F.floor(F.col("hi") / chunk).cast("int"))))
    # Each chunk gives only what is wanted of it, so that a candidate is its own bases in the shuffle, not whole chunks.
    met = want.join(chunks.hint("merge"), ["chrom", "chunk"])
    begin = F.greatest(F.col("lo"), F.col("chunk") * chunk)
    piece = F.substring("seq", begin - F.col("chunk") * chunk + 1, F.least(F.col("hi"), (F.col("chunk") + 1) * chunk) - begin)
    whole = met.groupBy(*SITE, "n").agg(F.min(begin).alias("offset"), F.array_sort(F.collect_list(F.struct("chunk", piece.alias("seq")))).alias("parts"))
    return whole.select(*SITE, "offset", "n", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("region"))


Judge = Callable[[list[tuple[Region, dict]]], list[dict | None]]


def judge_by_site(rows: DataFrame, regions: DataFrame, judge: Judge, schema: str, linear_range: int) -> DataFrame:
    """What judge says of each (region, row), its results put together; rows of candidates outside the reference drop out.

    A candidate's region goes to the groups that hold its rows, one for each ROWS_PER_PART of them. Candidates share groups, so
    that these are as many as rows and bases need, not as many as candidates. rows is cut: they are counted first.
    """
    # Rows go out by candidate and salt, so that a hot one is many groups before it is dealt, too.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("read_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    counts = rows.groupBy(*SITE, "salt").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*SITE).agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / ROWS_PER_PART).cast("int").alias("parts"))
    span = F.col("site2") - F.col("site1")
    bases = F.col("parts") * (2 * F.greatest(F.lit(linear_range), span + 5) + span + 128)
    total = sizes.agg(F.sum("n").alias("rows"), F.sum("parts").alias("units"), F.sum(bases).alias("bases"), F.count_if(F.col("parts") > 1).alias("hot")).first()
    tasks = min(total["units"] or 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, tasks, -(-(total["rows"] or 0) // ROWS_PER_PART), -(-(total["bases"] or 0) // BASES_PER_PART))
    if not total["hot"]:
        dealt, spread = rows.drop("salt").withColumn("deal", F.lit(0)), regions.withColumn("deal", F.lit(0))
    else:
        hot = sizes.where("parts > 1").select(*SITE, "parts")
        if total["hot"] <= MOST_HOT:
            dealt = rows.drop("salt").join(F.broadcast(hot), SITE, "left")
        else:
            dealt = rows.join(counts.select(*SITE, "salt").join(hot, SITE), [*SITE, "salt"], "left").drop("salt")
        parts = F.coalesce("parts", F.lit(1))
        dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("read_id"), parts).cast("int")).drop("parts")
        spread = regions.join(hot, SITE, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    bucket = F.pmod(F.xxhash64(*SITE, "deal"), F.lit(groups)).cast("long")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(mine: pa.Table, region: pa.Table) -> pa.Table:
        kinds = _kinds(schema)
        where = {(r["r_chrom"], r["r_site1"], r["r_site2"]): Region(r["region"], r["offset"], r["n"]) for r in region.to_pylist()}
        out = []
        for start in range(0, len(mine), ROWS_PER_PART):
            items = [(where.get((row["chrom"], row["site1"], row["site2"])), row) for row in mine.slice(start, ROWS_PER_PART).to_pylist()]
            out += [x for x in judge([(r, row) for r, row in items if r is not None]) if x is not None]
        return pa.table({n: pa.array([x[n] for x in out], k) for n, k in zip(names, kinds, strict=True)})

    mine = dealt.withColumn("bucket", bucket).drop("deal")
    own = spread.select(bucket.alias("r_bucket"), *(F.col(c).alias(f"r_{c}") for c in SITE), "offset", "n", "region")
    return mine.groupBy("bucket").cogroup(own.groupBy("r_bucket")).applyInArrow(run, schema)


def _kinds(schema: str) -> list[pa.DataType]:
    simple = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return [simple[x.split()[1]] for x in schema.split(", ")]
