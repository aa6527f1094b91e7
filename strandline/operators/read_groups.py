"""Read groups: the records of a read, by mate, in the order of the input.

Tables have read_id, flag, chrom, pos, mapq, cigar, seq and file_ord, the place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("file_ord", "flag", "chrom", "pos", "mapq", "cigar", "seq")


def slot(flag: Column) -> Column:
    """1 for the first read of a pair, else 0."""
    return F.when(flag.bitwiseAND(64) != 0, 1).otherwise(0)


def reverse_strand(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def adjacent_groups(alignments: DataFrame) -> DataFrame:
    """alignments plus group_no: a name that comes again after another one is a new group.

    The order of the whole input matters here, so the names are compared in one window over file_ord; cut the input into
    files and call this for each, or use read_id itself as the group, which is what grouped input means.
    """
    by_place = Window.partitionBy("file_name").orderBy("file_ord") if "file_name" in alignments.columns else Window.orderBy("file_ord")
    fresh = F.coalesce(F.lag("read_id").over(by_place) != F.col("read_id"), F.lit(True))
    return alignments.withColumn("group_no", F.sum(fresh.cast("long")).over(by_place))


def with_slots(alignments: DataFrame, *, group: str = "read_id") -> DataFrame:
    """One row for each group and slot: its records in order, and its representative sequence, the longest, of equals the first."""
    record = F.struct(*ORDER)
    length = F.length("seq")
    best = F.max_by(F.struct(reverse_strand(F.col("flag")).alias("reverse"), F.col("seq").alias("seq")), F.struct(length.alias("n"), (-F.col("file_ord")).alias("place"), (-F.col("flag")).alias("flag"), "seq"))
    # Records go out by group, not by slot, so that what is asked of whole groups needs no second shuffle of the sequences.
    rows = alignments.repartition(group).withColumn("slot", slot(F.col("flag")))
    return rows.groupBy(group, "slot").agg(F.array_sort(F.collect_list(record)).alias("records"), best.alias("best"))


def work_groups(slots: DataFrame, *, group: str = "read_id") -> DataFrame:
    """The groups worth judging: more than two records, or all of them in one slot."""
    per = Window.partitionBy(group)
    counted = slots.withColumn("n_records", F.sum(F.size("records")).over(per)).withColumn("n_slots", F.count("*").over(per))
    return counted.where((F.col("n_records") > 2) | (F.col("n_slots") == 1))


def last_runs(alignments: DataFrame, *, group: str = "read_id") -> DataFrame:
    """The records that count for the second scan: those of the last run of each slot, with that slot's sequence.

    Each time the records of a group change from one slot to the other, what the new slot had before is dropped. The sequence is
    that of the first record with bases in the last run that has one.
    """
    places = [F.col(c) for c in ORDER]
    in_group = Window.partitionBy(group).orderBy(*places)
    rows = alignments.withColumn("slot", slot(F.col("flag")))
    switched = F.coalesce(F.lag("slot").over(in_group) != F.col("slot"), F.lit(True))
    rows = rows.withColumn("run", F.sum(switched.cast("int")).over(in_group))
    per_slot = Window.partitionBy(group, "slot")
    has = F.col("seq").isNotNull() & ~F.col("seq").isin("", "*")
    rows = rows.withColumn("last_run", F.max("run").over(per_slot)).withColumn("seq_run", F.max(F.when(has, F.col("run"))).over(per_slot))
    told = F.min(F.when(has & (F.col("run") == F.col("seq_run")), F.struct(*ORDER))).over(per_slot)
    rows = rows.withColumn("best", F.struct(reverse_strand(told["flag"]).alias("reverse"), told["seq"].alias("seq")))
    return rows.where(F.col("run") == F.col("last_run")).drop("last_run", "seq_run")


def read_counts(alignments: DataFrame) -> DataFrame:
    """One row: the number of reads, and the length of the longest."""
    return alignments.agg(F.count_distinct("read_id").alias("reads"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("read_length"))


def first_hit(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group by an order with a full tie-break."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def unclaimed(rows: DataFrame, claims: DataFrame, on: list[str]) -> DataFrame:
    """rows without those whose key an earlier scan claims."""
    return rows.join(claims.select(*on).distinct(), on, "left_anti")


def prioritised(main: DataFrame, other: DataFrame) -> DataFrame:
    """Main rows with priority 1 and the others with 0; a row that is a main one too counts once, as such."""
    keep = main.columns
    both = main.withColumn("priority", F.lit(1)).unionByName(other.withColumn("priority", F.lit(0)))
    return both.groupBy(*keep).agg(F.max("priority").alias("priority"))
