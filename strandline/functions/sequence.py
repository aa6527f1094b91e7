"""Nucleotide strings as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Splice signals (left of the first site, right of the second) and their strands.
SIGNALS = (("AC", "CT", "-"), ("AG", "GT", "+"))
# The wider set; even places are of the minus strand, odd ones of the plus strand.
RELAXED_SIGNALS = (("AC", "CT", "-"), ("AG", "GT", "+"), ("GC", "CT", "-"), ("AG", "GC", "+"), ("AT", "GT", "-"), ("AC", "AT", "+"), ("AT", "CT", "-"), ("AG", "AT", "+"))


def reverse_complement(seq: Column) -> Column:
    """Case stays, other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def strict_reverse_complement(seq: Column) -> Column:
    """In upper case; what is no base is N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def between(seq: Column, start: Column, end: Column) -> Column:
    """Bases [start, end), counted from 0; null where that is no part of the sequence."""
    return F.when((start >= 0) & (end >= start) & (end <= F.length(seq)), F.substring(seq, start + 1, end - start))


def window(seq: Column, start: Column, end: Column) -> Column:
    """Bases [start, end), counted from 0, with N where the sequence has none."""
    n = F.length(seq)
    left = F.least(F.greatest(-start, F.lit(0)), F.greatest(end - start, F.lit(0)))
    lo, hi = F.least(F.greatest(start, F.lit(0)), n), F.least(F.greatest(end, F.lit(0)), n)
    middle = F.substring(seq, lo + 1, F.greatest(hi - lo, F.lit(0)))
    padded = F.concat(F.repeat(F.lit("N"), left), middle)
    return F.rpad(padded, F.greatest(end - start, F.lit(0)), "N")


def oriented(seq: Column, same_strand: Column) -> Column:
    """A read as its alignment has it: reversed unless the alignment is on the strand that the read was given on."""
    return F.when(same_strand, seq).otherwise(reverse_complement(seq))


def signal_rows(rows: DataFrame, left: Column, right: Column, relaxed: bool = False) -> DataFrame:
    """rows with shift, strand, signal_left, signal_right: one for each offset at which both windows have a splice signal.

    Where several signals fit one offset, the last of the list holds. Offsets are rows, so that the comparison is compiled.
    """
    signals = RELAXED_SIGNALS if relaxed else SIGNALS
    each = rows.withColumn("__a", F.upper(left)).withColumn("__b", F.upper(right))
    last = F.least(F.length("__a"), F.length("__b")) - 2
    each = each.withColumn("shift", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))).withColumn("signal_left", F.substring("__a", F.col("shift") + 1, F.lit(2))).withColumn("signal_right", F.substring("__b", F.col("shift") + 1, F.lit(2)))
    strand = F.lit(None).cast("string")
    for p, q, s in signals:
        strand = F.when((F.col("signal_left") == p) & (F.col("signal_right") == q), s).otherwise(strand)
    return each.withColumn("strand", strand).where("strand is not null").drop("__a", "__b")


def mate_bucket(flag: Column) -> Column:
    """1, 2 or 0: which read of a pair the flag names."""
    return F.when(flag.bitwiseAND(64) != 0, 1).when(flag.bitwiseAND(128) != 0, 2).otherwise(0)
