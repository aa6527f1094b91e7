"""Hashes, orders, identifiers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of ASCII text: sum of 31 ** (n - 1 - i) * c, wrapped."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: (s * 31 + c) % (1 << 32))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("int")


def hash_slot(h: Column, entries: Column) -> Column:
    """The slot of a hash in a table of 16 or more slots, a power of two, at most three quarters full."""
    spread = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return F.pmod(spread.cast("long"), slots(entries)).cast("int")


def slots(entries: Column) -> Column:
    need = F.ceil(F.log2(F.greatest(entries, F.lit(1)) / 0.75) - 1e-9).cast("int")
    return F.pow(F.lit(2.0), F.greatest(need, F.lit(4))).cast("long")


def _number(body: Column) -> Column:
    return F.when(body.rlike("^[0-9]{1,9}$"), body).try_cast("int")


def _named(body: Column) -> Column:
    return F.when(body == "X", 23).when(body == "Y", 24).when(body.isin("M", "MT"), 25)


def result_order(chrom: Column) -> Column:
    """Sort key of results: chr and a number, then chrX, chrY, chrM, then other chr names, then the rest by name."""
    body = F.regexp_replace(chrom, "^chr", "")
    number, named = _number(body), _named(body)
    group = F.when(~chrom.startswith("chr"), 3).when(number.isNotNull(), 0).when(named.isNotNull(), 1).otherwise(2)
    rank = F.when(group < 2, F.coalesce(number, named)).otherwise(0)
    return F.struct(group.alias("group"), rank.alias("rank"), F.when(group == 2, body).when(group == 3, chrom).otherwise("").alias("name"))


def natural_order(chrom: Column) -> Column:
    """Sort key of catalogs and tracks: numbers, X as 23, Y as 24, M as 25, each with or without chr; then the rest by name."""
    body = F.regexp_replace(chrom, "^chr", "")
    rank = F.coalesce(_number(body), _named(body))
    return F.struct(rank.isNull().cast("int").alias("group"), F.coalesce(rank, F.lit(0)).alias("rank"), F.when(rank.isNull(), chrom).otherwise("").alias("name"))


def junction_id(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """chrom:start|end, with :strand in cohorts."""
    text = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("|"), end.cast("string"))
    return text if strand is None else F.concat(text, F.lit(":"), strand)


def strand_or_na(strand: Column) -> Column:
    return F.when(strand.isin("+", "-"), strand).otherwise("NA")


def clamp(value: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def junction_ratio(junction: Column, linear: Column) -> Column:
    """2 j / (2 j + l) to two decimals; zero without reads."""
    whole = 2 * junction + linear
    return F.when(whole > 0, F.round(2.0 * junction / whole, 2)).otherwise(0.0)


def quoted_attribute(attributes: Column, name: str) -> Column:
    """The quoted value of a GTF attribute; null if it is not there."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{name}[^;"]*"([^"]*)"', 1)
    return F.when(found != "", found)


def xa_tag(tags: Column) -> Column:
    found = F.regexp_extract(tags, "XA:Z:([^\t]*)", 1)
    return F.when(found == "", "*").otherwise(found)
