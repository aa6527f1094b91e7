"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

The targets are water-filled over the sources with window functions. Within a source every document has the same expected
number of copies; documents stand in a fixed order by size, and one is emitted once for each integer that the prefix sum of
expected copies, moved by one random offset for each source, passes at it. The prefix sum is taken in two levels (blocks of a
source, rows of a block), so that a source with a third of all rows is many small window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

ROWS_PER_BLOCK = 1 << 14


def words(text: Column) -> Column:
    """The number of words in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row for each source: its size and target. sizes: __null, __source, size.

    Its windows see one row for each source, never documents.
    """
    per = sizes.groupBy("__null", "__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy("__null", "__source")
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("cap", F.col("source_size") * most)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    every = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("fill", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if just the sources before this one are full. The first source that its level does not fill sets the level.
    per = per.withColumn("level", left / free)
    level = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "rank", "level"))).over(every)["level"]
    per = per.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)))
    return per.select("__null", "__source", "source_size", "n_docs", "target")


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, carry: bool) -> DataFrame:
    """The rows of docs with their copies; with carry, whole rows go along as ``__row``."""
    # Rows without a doc_id are told apart by their text, or all of them would stand in one block.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    sizes = docs.select("doc_id", F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), words(F.col("text")).alias("size"), key.alias("__key"), *([F.struct("*").alias("__row")] if carry else []))
    sizes = cut(sizes)
    n = sizes.count()
    # Documents of a source in order of size, so that each stretch of the prefix sum carries close to its share of words.
    sizes = sizes.withColumn("__class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    sizes = sizes.withColumn("__part", F.pmod("__key", F.lit(max(16, n // ROWS_PER_BLOCK))).cast("int"))
    block = ["__null", "__source", "__class", "__part"]
    in_source = Window.partitionBy("__null", "__source").orderBy("__class", "__part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy(*block).agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    facts = blocks.join(source_targets(sizes, weights, share, most), ["__null", "__source"]).drop("n", "n_docs")
    # Rows that agree in all that is ordered by may still differ elsewhere.
    tie = [F.xxhash64(F.to_json("__row"))] if carry else []
    in_block = Window.partitionBy(*block).orderBy("size", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", *tie)
    placed = sizes.withColumn("__rank", F.row_number().over(in_block)).join(facts, block)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("__source", "__null", F.lit(seed + 2)), F.lit(1 << 53)) / float(1 << 53)
    passed = lambda k: F.floor(each * k + offset)
    rank = F.col("__before") + F.col("__rank")
    return placed.withColumn("copies", (passed(rank) - passed(rank - 1)).cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for each row of docs (doc_id, source, text).

    Size is the number of words; null and empty texts have none and take no words. Sources stand in code point order, null
    last, and get ``weights`` in turn of ``share`` times all words; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight. Rows that repeat a doc_id are separate rows. Reruns agree, whatever the partitions.
    An empty table gives an empty one. Other columns are not read.
    """
    placed = _placed(docs, weights, share, most, seed, False)
    return placed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with each row as often as mix_plan's copies say (0, 1 or more times); all columns stay.

    Rows go through the plan whole: those without a doc_id, and each of those that repeat one, have copies of their own.
    """
    rows = _placed(docs, weights, share, most, seed, True).where("copies > 0").select("__row", "copies")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
