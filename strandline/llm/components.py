"""Connected components of a link table by repeated contraction; every table stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SALTS = 64


def _follow(rows: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """rows with key replaced by its parent where it has one (parents: v, p). A key may stand in any part of the rows."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    known = rows.select(F.col(key).alias("v"), "__salt").distinct().join(parents, "v")
    known = known.select(F.col("v").alias(key), "__salt", F.col("p").alias("__p"))
    return rows.join(known, [key, "__salt"], "left").withColumn(key, F.coalesce("__p", key)).drop("__salt", "__p")


def _to_roots(hooks: DataFrame) -> DataFrame:
    """hooks (v, p) with p followed to its end; each step doubles the way, so a chain of n takes log n steps."""
    hooks = cut(hooks)
    while True:
        further = cut(_follow(hooks.withColumn("was", F.col("p")), "p", hooks))
        hooks = further.select("v", "p")
        if further.where("p <> was").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for each id in links (a, b: long); component_id is the smallest id that links reach.

    Each round every id hooks to its smallest smaller neighbour, hooks are followed to their ends, and the links are redrawn
    between these, so the ids that remain at least halve. Loops, repeated links and nulls are ignored. No links: no rows.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    links = cut(links.distinct())
    labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component_id", F.col("id"))
    first = True
    while not links.isEmpty():
        hooks = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        hooks = _to_roots(hooks)
        labels = cut(_follow(labels, "component_id", hooks)) if not first else cut(labels.join(hooks.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("p", "component_id").alias("component_id")))
        first = False
        links = _follow(_follow(links, "a", hooks), "b", hooks).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = cut(links.where("a < b").distinct())
    return labels
