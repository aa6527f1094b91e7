"""Cut lineage, written once to the shared checkpoint folder, and rows spread over all tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table in the folder that spark.checkpoint.dir names and read from there; in a temporary one only where driver
    and executors are one process. Unlike a checkpoint it is packed, is read by column, and its size is that of its files: a
    checkpoint keeps the estimate of its plan, by which long strings made from a small file are broadcast."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over as many tasks as a shuffle has: a small file is one task, however much is made of each of its rows."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows plus place, their number in an order from 1 on: ranges of the order are numbered apart, each from the count of the
    ranges before it, so that no task holds all rows. The ranges' counts alone meet in one task. Rows of one place in the order
    stay in one range."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return ranged.join(before, "__range").withColumn("place", place.cast("int")).drop("__range", "__before")
