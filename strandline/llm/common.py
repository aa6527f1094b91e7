"""What the operators share: tables, cut lineage, skew-safe lookups and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every contract of this package.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a task gathers before it writes them to a table in the shared folder.
BLOCK_BYTES = 16 << 20
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, by: str | None = None, packed: bool = True) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: lost executors cost no earlier step, and the plan
    starts anew. Files are kept apart by the values of a column, its last, if one is named. The folder is scratch space, to be
    removed with the application."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is not needed beside it
    try:
        written = df.write.option("parquet.block.size", BLOCK_BYTES)
        if not packed:  # small tables in many files: each codec would hold buffers beside the heap
            written = written.option("compression", "none")
        (written.partitionBy(by) if by else written).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(rows: DataFrame, facts: DataFrame, key: str, spread: Column, salts: int) -> DataFrame:
    """Inner join of rows with facts, which has one row for each key, where a key may hold a large part of the rows.

    Rows go out by (key, spread modulo salts), so a hot key becomes up to ``salts`` groups. Only the combinations that occur
    are given their facts: at most ``salts`` rows for each key, so that join is even. Neither side is broadcast, no row drops.
    Rows whose key is null are not joined.
    """
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    known = rows.select(key, "__salt").distinct().join(facts, key)
    return rows.join(known, [key, "__salt"]).drop("__salt")


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20, most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in zero-copy pieces of about most_bytes of text; a longer text is a piece of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(kernel: Kernel) -> Kernel:
    """kernel, after whose task the worker gives its memory back: workers are kept for later tasks, beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library has no such call

    return run
