"""Simulated reads of circles and of linear transcripts, with their truth.

Every random number is a function of a seed and of the row's own keys, so that results do not depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .lineage import spread

EXON = ["chrom", "start", "end", "strand"]


@dataclass(frozen=True)
class SimConf:
    seed: int = 1
    circles: int = 100
    read_length: int = 150
    coverage: float = 10.0
    exclusive_rate: float = 0.05
    min_exons: int = 2
    max_exons: int = 8
    second_isoform_rate: float = 0.5
    insert_mean: float = 350.0
    insert_sd: float = 50.0
    second_insert_mean: float = 450.0
    second_insert_share: float = 0.3
    error_rate: float = 0.01

    def __post_init__(self) -> None:
        if not (0 <= self.exclusive_rate <= 1 and 0 <= self.error_rate <= 1 and self.read_length > 0 and 2 <= self.min_exons <= self.max_exons):
            raise ValueError("simulation settings")


def uniform(seed: int, stream: str, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest of the keys."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.lit(stream), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("long") / float(1 << 32)


def normal(seed: int, stream: str, mean: Column, sd: Column, *keys: str) -> Column:
    """By Box and Muller, from two uniform numbers."""
    u, v = uniform(seed, stream + "u", *keys), uniform(seed, stream + "v", *keys)
    return mean + sd * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)


def exclusive_exons(exons: DataFrame, conf: SimConf) -> DataFrame:
    """The distinct exons that only circles have."""
    return exons.select(*EXON).distinct().where(uniform(conf.seed, "exclusive", *EXON) < conf.exclusive_rate)


def linear_exons(exons: DataFrame, exclusive: DataFrame) -> DataFrame:
    return exons.join(exclusive, EXON, "left_anti")


def surviving_transcripts(exons: DataFrame, exclusive: DataFrame) -> DataFrame:
    """gene_id, transcript_id of transcripts that keep an exon."""
    return linear_exons(exons, exclusive).select("gene_id", "transcript_id").distinct()


def linear_annotation(lines: DataFrame, exons: DataFrame, exclusive: DataFrame) -> DataFrame:
    """The lines of an annotation without exclusive exons and without what has no exon left, in order."""
    alive = surviving_transcripts(exons, exclusive)
    kept = lines.where(F.col("feature") == "exon").join(exclusive, EXON, "left_anti")
    transcripts = lines.where(F.col("feature") == "transcript").join(alive.select("transcript_id").distinct(), "transcript_id", "left_semi")
    genes = lines.where(F.col("feature") == "gene").join(alive.select("gene_id").distinct(), "gene_id", "left_semi")
    columns = ["line_no", "raw_line"]
    return kept.select(*columns).unionByName(transcripts.select(*columns)).unionByName(genes.select(*columns)).orderBy("line_no")


def transcripts(exons: DataFrame) -> DataFrame:
    """chrom, gene_id, transcript_id, strand, exons: distinct exons in order."""
    rows = exons.where("transcript_id is not null")
    return rows.groupBy("chrom", "gene_id", "transcript_id", "strand").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))


def choose_circles(exons: DataFrame, conf: SimConf) -> DataFrame:
    """circ_id, isoform_id and the exons of isoforms: windows of exons of randomly chosen transcripts; some circles have a second
    isoform without one inner exon. Circles shorter than a read (80 bases at least) are not taken."""
    rows = transcripts(exons).where(F.size("exons") >= conf.min_exons)
    n = F.size("exons")
    width = F.least(n, F.lit(conf.max_exons)) - conf.min_exons + 1
    count = conf.min_exons + F.floor(uniform(conf.seed, "count", "transcript_id") * width).cast("int")
    rows = rows.withColumn("count", count).withColumn("first", F.floor(uniform(conf.seed, "first", "transcript_id") * (n - F.col("count") + 1)).cast("int") + 1)
    rows = rows.withColumn("exons", F.slice("exons", F.col("first"), F.col("count")))
    length = lambda e: F.aggregate(e, F.lit(0), lambda s, x: s + x["end"] - x["start"] + 1)
    rows = rows.where(length(F.col("exons")) >= max(conf.read_length, 80))
    rows = rows.withColumn("circ_id", F.concat("chrom", F.lit(":"), F.element_at("exons", 1)["start"], F.lit("|"), F.element_at("exons", -1)["end"]))
    first = F.row_number().over(Window.partitionBy("circ_id").orderBy("transcript_id"))
    rows = rows.withColumn("k", first).where("k = 1").drop("k", "first", "count")
    rows = rows.orderBy(uniform(conf.seed, "pick", "transcript_id"), "transcript_id").limit(conf.circles)
    inner = 2 + F.floor(uniform(conf.seed, "skip", "circ_id") * (F.size("exons") - 2)).cast("int")
    without = F.filter("exons", lambda x, i: i != inner - 1)
    two = (F.size("exons") > 2) & (uniform(conf.seed, "two", "circ_id") < conf.second_isoform_rate) & (length(without) >= max(conf.read_length, 80))
    isoforms = F.when(two, F.array(F.col("exons"), without)).otherwise(F.array(F.col("exons")))
    rows = rows.select("circ_id", "chrom", "gene_id", "transcript_id", "strand", F.posexplode(isoforms).alias("k", "exons"))
    return rows.select("circ_id", F.concat_ws(".", "circ_id", F.concat(F.lit("iso"), (F.col("k") + 1).cast("string"))).alias("isoform_id"), "chrom", "gene_id", "transcript_id", "strand", "exons", length(F.col("exons")).alias("length"))


def with_sequence(isoforms: DataFrame, chunks: DataFrame, chunk: int, keys: list[str]) -> DataFrame:
    """isoforms plus seq, the bases of their exons in reading direction."""
    parts = isoforms.select(*keys, "chrom", F.posexplode("exons").alias("i", "x")).select(*keys, "chrom", "i", F.col("x.start").alias("a"), F.col("x.end").alias("b"))
    parts = parts.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("a") - 1) / chunk).cast("int"), F.floor((F.col("b") - 1) / chunk).cast("int"))))
    met = parts.join(chunks.select("chrom", "chunk", "seq"), ["chrom", "chunk"])
    lo = F.greatest(F.col("a") - 1 - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("b") - F.col("chunk") * chunk, F.lit(chunk))
    text = met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk", F.substring("seq", lo + 1, hi - lo).alias("s")))), lambda p: p["s"]), "").alias("seq"))
    return isoforms.join(text, keys).withColumn("seq", F.when(F.col("strand") == "-", S.strict_reverse_complement(F.col("seq"))).otherwise(F.upper("seq")))


def pair_count(length: Column, coverage: Column, read_length: int, least: int) -> Column:
    """Pairs that cover a length so often: at least one for circles, none for transcripts."""
    return F.greatest(F.round(length * coverage / (2.0 * read_length)).cast("long"), F.lit(least))


def insert_length(length: Column, conf: SimConf, *keys: str) -> Column:
    """Of two normal kinds; of short circles mostly near the circle's own length."""
    long = F.when(uniform(conf.seed, "kind", *keys) < conf.second_insert_share, F.lit(conf.second_insert_mean)).otherwise(F.lit(conf.insert_mean))
    mean = F.when((length <= 300) & (uniform(conf.seed, "short", *keys) < 0.7), length.cast("double")).otherwise(long)
    return F.greatest(F.round(normal(conf.seed, "insert", mean, F.lit(conf.insert_sd), *keys)).cast("int"), F.lit(conf.read_length))


def usage_profiles(isoforms: DataFrame, switching: bool = False) -> DataFrame:
    """isoform_id, usage of each isoform of a circle: 0.85 and 0.15, swapped in the other sample of a switch; 0.9 and the rest."""
    by = Window.partitionBy("circ_id")
    rank, n = F.row_number().over(by.orderBy("isoform_id")), F.count("*").over(by)
    rows = isoforms.select("circ_id", "isoform_id", rank.alias("rank"), n.alias("n"))
    main = F.col("rank") == (F.lit(2) if switching else F.lit(1))
    two = F.when(main, 0.85).otherwise(0.15)
    more = F.when(F.col("rank") == 1, 0.9).otherwise(0.1 / F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.select("circ_id", "isoform_id", F.when(F.col("n") == 1, 1.0).when(F.col("n") == 2, two).otherwise(more).alias("usage"))


_CODES = np.full(256, 4, np.uint64)
_CODES[list(b"ACGT")] = range(4)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random of each number, by the finish of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def changed_bases(reads: list[str | None], names: list[str], side: str, rate: float, seed: int) -> list[str | None]:
    """The reads with bases changed to another one at a rate; where and to which is told by seed, name, side and place. All reads
    are changed side by side."""
    text = "".join(r or "" for r in reads).encode("ascii", "replace")
    sizes = np.array([len(r or "") for r in reads], np.int64)
    ends = np.cumsum(sizes)
    keys = np.fromiter((hash_of(f"{seed}|{name}|{side}") for name in names), np.uint64, len(names))
    place = (np.arange(len(text)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    drawn = _mixed(_mixed(np.repeat(keys, sizes) + np.uint64(0x9E3779B97F4A7C15)) + place * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero((drawn >> np.uint64(11)) < rate * 2.0**53)
    bases = np.frombuffer(text, np.uint8).copy()
    code = _CODES[bases[at]]
    pick = (drawn[at] & np.uint64(0x7FF)) % np.where(code < 4, 3, 4).astype(np.uint64)
    bases[at] = np.frombuffer(b"ACGT", np.uint8)[(pick + (pick >= code)).astype(np.int64)]
    whole = bases.tobytes().decode()
    return [None if r is None else whole[e - n : e] for r, n, e in zip(reads, sizes.tolist(), ends.tolist(), strict=True)]


def _with_errors(pairs: DataFrame, conf: SimConf) -> DataFrame:
    if conf.error_rate == 0:
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            names = columns["read_id"].to_pylist()
            for side in ("r1", "r2"):
                columns[side] = pa.array(changed_bases(columns[side].to_pylist(), names, side, conf.error_rate, conf.seed), batch.schema.field(side).type)
            yield pa.record_batch(list(columns.values()), names=batch.schema.names)

    return pairs.mapInArrow(run, pairs.schema)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def circular_pairs(isoforms: DataFrame, conf: SimConf, usage: DataFrame | None = None) -> DataFrame:
    """read_id, circ_id, isoform_id, start, insert, r1, r2, is_bsj, r1_is_bsj, r2_is_bsj: pairs of reads around each circle.

    isoforms: with seq. A circle's pairs are dealt to its isoforms by usage, each isoform one at least. A read goes over the
    junction if it passes the end of the circle's sequence.
    """
    usage = usage_profiles(isoforms) if usage is None else usage
    rows = isoforms.join(usage.select("isoform_id", "usage"), "isoform_id")
    n = F.greatest(F.round(pair_count(F.col("length"), F.lit(conf.coverage), conf.read_length, 1) * F.col("usage")).cast("long"), F.lit(1))
    rows = spread(rows, "isoform_id").withColumn("pair", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    keys = ("isoform_id", "pair")
    rows = rows.withColumn("insert", insert_length(F.col("length"), conf, *keys)).withColumn("from", F.floor(uniform(conf.seed, "start", *keys) * F.col("length")).cast("int"))
    R, L = conf.read_length, F.col("length")
    around = lambda start: F.substring(F.repeat("seq", F.ceil((start % L + R) / L).cast("int")), (start % L).cast("int") + 1, F.lit(R))
    second = F.col("from") + F.col("insert") - R
    over = lambda start: (start % L) + R > L
    rows = rows.select(F.concat_ws(":", "isoform_id", F.col("pair").cast("string")).alias("read_id"), "circ_id", "isoform_id", F.col("from").alias("start"), "insert", around(F.col("from")).alias("r1"), S.strict_reverse_complement(around(second)).alias("r2"), over(F.col("from")).cast("int").alias("r1_is_bsj"), over(second).cast("int").alias("r2_is_bsj"))
    rows = rows.withColumn("is_bsj", F.greatest("r1_is_bsj", "r2_is_bsj"))
    return _with_errors(rows, conf)


def linear_pairs(transcripts_seq: DataFrame, conf: SimConf) -> DataFrame:
    """Pairs of reads of linear transcripts (transcript_id, seq); starts are drawn where the insert fits, so none is drawn twice."""
    rows = transcripts_seq.withColumn("length", F.length("seq")).where(F.col("length") >= conf.read_length)
    rows = rows.withColumn("n", pair_count(F.col("length"), F.lit(conf.coverage), conf.read_length, 0)).where("n > 0")
    rows = spread(rows, "transcript_id").withColumn("pair", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    keys = ("transcript_id", "pair")
    rows = rows.withColumn("insert", F.least(insert_length(F.col("length"), conf, *keys), F.col("length")))
    rows = rows.withColumn("from", F.floor(uniform(conf.seed, "lstart", *keys) * (F.col("length") - F.col("insert") + 1)).cast("int"))
    r2 = S.strict_reverse_complement(F.substring("seq", F.col("from") + F.col("insert") - conf.read_length + 1, F.lit(conf.read_length)))
    rows = rows.select(F.concat_ws(":", "transcript_id", F.col("pair").cast("string")).alias("read_id"), "transcript_id", F.col("from").alias("start"), "insert", F.substring("seq", F.col("from") + 1, F.lit(conf.read_length)).alias("r1"), r2.alias("r2"))
    return _with_errors(rows, conf)


def outward_truth(a1: Column, b1: Column, a2: Column, b2: Column, least: int = 19) -> Column:
    """Whether the forward mate [a1, b1] lies right of the reverse mate [a2, b2] by so much at both ends."""
    return (F.greatest(a1 - a2, F.lit(0)) >= least) & (F.greatest(b1 - b2, F.lit(0)) >= least)


def isoform_truth(isoforms: DataFrame, pairs: DataFrame, conf: SimConf) -> DataFrame:
    """Each isoform with its exons written out, its reads and those over the junction."""
    counts = pairs.groupBy("isoform_id").agg(F.count("*").alias("read_cnt"), F.sum("is_bsj").cast("long").alias("bsj_read_cnt"))
    chain = F.array_join(F.transform("exons", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), F.col("strand"))), "|")
    return isoforms.select("circ_id", "isoform_id", "chrom", "strand", "gene_id", "transcript_id", "length", chain.alias("isoform_exons")).join(counts, "isoform_id", "left").na.fill(0, ["read_cnt", "bsj_read_cnt"]).withColumn("coverage", F.lit(conf.coverage))


def usage_truth(pairs: DataFrame) -> DataFrame:
    """isoform_id, usage, read_cnt, bsj_read_cnt: each isoform's share of its circle's pairs."""
    per = pairs.groupBy("circ_id", "isoform_id").agg(F.count("*").alias("read_cnt"), F.sum("is_bsj").cast("long").alias("bsj_read_cnt"))
    return per.withColumn("usage", F.col("read_cnt") / F.greatest(F.sum("read_cnt").over(Window.partitionBy("circ_id")), F.lit(1)))


def fastq_lines(pairs: DataFrame, side: str) -> DataFrame:
    """value: records of one side's reads, in order of read_id, all qualities I; write with gzip compression."""
    name = F.concat(F.lit("@"), "read_id", F.lit("/1" if side == "r1" else "/2"))
    return pairs.orderBy("read_id").select(F.concat_ws("\n", name, side, F.lit("+"), F.repeat(F.lit("I"), F.length(side))).alias("value"))
