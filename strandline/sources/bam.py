"""BAM as a data source: partitions are ranges of compressed bytes, each reads the blocks that begin in its range.

A record belongs to the partition in whose first-to-last block it starts. Local files only (the format is read by random access).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id string, flag int, chrom string, pos int, mapq int, cigar string, seq string, xa string, file_ord long"
# The format's codes.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
MAGIC = b"\x1f\x8b\x08\x04"
SHARD = 4 << 20
ROWS = 4096


def is_bam(path: str) -> bool:
    """By the first four bytes: the format's own magic, or that of its compression."""
    with open(path, "rb") as f:
        head = f.read(4)
    return head in (b"BAM\1", MAGIC)


def blocks(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from start on that begin before end; start is a block's."""
    f.seek(start)
    at = start
    while at < end:
        head = f.read(18)
        if len(head) < 18:
            return
        size = struct.unpack("<H", head[16:18])[0] + 1
        yield at, zlib.decompress(f.read(size - 18)[:-8], -15)
        at += size


def next_block(f, start: int, end: int) -> int:
    """The offset of the first block that begins at start or after it; end if there is none."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(1 << 17)
        k = data.find(MAGIC)
        while k >= 0:
            if data[k + 12 : k + 16] == b"BC\x02\x00" and k + 18 <= len(data):
                size = struct.unpack("<H", data[k + 16 : k + 18])[0] + 1
                f.seek(at + k + size)
                follows = f.read(4)
                if follows in (MAGIC, b""):
                    return at + k
            k = data.find(MAGIC, k + 1)
        if len(data) <= 18:
            return end
        at += len(data) - 18
    return end


def header(path: str) -> tuple[str, list[str], tuple[int, int]]:
    """The text, the reference names, and where records begin: a block's offset and a place in it."""
    with open(path, "rb") as f:
        data, starts = b"", []

        def have(n: int, source) -> None:
            nonlocal data
            while len(data) < n:
                offset, content = next(source)
                starts.append((offset, len(data)))
                data += content

        source = blocks(f, 0, os.path.getsize(path))
        have(8, source)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        n = struct.unpack("<i", data[4:8])[0]
        have(12 + n, source)
        text = data[8 : 8 + n].decode("utf-8", "replace").rstrip("\0")
        count, at, names = struct.unpack("<i", data[8 + n : 12 + n])[0], 12 + n, []
        for _ in range(count):
            have(at + 4, source)
            k = struct.unpack("<i", data[at : at + 4])[0]
            have(at + 8 + k, source)
            names.append(data[at + 4 : at + 3 + k].decode())
            at += 8 + k
        if at == len(data):
            after = next(source, (os.path.getsize(path), b""))
            return text, names, (after[0], 0)
        offset, before = max(s for s in starts if s[1] <= at)
        return text, names, (offset, at - before)


def check_grouped(path: str) -> None:
    """Coordinate order tears reads apart; it is an error."""
    if "SO:coordinate" in header(path)[0]:
        raise ValueError(f"{path} is sorted by coordinate; sort it by name")


def record(data: bytes, names: list[str], order: int) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, n_bases = struct.unpack("<iiBBHHHi", data[:20])
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    ops = struct.unpack(f"<{n_ops}I", data[at : at + 4 * n_ops])
    at += 4 * n_ops
    packed = data[at : at + (n_bases + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_bases]
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops)
    tags = data[at + len(packed) + n_bases :]
    return name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq or "*", _xa(tags), order


def _xa(tags: bytes) -> str:
    at, width = 0, {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
    while at + 3 <= len(tags):
        kind = tags[at + 2 : at + 3]
        if kind in (b"Z", b"H"):
            end = tags.find(b"\0", at + 3)
            if end < 0:
                break
            if tags[at : at + 2] == b"XA" and kind == b"Z":
                return tags[at + 3 : end].decode("utf-8", "replace") or "*"
            at = end + 1
        elif kind == b"B":
            n = struct.unpack("<i", tags[at + 4 : at + 8])[0]
            at += 8 + n * width.get(tags[at + 3 : at + 4], 1)
        else:
            at += 3 + width.get(kind, 1)
    return "*"


class Shard(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, path: str, shard: int) -> None:
        self.path, self.shard = path, shard

    def partitions(self) -> list[InputPartition]:
        check_grouped(self.path)
        size = os.path.getsize(self.path)
        return [Shard(self.path, a, min(a + self.shard, size)) for a in range(0, size, self.shard)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        _, names, (first, skip) = header(partition.path)
        size = os.path.getsize(partition.path)
        with open(partition.path, "rb") as f:
            start = max(first, next_block(f, partition.start, size)) if partition.start > first else first
            if start >= partition.end:
                return
            rows: list[tuple] = []
            for row in self._records(f, start, skip if start == first else None, partition.end, size, names):
                rows.append(row)
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _records(self, f, start: int, skip: int | None, end: int, size: int, names: list[str]) -> Iterator[tuple]:
        """The records that start in blocks from start to end. Writers begin a block with a record, or the last one runs over into
        it; where that is unknown the start is the first place from which records follow one another."""
        source = blocks(f, start, size)
        offset, data = next(source)
        spans = [(offset, 0)]
        while skip is None and len(data) < 1 << 17:  # enough to see records follow one another
            more = next(source, None)
            if more is None:
                break
            spans.append((more[0], len(data)))
            data += more[1]
        at = skip if skip is not None else _first_record(data, len(names))
        while True:
            while spans and len(spans) > 1 and spans[1][1] <= at:
                spans.pop(0)
            if spans[0][0] >= end:
                return
            while len(data) < at + 4 or len(data) < at + 4 + struct.unpack("<i", data[at : at + 4])[0]:
                more = next(source, None)
                if more is None:
                    return
                spans.append((more[0], len(data)))
                data += more[1]
            while len(spans) > 1 and spans[1][1] <= at:
                spans.pop(0)
            if spans[0][0] >= end:
                return
            n = struct.unpack("<i", data[at : at + 4])[0]
            yield record(data[at + 4 : at + 4 + n], names, (spans[0][0] << 17) + at - spans[0][1])
            at += 4 + n
            if at > 1 << 20:
                base = spans[0][1]
                data, at, spans = data[base:], at - base, [(o, p - base) for o, p in spans]


def _first_record(data: bytes, n_refs: int) -> int:
    def plausible(at: int) -> int | None:
        if at + 36 > len(data):
            return None
        n, ref, pos, l_name, _, _, n_ops, _, n_bases, mate = struct.unpack("<iiiBBHHHii", data[at : at + 28])
        name_end = at + 36 + l_name - 1
        fine = -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and l_name > 1 and n >= 32 + l_name + 4 * n_ops + n_bases + (n_bases + 1) // 2 and n_bases >= 0
        return at + 4 + n if fine and (name_end >= len(data) or data[name_end] == 0) else None

    for at in range(len(data)):
        after = plausible(at)
        if after is not None and (after + 36 > len(data) or plausible(after) is not None):
            return at
    return len(data)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("shard", SHARD)))


def read_bam(spark: SparkSession, path: str, shard: int = SHARD) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("shard", shard).load(path)
