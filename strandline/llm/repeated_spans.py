"""Removal of repeated byte strings, by difference-cover blockwise suffix ordering.

Only whether a suffix shares its first SPAN bytes with another one matters, so suffixes are ordered by fingerprints of what they
start with, one bucket of suffixes at a time. First the suffixes at the positions of a difference cover are ordered by their
first SPAN - PERIOD + 1 bytes. For any two suffixes, some shift of less than PERIOD puts both on the cover; so two that agree in
SPAN bytes have, after that shift, cover suffixes of equal rank, and a suffix with no repeated rank within a period is alone.
Then the others are ordered by their first SPAN bytes, in ROUNDS passes over disjoint ranges of fingerprints; each pass is dealt
into buckets of bounded size, and each bucket is sorted on its own. These fingerprints, which decide what goes, have 95 bits from
two unlike polynomials; those of the cover, which only let suffixes be looked at, 64. A slice of documents sends each fingerprint
once, however often it has it, so that a passage in a third of all documents is as many rows as there are slices, not occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

SPAN = 200
#: A difference cover modulo PERIOD; every residue is a difference of two of its elements.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SAMPLE = SPAN - PERIOD + 1
ROUNDS = 3
#: Bytes of a text's key, and fingerprints that a task remembers to have sent.
KEY, REMEMBERED = 16, 1 << 20
#: Bytes of text that a task orders at once; a longer text is cut into stretches that overlap by a span.
SLICE = 2 << 20
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 256
BASE = 0x9E3779B97F4A7C15
#: The field and the base of the second polynomial.
PRIME, SECOND_BASE = (1 << 31) - 1, 0x5DEECE66


def powers(base: int, n: int, modulus: int | None = None) -> np.ndarray:
    """The first n powers, modulo 2 ** 64 or a number below 2 ** 32."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, modulus or 1 << 64))
        if modulus:
            out[k : k + m] %= np.uint64(modulus)
        k += m
    return out


class Fingerprints:
    """Fingerprints of equally long byte strings at any positions of at most SLICE bytes and one string more."""

    def __init__(self) -> None:
        self.up = self.down = self.second_up = self.second_down = np.zeros(0, np.uint64)

    def at(self, data: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        """Polynomials modulo 2 ** 64, mixed."""
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[where + width] - sums[where]) * self.down[where]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def second(self, data: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        """Polynomials modulo PRIME, of the same strings. No sum overflows: 2 ** 8 times 2 ** 31 for each byte."""
        n = len(data)
        if len(self.second_up) < n:
            self.second_up, self.second_down = powers(SECOND_BASE, n, PRIME), powers(pow(SECOND_BASE, -1, PRIME), n, PRIME)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.second_up[:n], out=sums[1:])
        return ((sums[where + width] - sums[where]) % np.uint64(PRIME) * self.second_down[where] % np.uint64(PRIME)).astype(np.uint32)


def _sorted_equals(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal fingerprints (h, g) side by side, and whether each in it equals the one before."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if g is not None:
        agree = g[order[1:]] == g[order[:-1]]
        if (same & ~agree).any():  # equal in h only: such may stand between equal ones
            order = np.lexsort((g, h))
            same, agree = h[order[1:]] == h[order[:-1]], g[order[1:]] == g[order[:-1]]
        same &= agree
    return order, np.append(False, same)[: len(h)]


# ---------------------------------------------------------------- numbers as bytes


def pack(rising: np.ndarray) -> bytes:
    """Rising numbers as gaps, in one, two or four bytes each."""
    gaps = np.diff(rising, prepend=0)
    kind = np.uint8 if gaps.max(initial=0) < 256 else np.uint16 if gaps.max(initial=0) < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[packed[0]]
    return np.cumsum(np.frombuffer(packed, kind, offset=1), dtype=np.int64)


# ---------------------------------------------------------------- which suffixes are repeated


@dataclass
class Suffixes:
    """Which suffixes of a text are ordered, by how many bytes, and the part of the fingerprints that this pass takes."""

    width: int
    #: (bytes in the text, marks, from, to) -> rising positions in that stretch.
    positions: Callable[[int, bytes | None, int, int], np.ndarray]
    #: Whether the fingerprints decide, and so have their second part.
    decide: bool = False
    round: int = 0
    rounds: int = 1


def cover_positions(n: int, marks: bytes | None = None, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The positions of the cover at which SAMPLE bytes begin."""
    stop = min(n - SAMPLE + 1, n if stop is None else stop)
    if stop <= start:
        return np.zeros(0, np.int64)
    found = (np.arange(start // PERIOD * PERIOD, stop, PERIOD)[:, None] + np.array(COVER)).ravel()
    return found[(found >= start) & (found < stop)]


def nth_cover_positions(numbers: np.ndarray) -> np.ndarray:
    return numbers // len(COVER) * PERIOD + np.array(COVER)[numbers % len(COVER)]


def open_positions(n: int, marks: bytes | None, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The positions at which SPAN bytes begin that have, less than a period on, a repeated suffix of the cover (its number in
    marks)."""
    stop = min(n - SPAN + 1, n if stop is None else stop)
    if stop <= start or not marks:
        return np.zeros(0, np.int64)
    at = nth_cover_positions(unpack(marks))
    at = at[np.searchsorted(at, start) : np.searchsorted(at, stop + PERIOD)] - start
    change = np.zeros(stop - start + 1, np.int32)
    np.add.at(change, np.maximum(at - PERIOD + 1, 0), at - PERIOD + 1 <= stop - start)
    np.add.at(change, at[at < stop - start] + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0) + start


SENT = "bucket int, origin long, numbers binary, prints binary"


def _send(want: Suffixes, buckets: int):
    """Rows of a bucket's fingerprints in a slice, and one directory row a slice: its texts and what repeats inside it.

    A suffix is known by its number among the slice's suffixes, in order. What repeats inside a slice needs no answer, only to be
    known to others: a task sends it once and remembers that, so that a passage all over the corpus is about a row a task.
    """

    def told_before(told: tuple, h: np.ndarray, g: np.ndarray | None) -> np.ndarray:
        if not len(told[0]):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(told[0], h), len(told[0]) - 1)
        return (told[0][at] == h) & (True if g is None else told[1][at] == g)

    def rows(keys: list[bytes], places: list[int], counts: list[int], number: np.ndarray, h: np.ndarray, g: np.ndarray | None, seq: int, told: tuple) -> tuple[pa.RecordBatch, tuple]:
        origin = (TaskContext.get().partitionId() << 32) + seq
        order, same = _sorted_equals(h, g)
        twice = np.sort(number[order[same | np.append(same[1:], False)[: len(h)]]])
        inside = order[~same & np.append(same[1:], False)[: len(h)]]  # the first of those that repeat inside
        old = told_before(told, h[inside], None if g is None else g[inside])
        fresh = inside[~old][:REMEMBERED]
        if len(told[0]) + len(fresh) > REMEMBERED:
            told = (h[:0], h[:0])
        more = np.append(told[0], h[fresh])
        by = np.argsort(more)
        told = (more[by], np.append(told[1], h[fresh] if g is None else g[fresh])[by])
        sent = ~same
        sent[np.flatnonzero(~same & np.append(same[1:], False)[: len(h)])[old]] = False
        once = np.sort(order[sent])
        h, number = h[once], number[once]
        bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        # Small numbers are sorted by digits, which is far faster.
        by = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
        bucket, h, number = bucket[by].astype(np.int64), h[by], number[by]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*edges[1:].tolist(), len(by)][: len(edges)]
        g = None if g is None else g[once][by]
        prints = [h[a:b].tobytes() + (b"" if g is None else g[a:b].tobytes()) for a, b in zip(edges.tolist(), ends, strict=True)]
        out = [(int(bucket[a]), origin, pack(number[a:b]), x) for a, b, x in zip(edges.tolist(), ends, prints, strict=True)]
        directory = np.array([len(keys), *places, *counts], np.int64).tobytes() + b"".join(keys)
        out.append((buckets + origin % buckets, origin, pack(twice), directory))
        b, o, n, p = zip(*out, strict=True)
        return pa.record_batch([pa.array(b, pa.int32()), pa.array(o, pa.int64()), pa.array(n, pa.binary()), pa.array(p, pa.binary())], names=["bucket", "origin", "numbers", "prints"]), told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seq, told = Fingerprints(), 0, (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        keys, places, counts, texts, where, size = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal told
            data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(where)
            h, number = prints.at(data, at, want.width), np.arange(len(at))
            if want.rounds > 1:
                number = np.flatnonzero((h & np.uint64(0xFFFFFFFF)) * np.uint64(want.rounds) >> np.uint64(32) == want.round)
                h = h[number]
            batch, told = rows(keys, places, counts, number, h, prints.second(data, at[number], want.width) if want.decide else None, seq, told)
            return batch

        for batch in batches:
            for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                text, before = text.as_py() or b"", 0
                for place in range(0, max(len(text) - want.width + 1, 1), SLICE):
                    mine = want.positions(len(text), marks, place, place + SLICE)
                    if not len(mine):
                        continue
                    part = text[place : place + SLICE + want.width - 1]
                    if texts and size + len(part) > SLICE:
                        yield flush()
                        keys, places, counts, texts, where, size, seq = [], [], [], [], [], 0, seq + 1
                    keys.append(key)
                    places.append(before)
                    counts.append(len(mine))
                    where.append(mine - place + size)
                    texts.append(part)
                    size += len(part)
                    before += len(mine)
        if texts:
            yield flush()

    return run


def _order_bucket(group: pa.Table, decide: bool) -> pa.Table:
    """Sorts one bucket's fingerprints; the numbers of those that another slice has too go back."""
    numbers, prints = group.column("numbers").to_pylist(), group.column("prints").to_pylist()
    sizes = [len(p) // (12 if decide else 8) for p in prints]
    h = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(prints, sizes, strict=True)])
    g = np.concatenate([np.frombuffer(p, np.uint32, n, 8 * n) for p, n in zip(prints, sizes, strict=True)]) if decide else None
    order, same = _sorted_equals(h, g)
    again = np.zeros(len(h), bool)
    again[order] = same | np.append(same[1:], False)[: len(h)]
    ends = np.cumsum(sizes)
    back = [pack(unpack(x)[again[e - n : e]]) for x, n, e in zip(numbers, sizes, ends, strict=True)]
    return pa.table({"origin": group.column("origin"), "numbers": pa.array(back, pa.binary()), "prints": pa.nulls(len(group), pa.binary())})


def _give_back(group: pa.Table) -> pa.Table:
    """One slice: the repeated numbers of each of its texts."""
    prints = group.column("prints").to_pylist()
    packed = [unpack(x) for x in group.column("numbers").to_pylist()]
    directory = next(p for p in prints if p is not None)
    n = int(np.frombuffer(directory, np.int64, 1)[0])
    places, counts = np.frombuffer(directory, np.int64, 2 * n, 8).reshape(2, n)
    keys = directory[8 * (2 * n + 1) :]
    numbers = np.unique(np.concatenate(packed))
    ends = np.cumsum(counts)
    edges = np.searchsorted(numbers, np.append(0, ends))
    out = [(keys[KEY * i : KEY * (i + 1)], pack(numbers[edges[i] : edges[i + 1]] - (ends[i] - counts[i]) + places[i])) for i in range(n) if edges[i + 1] > edges[i]]
    return pa.table({"key": pa.array([k for k, _ in out], pa.binary()), "numbers": pa.array([x for _, x in out], pa.binary())})


def _together(packed: list[bytes]) -> bytes:
    return packed[0] if len(packed) == 1 else pack(np.unique(np.concatenate([unpack(x) for x in packed])))


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([_together(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["key", "marks"])


def repeated(texts: DataFrame, want: Suffixes, buckets: int) -> DataFrame:
    """(key, numbers): of texts (key, text, marks), the numbers of the suffixes that another one agrees with in want.width bytes."""
    sent = texts.select("key", "text", "marks").mapInArrow(tidy(_send(want, buckets)), SENT)

    def order(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            return group.select(["origin", "numbers", "prints"])
        return _order_bucket(group, want.decide)

    ordered = sent.groupBy("bucket").applyInArrow(order, "origin long, numbers binary, prints binary")
    return ordered.groupBy("origin").applyInArrow(_give_back, "key binary, numbers binary")


def merged(found: DataFrame) -> DataFrame:
    """(key, marks): all numbers of a text in one; they take no more room than the text."""
    return found.groupBy("key").agg(F.collect_list("numbers").alias("lists")).select("key", "lists").mapInArrow(_merge_lists, "key binary, marks binary")


# ---------------------------------------------------------------- removal

RESULT = "key binary, n_removed long, n_spans long, kept_sha256 string"


def runs(starts: np.ndarray) -> np.ndarray:
    """Maximal runs (begin, end) that SPAN bytes from each of the rising starts cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    apart = np.flatnonzero(np.diff(starts) > SPAN)
    return np.stack([starts[np.append(0, apart + 1)], starts[np.append(apart, len(starts) - 1)] + SPAN], axis=1)


def removed_runs(n: int, marks: bytes | None, found: bytes | None) -> np.ndarray:
    """The runs of a text of n bytes that go; found: the numbers, among its open suffixes, of those that are repeated."""
    if not found:
        return runs(np.zeros(0, np.int64))
    numbers, before, starts = unpack(found), 0, []
    for place in range(0, n, SLICE):  # a stretch of positions at a time
        mine = open_positions(n, marks, place, place + SLICE)
        a, b = np.searchsorted(numbers, (before, before + len(mine)))
        starts.append(mine[numbers[a:b] - before])
        before += len(mine)
    return runs(np.concatenate(starts))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, marks, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            gone = removed_runs(len(text), marks, found)
            digest, at = hashlib.sha256(), 0
            for a, b in gone.tolist():
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((key, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n_removed", "n_spans", "kept_sha256"])


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts, at = [], 0
            for a, b in removed_runs(len(text), marks, found).tolist():
                parts.append(text[at:a])
                at = b
            out.append(b"".join([*parts, text[at:]]))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["key", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: key is a digest of KEY bytes of the id and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.md5(text.cast("binary")), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit("")))
    return docs.select("doc_id", F.unhex(F.md5(named.cast("binary"))).alias("key"), text.alias("text"))


def _found(docs: DataFrame) -> DataFrame:
    """key, text, marks, found of the texts in which something is repeated."""
    texts = _keyed(docs)
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)
    plain = texts.select("key", "text", F.lit(None).cast("binary").alias("marks"))
    marks = cut(merged(repeated(plain, Suffixes(SAMPLE, cover_positions), buckets)))
    # Equal rows have one key; one of them stands for all, with its number of rows told by the cover already.
    open_texts = cut(texts.select("key", "text").join(marks, "key"))
    passes = [cut(repeated(open_texts, Suffixes(SPAN, open_positions, True, k, ROUNDS), buckets)) for k in range(ROUNDS)]
    found = cut(merged(reduce(DataFrame.unionByName, passes)))
    return open_texts.join(found.withColumnRenamed("marks", "found"), "key").select("key", "text", "marks", "found")


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs (doc_id, text).

    A byte goes if a string of SPAN bytes covers it that also starts anywhere else in any text, in the same one too, overlaps
    included; strings are judged on the input and never cross texts. Null text is empty. Rows that repeat a doc_id are texts of
    their own; equal ones repeat each other. An empty table gives an empty one. Other columns are not read.
    """
    results = cut(_found(docs).mapInArrow(tidy(_remove), RESULT).dropDuplicates(["key"]))
    whole = _keyed(docs).select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    rows = whole.join(results, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary): what removal leaves of each text, as bytes; cuts may fall inside a character."""
    results = cut(_found(docs).mapInArrow(tidy(_kept_text), "key binary, kept binary").dropDuplicates(["key"]))
    return _keyed(docs).join(results, "key", "left").select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))
