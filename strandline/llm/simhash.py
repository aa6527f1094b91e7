"""Near-duplicates by SimHash, searched with the generalised pigeonhole principle.

A pair of fingerprints that differ in at most ``radius`` bits must, for any split of the bits into parts with thresholds t_i
that sum to radius - parts + 1, differ in at most t_i bits of some part. Correlated bits share a part, so that the parts are
as different from each other as can be; the thresholds are dealt by dynamic programming on candidate counts taken from all
fingerprints. Every candidate is verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_lookup, slices, tidy, utf8
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Text is cut into words in stretches of this many bytes.
STRETCH = 1 << 20
#: Buckets up to this size are joined pair by pair; larger ones are refined, and what stays larger is compared in blocks.
PAIRWISE = 64
BLOCK = 512
#: Cost of a row of signatures against that of a candidate to verify, for the dynamic programme.
SIGNATURE_COST = 4.0
ALL = (1 << 64) - 1


def _word_stretches(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    rows = np.zeros((-(-len(hashes) // 255) * 255, 8), np.uint8)
    rows[: len(hashes)] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    # Sums of 255 bits fit a byte.
    return np.unpackbits(rows, axis=1).reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """The fingerprint of a lower-cased text."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in _word_stretches(text):
        words = tail + words
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False)), np.uint64)
        tail, n = words[-(SHINGLE - 1) :], n + len(hashes)
        counts += bit_counts(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return majority(counts, n)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values = np.array([fingerprint(x.lower()) for x in utf8(part.column(1))], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_fingerprint_batches), "doc_id long, fp long")


# ---------------------------------------------------------------- parts and thresholds


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together, one row for each partition."""
    total = np.zeros((64, 64))
    n = 0
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 1 << 16):
            bits = np.unpackbits(values[at : at + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
    if n:
        yield pa.record_batch([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["cell", "total"])


def correlations(fps: DataFrame) -> np.ndarray:
    """The absolute correlation of each pair of bits over all fps; 4097 sums come to the driver, whatever the input."""
    rows = fps.select("fp").mapInArrow(_moments, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    if not rows:
        return np.zeros((64, 64))
    flat = np.zeros(4097)
    for r in rows:
        flat[r.cell] = r.total
    both, n = flat[:4096].reshape(64, 64) / flat[4096], flat[4096]
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1 / (4 * n)))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[int]:
    """Masks of bits: each part starts at the bit with most correlation left and takes the bits closest to it."""
    left, masks = list(range(64)), []
    for k in range(parts, 0, -1):
        first = max(left, key=lambda i: (correlation[i, left].sum(), -i))
        group = [first]
        left.remove(first)
        for _ in range(-(-(len(left) + 1) // k) - 1):
            near = max(left, key=lambda i: (correlation[i, group].sum(), -i))
            group.append(near)
            left.remove(near)
        masks.append(sum(1 << i for i in group))
    return masks


def deal_thresholds(widths: list[int], equal_pairs: list[float], n: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """The cheapest thresholds, of -1 (part unused) to radius, with sum(t + 1) = radius + 1, by dynamic programming.

    equal_pairs: for each part, the pairs of fingerprints that agree in it; within t bits there are estimated to be as many
    times more as the ball of radius t has points, at most all pairs.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, pairs in zip(widths, equal_pairs, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                more = 0.0 if t < 0 else SIGNATURE_COST * n * ball + min(max(pairs, n * n / 2.0**width) * ball, n * n / 2)
                if used + t + 1 not in step or cost + more < step[used + t + 1][0]:
                    step[used + t + 1] = (cost + more, [*chosen, t])
        best = step
    return best[radius + 1]


def plan_parts(fps: DataFrame, n: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts to search; the number of parts is the cheapest too."""
    correlation = correlations(fps)
    splits = [group_bits(correlation, m) for m in (2, 3, 4)]
    masks = [x for split in splits for x in split]
    keys = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("value")) for i, x in enumerate(masks)))).alias("x")).select("x.*")
    counted = keys.groupBy("part", "value").agg(F.count("*").cast("double").alias("n")).where("n > 1")
    pairs = {r.part: r.pairs for r in counted.groupBy("part").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    options, at = [], 0
    for split in splits:
        cost, chosen = deal_thresholds([x.bit_count() for x in split], [pairs.get(at + i, 0.0) for i in range(len(split))], n)
        options.append((cost, [(x, t) for x, t in zip(split, chosen, strict=True) if t >= 0]))
        at += len(split)
    return min(options, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- probe and verify


def _signatures(mask: int, threshold: int, part: int) -> Column:
    """An array of (key, own): the part's bits, and these with up to threshold of them flipped."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    flips = [sum(x) for k in range(threshold + 1) for x in combinations(bits, k)]
    value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    return F.transform(F.array(*(F.lit(_signed(x)) for x in flips)), lambda f: F.struct(F.xxhash64(F.lit(part), value.bitwiseXOR(f)).alias("key"), (f == 0).alias("own")))


def _counted(rows: DataFrame, n: int) -> DataFrame:
    """rows whose key others have too, with ``together``, the number of rows of the key."""
    salts = max(64, n >> 16)
    sizes = rows.groupBy("key").agg(F.count("*").alias("together"), F.max("own").alias("any_own")).where("together > 1 and any_own").drop("any_own")
    return salted_lookup(rows, sizes, "key", F.col("node"), salts)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _pairs(rows: DataFrame) -> DataFrame:
    one = rows.where("own").select("key", F.col("node").alias("a"), F.col("fp").alias("fa"))
    two = rows.select("key", F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("own").alias("own_b"))
    hit = (one["key"] == two["key"]) & (F.col("a") != F.col("b")) & (~F.col("own_b") | (F.col("a") < F.col("b"))) & _near("fa", "fb")
    return one.join(two, hit).select("a", "b")


def forest(adjacent: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Few links with the same components as adjacent has: each component's ids as a binary tree, so no id has many links."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if not left[i]:
            continue
        reached = adjacent[i].copy()
        reached[i] = True
        edge = reached & left
        left[edge] = False
        while True:
            edge[i] = False
            fresh = adjacent[edge].any(axis=0) & left if edge.any() else np.zeros(len(ids), bool)
            if not fresh.any():
                break
            left[fresh] = False
            reached |= fresh
            edge = fresh
        members = np.unique(ids[reached]).tolist()
        out += [(members[(k - 1) // 2], members[k]) for k in range(1, len(members))]
    return out


def _block_links(group: pa.Table) -> pa.Table:
    fp = group.column("fp").to_numpy().view(np.uint64)
    ids = group.column("node").to_numpy()
    adjacent = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS
    links = forest(adjacent, ids)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _blocks(rows: DataFrame) -> DataFrame:
    """Links in buckets of any size: the rows of a bucket in blocks, each pair of blocks compared once, in one small task."""
    parts = F.ceil(F.col("together") / BLOCK).cast("int")
    rows = rows.withColumn("of", parts).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "fp")
    return rows.groupBy("key", "lo", "hi").applyInArrow(_block_links, "a long, b long")


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b) of fps (node, fp; distinct): links with the same components as all pairs within RADIUS bits have."""
    parts = plan_parts(fps, n)
    signed = fps.withColumn("x", F.explode(F.concat(*(_signatures(x, t, i) for i, (x, t) in enumerate(parts))))).select("node", "fp", "x.key", "x.own")
    shared = cut(_counted(signed, n))
    found = _pairs(shared.where(F.col("together") <= PAIRWISE))
    large = shared.where(F.col("together") > PAIRWISE)
    if large.isEmpty():
        return found
    # What agrees in one part and differs in at most RADIUS bits agrees in one of RADIUS + 1 shares of the bits.
    fine = [sum(1 << i for i in range(64) if i % (RADIUS + 1) == k) for k in range(RADIUS + 1)]
    keys = F.array(*(F.xxhash64(F.col("key"), F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(x)))) for k, x in enumerate(fine)))
    again = cut(_counted(large.drop("together").withColumn("key", F.explode(keys)), n))
    return found.unionByName(_pairs(again.where(F.col("together") <= PAIRWISE))).unionByName(_blocks(again.where(F.col("together") > PAIRWISE)))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs (doc_id, text).

    Texts are whole and lower-cased in A-Z; null is empty. A text of one or two words is one shingle, one of none has
    fingerprint zero and links like any other. Fingerprints within 3 bits link; component_id is the smallest doc_id reachable.
    Equal fingerprints, of any number of rows, are one node. Rows that repeat a doc_id are kept. Null ids join no group but
    their own row's: they are given the component of their fingerprint if another row has it, else null. An empty table gives
    an empty one. Other columns are not read.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    n = nodes.count()
    found = components(links(nodes, n)) if n > 1 else nodes.select(F.col("node").alias("id"), F.col("node").alias("component_id")).limit(0)
    labelled = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    known = salted_lookup(prints.where("doc_id is not null"), labelled, "fp", F.col("doc_id"), max(64, n >> 16))
    unknown = prints.where("doc_id is null").join(labelled, "fp", "left")
    both = known.select("doc_id", "fp", "component_id").unionByName(unknown.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
