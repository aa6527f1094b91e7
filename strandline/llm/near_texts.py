"""The near-duplicate stage: texts of Jaccard similarity 0.8 or more on five-word shingles, by SimHash first, then what it leaves.

SimHash (the operator's generalised pigeonhole search, on fingerprints of these shingles) finds groups of nearly equal texts; each is
compared with another of its group, on the whole shingle sets. But a pair of similarity 0.8 differs in ten bits of 64 on average, and a
search within as many would compare a large share of all pairs. So MinHash bands propose the rest: a pair of similarity s shares
no band with probability (1 - s ** ROWS) ** BANDS, 5e-8 at 0.8. Every pair that shares a band is decided on its whole sets or is
inside one component already: first each text is compared with one text of each of its bands, then what is still in different
components of a band. So a large group of copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, salted_lookup, slices, tidy, utf8
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Shingles are hashed for all bands in stretches of this many.
STRETCH = 1 << 12
#: Texts of a group in one block; a task compares two blocks.
BLOCK = 1024
SALTS = 64

_rng = np.random.default_rng(7)
TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, in lower case A-Z; fewer words are one shingle, no word is none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x)) for x in zip(*(found[k:] for k in range(words)), strict=False)), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), STRETCH):
        least = np.minimum(least, (TIMES[:, None] * hashes[None, at : at + STRETCH] + PLUS[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(x, words) for x in utf8(part.column(1))]
                keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
                prints = np.array([simhash.majority(simhash.bit_counts(x), len(x)) for x in sets], np.uint64)
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints.view(np.int64)), keys], names=["sha", "n", "fp", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array([shingles(x, words).tobytes() for x in utf8(part.column(1))], pa.binary())], names=["node", "hashes"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sizes_fit(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) + 1e-9 >= F.greatest(n, m) * similarity


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A text may be in any part of the pairs."""
    rows = salted_lookup(pairs, sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a", F.col("b"), SALTS)
    rows = salted_lookup(rows, sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b", F.col("a"), SALTS)
    return rows.select("a", "b", "x", "y").mapInArrow(tidy(_alike(similarity)), "a long, b long")


def _group_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): the links of SimHash, and each text with the first one of its fingerprint."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("texts")))
    count = prints.count()
    equal = salted_lookup(nodes.select("node", "fp"), prints.where("texts > 1").select("fp", "first"), "fp", F.col("node"), SALTS)
    pairs = equal.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(simhash.links(prints.select(F.col("first").alias("node"), "fp"), count)) if count > 1 else pairs


def _block_links(similarity: float):
    """Links between the texts of two blocks of a group (or of one): of pairs that share a band, whose components differ and whose
    sets are similar, one for each text and component."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        group = group.sort_by("node")
        node, of, n, mine = (group.column(c).to_numpy() for c in ("node", "of", "n", "mine"))
        keys = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(group), -1)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        left, out = np.flatnonzero(mine == lo), []
        for j in np.flatnonzero(mine == hi).tolist():
            fit = (of[left] != of[j]) & (np.minimum(n[left], n[j]) + 1e-9 >= np.maximum(n[left], n[j]) * similarity)
            near = left[fit & (left < j if lo == hi else True)]
            near = near[(keys[near] == keys[j]).any(axis=1)]
            if not len(near):
                continue
            both = np.zeros(len(near), np.int64)
            if n[j]:
                flat = np.concatenate([sets[i] for i in near.tolist()])
                at = np.minimum(np.searchsorted(sets[j], flat), len(sets[j]) - 1)
                both = np.add.reduceat(sets[j][at] == flat, np.cumsum(n[near]) - n[near], dtype=np.int64)
            good = near[both + 1e-9 >= similarity * (n[near] + n[j] - both)]
            out += [(int(node[i]), int(node[j])) for i in good[np.unique(of[good], return_index=True)[1]].tolist()]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _open_links(shared: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts that share a band (shared: key, node) and are in different components, all pairs of them.

    Bands with texts of several components tie texts to groups. A group's texts go out in blocks, each pair of blocks to one task,
    with their sets: a set is sent once for each block that its text meets, not for each pair or band.
    """
    of = labels.withColumnRenamed("id", "node")
    rows = cut(shared.select("key", "node").join(of, "node", "left").select("key", "node", F.coalesce("component_id", "node").alias("of")))
    several = rows.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.min("node").alias("first")).where("lo <> hi").select("key", "first")
    rows = cut(salted_lookup(rows, several, "key", F.col("node"), SALTS).select("node", "of", "first"))
    groups = components(rows.select(F.col("node").alias("a"), F.col("first").alias("b")))
    groups = groups.select(F.col("id").alias("node"), F.col("component_id").alias("of_all"))
    members = groups.join(rows.select("node", "of").distinct(), "node")
    sizes = members.groupBy("of_all").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = salted_lookup(members, sizes, "of_all", F.col("node"), SALTS).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(nodes.select("node", "n", "bands"), "node").join(sets, "node")
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("of_all", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "of", "n", "bands", "hashes")
    return members.groupBy("of_all", "lo", "hi").applyInArrow(_block_links(similarity), "a long, b long")


def drop_similar(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) with one row of each group of texts that similarity links, that with the smallest doc_id.

    Two texts link if the sets of their shingles of ``words`` words have at least this Jaccard similarity. Texts are whole and
    lower-cased in A-Z; null is empty, and texts without a word are equal. A null doc_id is the largest. Rows that repeat a
    doc_id are rows of their own, of equal rows one stays. All columns stay. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__row"), F.sha2(text.cast("binary"), 256).alias("sha"))
    sketches = docs.select(F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text")).mapInArrow(tidy(_sketches(words)), "sha string, n long, fp long, bands array<long>")
    nodes = sketches.groupBy("sha").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Most bands are one text's alone: what is shared is found by the keys only, then the rows of those keys.
    twice = cut(keys.groupBy("key").agg(F.count("*").alias("together")).where("together > 1").select("key"))
    mine = cut(salted_lookup(keys, twice, "key", F.col("node"), SALTS))
    leaders = mine.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node", "n")).alias("first"))
    shared = cut(salted_lookup(mine, leaders.select("key", "first.node", "first.n").toDF("key", "first", "m"), "key", F.col("node"), SALTS))
    # Texts of one SimHash group that share no band are less alike than 0.8 but for that probability; those that do are suspects.
    suspects = shared.select("node").distinct().join(nodes.select("node", "sha"), "node").unionByName(nodes.where("rows > 1").select("node", "sha")).distinct()

    salt = F.pmod(F.xxhash64("__row.doc_id"), F.lit(16)).cast("int")
    salted = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    placed = cut(rows.withColumn("salt", salt).join(salted, ["sha", "salt"], "left").select("__row", "sha", "node"))
    alone, some = placed.where("node is null"), placed.where("node is not null")
    texts = some.groupBy("node").agg(F.first(F.coalesce(F.col("__row.text").cast("string"), F.lit(""))).alias("text"))
    sets = cut(texts.select("node", "text").mapInArrow(tidy(_sets(words)), "node long, hashes binary"))

    # The same texts lead most bands of a group of copies, so that there are few different pairs.
    fit = _sizes_fit(F.col("n"), F.col("m"), similarity) & (F.col("node") != F.col("first"))
    led = shared.where(fit).select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    proposed = _group_pairs(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(led).distinct()
    links = cut(_verified(cut(proposed), sets, similarity))
    labels = components(links)
    more = cut(_open_links(shared, nodes, sets, labels, similarity))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    some = salted_lookup(some, suspects.select("node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component_id", "node").alias("of")), "node", F.col("__row.doc_id"), SALTS)
    order = F.struct(F.col("__row.doc_id").isNull(), F.col("__row.doc_id"), F.col("sha"), F.xxhash64(F.to_json("__row")))
    kept = some.groupBy("of").agg(F.min_by("__row", order).alias("__row"))
    return alone.select("__row.*").unionByName(kept.select("__row.*"))
