"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are at cosine c or more if their distance is at most sqrt(2 - 2c). They are sorted by their cells, of that side, on
the leading principal axes, and cut into blocks of consecutive rows with bounding boxes. Intervals of the sequence are joined
from large to small: a pair of intervals is opened only if its boxes are within reach, down to blocks and, inside a pair of
blocks, to short runs, whose cosines are computed in double precision. Equal vectors are one node with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_lookup, tidy
from .components import components
from .simhash import forest

COSINE = 0.95
#: Principal axes of the grid, and the bound of the sample they are fitted on.
AXES, SAMPLE = 8, 4096
#: Blocks that few vectors make; the least rows of a block, and the most: twice this many vectors are held at once, four times over.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 6, 512, 1 << 15
#: Rows of a run inside a block, intervals that one larger interval holds, and blocks that one task compares with its own.
RUN, FAN_BITS, PARTNERS = 256, 4, 3


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each vector as doubles, scaled by a power of two to a largest component below 1, so that no norm overflows or
    vanishes; null where there is no cosine."""
    for batch in batches:
        out = []
        for x in batch.column(1):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid else np.zeros(0)  # a null component is NaN
            fine = len(v) and np.isfinite(v).all() and v.any()
            out.append(np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes() if fine else None)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])


def _units(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(vectors: list[bytes]) -> bytes:
    """Vectors in a row, in single precision if they are exact in it."""
    x = np.frombuffer(b"".join(vectors), np.float64)
    short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def _unpacked(packed: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(packed, np.float32 if len(packed) == 4 * n * dims else np.float64).astype(np.float64).reshape(n, dims)


def principal_axes(nodes: DataFrame, n: int) -> np.ndarray:
    """The leading axes of a sample of at most about SAMPLE vectors of the most common length, picked by hash: length x AXES."""
    share = min(1.0, SAMPLE / max(1, n))
    draw = F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) / float(1 << 20)
    common = nodes.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    rows = nodes.where((draw < share) & (F.col("dims") == common.dims)).select("vector").collect()
    if not rows:
        return np.eye(common.dims)[:, :AXES]
    x = _units(sorted(bytes(r.vector) for r in rows))
    _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and common.dims > 1 else np.eye(common.dims))
    return axes[:, ::-1][:, :AXES]


def _project(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on orthonormal axes; vectors of another length keep their own first ones."""
    out = np.zeros((len(units), AXES))
    got = units @ axes if units.shape[1] == axes.shape[0] else units[:, :AXES]
    out[:, : got.shape[1]] = got
    return out


def _cells(axes: np.ndarray, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            keys: list = [None] * len(vectors)
            for dims in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dims]
                cells = np.floor(_project(_units([vectors[i] for i in at]), axes) / reach).astype(np.int64)
                for i, c in zip(at, (np.clip(cells, -(1 << 30), 1 << 30) + (1 << 31)).astype(">u4"), strict=True):
                    keys[i] = c.tobytes()
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "cells"])

    return run


BOX = [f"lo{k}" for k in range(AXES)] + [f"hi{k}" for k in range(AXES)]


def _cut_blocks(axes: np.ndarray, most: int):
    """Blocks of consecutive rows of a sorted partition, each of one vector length."""

    def block(rows: list[tuple], at: int) -> pa.RecordBatch:
        node, vector, copies = zip(*rows, strict=True)
        box = _project(_units(list(vector)), axes)
        where = TaskContext.get().partitionId()
        columns = [pa.array([(where << 24) + at]), pa.array([len(vector[0]) // 8], pa.int32()), pa.array([list(node)], pa.list_(pa.int64())), pa.array([list(copies)], pa.list_(pa.int64())), pa.array([_packed(list(vector))], pa.binary())]
        columns += [pa.array([x]) for x in (*box.min(axis=0), *box.max(axis=0))]
        return pa.record_batch(columns, names=["block", "dims", "node", "copies", "vectors", *BOX])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (len(held) == most or len(row[1]) != len(held[0][1])):
                    yield block(held, at)
                    held, at = [], at + 1
                held.append(row)
        if held:
            yield block(held, at)

    return run


def _join_blocks(group: pa.Table) -> pa.Table:
    """Neighbouring blocks as one."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    whole = np.concatenate([_unpacked(r["vectors"], len(r["node"]), r["dims"]) for r in rows])
    box = [(min if c[0] == "l" else max)(r[c] for r in rows) for c in BOX]
    columns = [pa.array([rows[0]["at"]], pa.int64()), pa.array([rows[0]["dims"]], pa.int32()), *(pa.array([[x for r in rows for x in r[c]]], pa.list_(pa.int64())) for c in ("node", "copies")), pa.array([_packed([whole.tobytes()])], pa.binary())]
    return pa.table([*columns, *(pa.array([x]) for x in box)], names=["block", "dims", "node", "copies", "vectors", *BOX])


BLOCK = "block long, dims int, node array<long>, copies array<long>, vectors binary, " + ", ".join(f"{c} double" for c in BOX)


def _blocks(placed: DataFrame, axes: np.ndarray, most: int) -> DataFrame:
    """The sorted rows in blocks of ``most`` to twice as many, whatever the partitions; blocks of one length are numbered in a row."""
    cuts = cut(placed.mapInArrow(_cut_blocks(axes, most), BLOCK))
    # One row a block, without its vectors.
    before = Window.partitionBy("dims").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cuts.select("block", "dims", F.size("node").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.shiftleft(F.col("dims").cast("long"), 32) + F.floor(F.col("before") / most)
    return cut(cuts.join(sizes.select("block", number.alias("at")), "block").groupBy("at").applyInArrow(_join_blocks, BLOCK))


def _block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(a, b), a <= b: the blocks whose boxes are within reach, by joining intervals of the sequence from large to small."""
    boxes = blocks.select("block", "dims", *BOX)

    def level(k: int) -> DataFrame:
        return boxes.groupBy("dims", F.shiftright("block", FAN_BITS * k).alias("id")).agg(*(F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in BOX))

    def side(of: DataFrame, s: str) -> DataFrame:
        return of.select(F.col("id").alias(s), F.shiftright("id", FAN_BITS).alias(f"up_{s}"), F.col("dims").alias(f"dims_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in BOX))

    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}_a") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}_a")), 2) for k in range(AXES)), F.lit(0.0))
    near = (F.col("dims_a") == F.col("dims_b")) & (gap <= reach * reach) & (F.col("a") <= F.col("b"))
    top = 0
    while (level(top).groupBy("dims").count().agg(F.max("count")).first()[0] or 0) > 1 << FAN_BITS:
        top += 1
    pairs = side(level(top), "a").join(side(level(top), "b"), near).select("a", "b", "dims_a")
    for k in range(top - 1, -1, -1):
        up = pairs.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("dims_a").alias("dims"))
        opened = up.join(side(level(k), "a"), "up_a").where(F.col("dims") == F.col("dims_a")).join(side(level(k), "b"), "up_b").where(near)
        pairs = cut(opened.select("a", "b", "dims_a"))
    return pairs.select("a", "b")


FOUND = "node long, other long, n long"


def _compare(axes: np.ndarray, reach: float, cosine: float):
    """Batches of (block, own, ...): for each block its own row first (own is 2, or 1 if it isn't to be compared with itself here), then
    some of those that it is near to (own is 0). Rows (node, null, n) count links, (node, other, 0) join."""

    class Side:
        def __init__(self, node: list, copies: list, vectors: bytes, dims: int) -> None:
            self.node, self.copies = np.array(node), np.array(copies)
            x = _unpacked(vectors, len(node), dims)
            self.unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            self.at = _project(self.unit, axes)

        def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            return self.at[lo:hi].min(axis=0), self.at[lo:hi].max(axis=0)

    def join(a: Side, b: Side, ra: tuple[int, int], rb: tuple[int, int], hits: list) -> None:
        """Intervals ra of a and rb of b: skipped if out of reach, halved while long, else compared."""
        (la, ha), (lb, hb) = a.box(*ra), b.box(*rb)
        gap = np.maximum(0, np.maximum(la - hb, lb - ha))
        if gap @ gap > reach * reach:
            return
        na, nb = ra[1] - ra[0], rb[1] - rb[0]
        if max(na, nb) > RUN:
            long_a = na >= nb
            mid = (ra[0] + ra[1]) // 2 if long_a else (rb[0] + rb[1]) // 2
            for lo in (0, 1):
                half = lambda r, lo=lo, mid=mid: (mid, r[1]) if lo else (r[0], mid)
                join(a, b, half(ra) if long_a else ra, rb if long_a else half(rb), hits)
            return
        i, j = np.nonzero(a.unit[ra[0] : ra[1]] @ b.unit[rb[0] : rb[1]].T >= cosine)
        if len(i):
            hits.append((i + ra[0], j + rb[0]))

    def out(a: Side, b: Side) -> Iterator[pa.RecordBatch]:
        hits: list = []
        join(a, b, (0, len(a.node)), (0, len(b.node)), hits)
        if not hits:
            return
        i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
        if a is b:
            i, j = i[i != j], j[i != j]
            if not len(i):
                return
        rows = [(a.node, np.bincount(i, b.copies[j], len(a.node)))]
        if a is not b:
            rows.append((b.node, np.bincount(j, a.copies[i], len(b.node))))
        node, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        seen = n > 0
        # The components among the rows that have a link, as trees.
        ua, ub = np.unique(i), np.unique(j)
        adjacent = np.zeros((len(ua) + len(ub),) * 2, bool)
        p, q = np.searchsorted(ua, i), np.searchsorted(ub, j) + len(ua)
        adjacent[p, q] = adjacent[q, p] = True
        if a is b:  # a row stands on both sides
            twice = np.searchsorted(ub, ua) + len(ua)
            adjacent[np.arange(len(ua)), twice] = adjacent[twice, np.arange(len(ua))] = True
        tree = forest(adjacent, np.concatenate([a.node[ua], b.node[ub]]))
        yield pa.record_batch([
            pa.array(np.concatenate([node[seen], np.array([x for x, _ in tree], np.int64)])),
            pa.array([None] * int(seen.sum()) + [y for _, y in tree], pa.int64()),
            pa.array(np.concatenate([n[seen].astype(np.int64), np.zeros(len(tree), np.int64)])),
        ], names=["node", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, a = None, None
        for batch in batches:
            for k in range(len(batch)):
                of, own, dims, node, copies, vectors = (batch.column(i)[k].as_py() for i in range(6))
                side = Side(node, copies, vectors, dims)
                if own:
                    mine, a = of, side
                assert mine == of
                if own != 1:
                    yield from out(a, side if not own else a)

    return run


def similar_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding: array of numbers).

    n_links counts the other rows at the cosine or more; component_id is the smallest vec_id that links reach, and kept is
    vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even
    with equal ones; vectors of different lengths do not link. Rows that repeat a vec_id are vectors of their own, that share
    the component of that id if they are equal or link. Null ids: such a row counts as a vector, and its own component is
    null or its group's. An empty table gives an empty one. Other columns are not read.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9)
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(tidy(_vectors), "vec_id long, vector binary"))
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    groups = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # A group that has no id at all is given one that no row has.
    nodes = cut(groups.select(F.coalesce("node", -F.pmod(F.xxhash64("vector"), F.lit(1 << 62)) - (1 << 62)).alias("node"), "vector", "copies", F.expr("octet_length(vector) div 8").alias("dims")))
    n = nodes.count()
    if not n:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    axes = principal_axes(nodes, n)
    keyed = nodes.select("node", "vector", "copies").mapInArrow(_cells(axes, reach), "node long, vector binary, copies long, cells binary")
    keyed = cut(keyed)
    placed = keyed.withColumn("dims", F.octet_length("vector")).orderBy("dims", "cells", "node").select("node", "vector", "copies")
    blocks = _blocks(placed, axes, min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS))))
    pairs = cut(_block_pairs(blocks, reach))
    # A block that is near to many is sent to several tasks, each with a few of them.
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("tasks"))
    own, task = F.col("a") == F.col("b"), F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int")
    dealt = pairs.join(tasks, "a").withColumn("task", F.explode(F.when(own, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(task))))
    data = blocks.select(F.col("block").alias("b"), "dims", "node", "copies", "vectors")
    met = dealt.join(data, "b").select("a", "task", F.when(own, F.when(F.col("task") == 0, 2).otherwise(1)).otherwise(0).alias("own"), "dims", "node", "copies", "vectors")
    met = met.repartition("a", "task").sortWithinPartitions("a", "task", F.desc("own")).drop("task")
    found = cut(met.mapInArrow(tidy(_compare(axes, reach, cosine)), FOUND))
    linked = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    facts = nodes.join(linked, "node", "left").join(labels, "node", "left")
    facts = facts.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    known = salted_lookup(rows.where("vector is not null"), facts, "vector", F.col("vec_id"), max(64, n >> 16))
    both = known.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
