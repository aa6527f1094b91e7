"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one inserts each text's hash into a filter of ``cells`` bits with two hash functions and keeps, as bitmaps, the cells that
were hit more than once. No row shuffles for that: a task sends the numbers of its cells, four bytes each, packed by stretch of
the filter. Pass two probes: a text whose two cells were not both hit again is certainly alone and passes straight through, only
the others shuffle. False positives cost a shuffled row and change no result. The filter has a bound, so more texts than fill one
filter go in rounds, each of the texts of one range of hashes with a filter of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Bits of one bitmap row, as bitmap_construct_agg makes them, and cells whose numbers go together.
BITMAP, STRETCH = 32768, 1 << 20
#: log2 of the most cells for each hash function: two times 16 MB, the proven bound of what is broadcast at once.
MOST_LOG2 = 27
#: A salted group gets about this many rows at most.
ROWS_PER_SALT = 1 << 16


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
    )


def _cell(which: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256", F.lit(which)), F.lit(cells)) + F.lit(which * cells)


def _bucket(cell: Column) -> Column:
    return F.floor(cell / BITMAP)


def repeated_cells(digests: DataFrame, cells: int) -> DataFrame:
    """(bucket, bits): the cells hit more than once, 4 KB of bits a row, at most 2 * cells / 32768 rows."""
    hits = digests.select(F.explode(F.array(_cell(0, cells), _cell(1, cells))).alias("cell"))
    hits = hits.select(F.floor(F.col("cell") / STRETCH).cast("int").alias("stretch"), (F.col("cell") % STRETCH).cast("int").alias("at"))
    packed = hits.groupBy("stretch").agg(F.sort_array(F.collect_list("at")).alias("at"))
    again = packed.select("stretch", F.explode(F.filter("at", lambda x, i: (i > 0) & (x == F.get(F.col("at"), i - 1)))).alias("at"))
    cell = F.col("stretch").cast("long") * STRETCH + F.col("at")
    return again.groupBy(_bucket(cell).alias("bucket")).agg(F.bitmap_construct_agg(cell % BITMAP).alias("bits"))


def may_repeat(rows: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """rows (with text_sha256) plus ``__again``: false for a hash that certainly occurs once."""
    again = F.lit(True)
    for which in (0, 1):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__bucket{which}"), F.col("bits").alias(f"__bits{which}")))
        rows = rows.withColumn(f"__bucket{which}", _bucket(_cell(which, cells))).join(side, f"__bucket{which}", "left")
        at = _cell(which, cells) % BITMAP
        byte = F.conv(F.hex(F.substring(F.col(f"__bits{which}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        again = again & (F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1)
    return rows.withColumn("__again", again).drop("__bucket0", "__bits0", "__bucket1", "__bits1")


def _filter_size(n: int, bits_per_row: int) -> tuple[int, int]:
    """Rounds, and the cells of each round's filter."""
    rounds = max(1, -(-n * bits_per_row // (1 << MOST_LOG2)))
    return rounds, 1 << min(MOST_LOG2, max(15, (max(n // rounds, 1) * bits_per_row - 1).bit_length()))


def _verdicts(again: DataFrame, n: int) -> DataFrame:
    """The verdict on each row of again, by its hash. Groups are pre-aggregated by salt, so no group meets in one task."""
    salts = max(64, n // ROWS_PER_SALT)
    again = again.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    best = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("doc_id").alias("keep_id")))
    part = again.groupBy("text_sha256", "__salt").agg(best.alias("best"), F.count("*").alias("n"))
    whole = part.groupBy("text_sha256").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    whole = whole.select("text_sha256", F.col("best.keep_id").alias("keep_id"), "group_size")
    facts = part.select("text_sha256", "__salt").join(whole, "text_sha256")
    return again.join(facts, ["text_sha256", "__salt"]).drop("__salt")


def _probed(digests: DataFrame, rows: DataFrame, n: int, bits_per_row: int) -> DataFrame:
    """rows plus ``__again``, by filters of all digests; both have text_sha256. In rounds, each round's rows are written once."""
    rounds, cells = _filter_size(n, bits_per_row)
    if rounds == 1:
        return may_repeat(rows, cut(repeated_cells(digests, cells)), cells)
    turn = F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(rounds)).cast("int").alias("__turn")
    hashes, rows = cut(digests.select("text_sha256", turn), "__turn"), cut(rows.select("*", turn), "__turn")
    parts = []
    for k in range(rounds):
        mine = F.col("__turn") == k
        parts.append(cut(may_repeat(rows.where(mine).drop("__turn"), cut(repeated_cells(hashes.where(mine), cells)), cells)))
    return reduce(DataFrame.unionByName, parts)


def exact_groups(docs: DataFrame, bits_per_row: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text).

    Texts are equal if they agree but for ASCII white space. The row with the most code points stays, then the smallest
    doc_id (a null doc_id is the smallest). Null text is empty, and empty texts are equal. Rows that repeat a doc_id with an
    equal text are one document and share its verdict; each still counts in group_size. An empty table gives an empty one.
    Other columns are not read.
    """
    digests = cut(_digests(docs))
    n = digests.count()
    probed = _probed(digests, digests, n, bits_per_row)
    alone = probed.where(~F.col("__again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = _verdicts(probed.where("__again"), n).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(shared).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, bits_per_row: int = 16) -> DataFrame:
    """docs with one row of each group of exact_groups, a row that it keeps; all columns stay as they are, whatever their names.

    Rows that repeat a doc_id and its text share exact_groups' verdict; here one of them stays. Only rows that may repeat
    shuffle, and each task sends one row of a group at most; the others pass.
    """
    digests = cut(_digests(docs).select("text_sha256"))
    rows = docs.select(F.struct("*").alias("__row"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    probed = _probed(digests, rows, digests.count(), bits_per_row)
    alone = probed.where(~F.col("__again")).select("__row.*")
    length = F.char_length(F.coalesce(F.col("__row.text"), F.lit("")))
    order = F.struct(-length, F.col("__row.doc_id"), F.xxhash64(F.to_json("__row")))
    one = probed.where("__again").groupBy("text_sha256").agg(F.min_by("__row", order).alias("__row"))
    return alone.unionByName(one.select("__row.*"))
