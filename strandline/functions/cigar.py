"""CIGAR strings as columns: parsing, classification and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = "^([0-9]+[MIDNSHP=X])+$"


def bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def ops(cigar: Column) -> Column:
    """array<struct<n: int, op: string>>; text that is no CIGAR has no operations."""
    parts = F.regexp_extract_all(F.when(cigar.rlike(VALID), cigar).otherwise(""), F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def total(operations: Column, kinds: str) -> Column:
    """The summed length of the operations of some kinds."""
    return F.aggregate(operations, F.lit(0), lambda s, x: s + F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0))


def length_of(cigar: Column, kinds: str) -> Column:
    """total of the operations of a CIGAR, of which only the numbers of those kinds are taken out."""
    found = F.regexp_extract_all(F.when(cigar.rlike(VALID), cigar).otherwise(""), F.lit(f"([0-9]+)[{kinds}]"), 1)
    return F.aggregate(found.cast("array<int>"), F.lit(0), lambda s, n: s + n)


def reference_length(cigar: Column) -> Column:
    """Reference bases under the alignment (M D N = X)."""
    return length_of(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Read bases that the alignment consumes (M I S = X)."""
    return length_of(cigar, "MIS=X")


def span_end(pos: Column, cigar: Column) -> Column:
    """The last reference base of an alignment; null if it covers none."""
    return bind(reference_length(cigar), lambda n: F.when(n > 0, pos + n - 1))


def full_match(cigar: Column, read_length: Column) -> Column:
    return cigar == F.concat(read_length.cast("string"), F.lit("M"))


def soft(cigar: Column) -> Column:
    """Hard clips as soft ones."""
    return F.replace(cigar, F.lit("H"), F.lit("S"))


def _shape(kind, a, b, ref) -> Column:
    return F.struct(*(F.coalesce(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for x, n in ((kind, "kind"), (a, "a"), (b, "b"), (ref, "ref"))))


def letters(cigar: Column) -> Column:
    """The letters of a CIGAR, H as S."""
    return F.translate(cigar, "H0123456789", "S")


def classify(cigar: Column, read_length: Column, relaxed: bool = False, word: Column | None = None, numbers: Column | None = None) -> Column:
    """struct<kind, a, b, ref>: where a read is clipped. kind -1: clip then match, 1: match then clip, 10: both ends, 0: neither.

    ref is the reference length; -1 and -2 mark strings that say nothing. relaxed is the form of the segment filter: a lone match
    must be of the read's length, any one operation may stand between two clips, and = and X count as matches. word and
    numbers: the CIGAR's letters and numbers, where they are columns already.
    """
    # Letters and the outer numbers tell nearly all kinds; only strings of four operations or more are taken apart.
    word = letters(cigar) if word is None else word
    numbers = F.split(cigar, "[A-Z=]") if numbers is None else numbers
    n = F.length(word)
    first, last, mid = (F.coalesce(F.get(numbers, i).try_cast("int"), F.lit(0)) for i in (F.lit(0), n - 1, F.lit(1)))
    lone = (word == "M") & (first == read_length) if relaxed else word == "M"
    both = (n == 3) & word.startswith("S") & word.endswith("S") if relaxed else word == "SMS"
    inner = length_of(cigar, ("M=X" if relaxed else "M") + "D")

    def long(o: Column) -> Column:
        ends = F.concat(F.left(word, F.lit(1)), F.right(word, F.lit(1)))
        return (
            F.when(ends == "MS", _shape(1, read_length - last, o - 1, o))
            .when(ends == "SM", _shape(-1, first, 0, o))
            .when(ends == "MM", _shape(0, 0, 0, o))
            .when(ends == "SS", _shape(10, first, last, o))
            .otherwise(_shape(0, 0, 0, -2))
        )

    return (
        F.when(cigar.isNull() | (cigar == "*"), _shape(0, 0, 0, -1))
        .when(~cigar.rlike(VALID), _shape(0, 0, 0, -2))
        .when(n == 1, F.when(lone, _shape(0, 0, 0, read_length)).otherwise(_shape(0, 0, 0, -1)))
        .when(word == "MS", _shape(1, first, first - 1, first))
        .when(word == "SM", _shape(-1, first, 0, last))
        .when(both, _shape(10, first, last, mid))
        .when(word == "MDM", _shape(0, 0, 0, read_length + mid))
        .when(word == "MIM", _shape(0, 0, 0, read_length - mid))
        .when(n < 4, _shape(0, 0, 0, -2))
        .otherwise(bind(inner, long))
    )


def shape_class(cigar: Column) -> Column:
    """SMS, MS or SM by where the first match stands among the letters; null for a lone match."""
    letters = F.regexp_replace(cigar, "[^A-Za-z]", "")
    at = F.instr(letters, "M")
    inside = F.regexp_like(letters, F.lit("^[^M].*M.*[^M]$"))
    return F.when(letters == "M", F.lit(None)).when(inside, "SMS").when(at == 1, "MS").otherwise("SM")


def match_to_match_length(cigar: Column) -> Column:
    """Reference length (M and D) from the first match to the last; zero without a match."""

    def between(o: Column) -> Column:
        marks = F.transform(o, lambda x: (x["op"] == "M").cast("int"))
        first = F.array_position(marks, 1)
        last = F.size(o) - F.array_position(F.reverse(marks), 1) + 1
        return F.when(first > 0, total(F.slice(o, first.cast("int"), (last - first + 1).cast("int")), "MD")).otherwise(0)

    return bind(ops(cigar), between)


def end_clips(cigar: Column) -> Column:
    """struct<five, three>: clipped bases at the two ends, in the order of the string; null if it is no CIGAR."""
    number = lambda pattern: F.coalesce(F.regexp_extract(cigar, pattern, 1).try_cast("int"), F.lit(0))
    return F.when(cigar.rlike(VALID), F.struct(number("^([0-9]+)[SH]").alias("five"), number("([0-9]+)[SH]$").alias("three")))


def match_blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end>> of the matched blocks (M = X) on the reference."""
    step = lambda s, x: F.struct(
        (s["at"] + F.when(F.contains(F.lit("MDN=X"), x["op"]), x["n"]).otherwise(0)).alias("at"),
        F.when(F.contains(F.lit("M=X"), x["op"]), F.concat(s["blocks"], F.array(F.struct(s["at"].alias("start"), (s["at"] + x["n"] - 1).alias("end"))))).otherwise(s["blocks"]).alias("blocks"),
    )
    zero = F.struct(pos.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("blocks"))
    # Nearly all strings have one block, between clips; only the others are taken apart.
    n = F.regexp_extract(cigar, "([0-9]+)[M=X]", 1).try_cast("int")
    one = F.array(F.struct(pos.cast("int").alias("start"), (pos.cast("int") + n - 1).alias("end")))
    return F.when(cigar.rlike("^([0-9]+[SHP])*[0-9]+[M=X]([0-9]+[SHP])*$"), one).otherwise(F.aggregate(ops(cigar), zero, step, lambda s: s["blocks"]))


def spliced_cigar(blocks: Column) -> Column:
    """nM gN nM ... for rising blocks (start, end) of one strand."""
    step = lambda s, x: F.struct(
        x["end"].alias("last"),
        F.concat(s["text"], F.when(s["last"].isNotNull() & (x["start"] - s["last"] > 1), F.concat((x["start"] - s["last"] - 1).cast("string"), F.lit("N"))).otherwise(""), (x["end"] - x["start"] + 1).cast("string"), F.lit("M")).alias("text"),
    )
    return F.aggregate(blocks, F.struct(F.lit(None).cast("int").alias("last"), F.lit("").alias("text")), step, lambda s: s["text"])


def clip_payload(cigar: Column, seq: Column) -> Column:
    """L:left,R:right with the soft-clipped bases of a read; * if it has none."""
    clip = lambda x: F.when(x["op"] == "S", x["n"])

    def written(o: Column) -> Column:
        left = F.concat(F.lit("L:"), F.substring(seq, F.lit(1), clip(F.element_at(o, 1))))
        right = F.concat(F.lit("R:"), F.right(seq, clip(F.element_at(o, -1))))
        both = F.concat_ws(",", left, right)
        return F.when((F.size(o) == 0) | (both == ""), "*").otherwise(both)

    return F.when(F.coalesce(seq, F.lit("*")).isin("*", ""), "*").otherwise(bind(ops(cigar), written))


def clip_parts(payload: Column) -> Column:
    """The sides of a clip payload as a map; empty for *."""
    return F.when(payload == "*", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.str_to_map(payload, F.lit(","), F.lit(":")))


def placement_cigar(read_length: Column, start: Column, length: Column) -> Column:
    """One matched run in a read, clipped around."""
    after = read_length - start - length
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(start), length.cast("string"), F.lit("M"), clip(after))
