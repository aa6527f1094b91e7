"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Strict shapes give the seed entities. Patterns are the contexts that these stand in: the one, two or three words on the left, the
word on the right, and the two words around. Any string whose characters fit a kind is a candidate. Patterns and instances
(entities and candidates) form a graph that is scored in rounds: a pattern is as good as the share of entities among its instances
that are judged, an instance as good as the best pattern on its left and the best on its right together. Strings of a kind's shape
that fail its check are judged not to be entities; candidates that no pattern has discovered yet are not judged. Candidates that
good patterns discover become further entities, until a round finds no more; the seeds always stay.

Beside the four kinds of personal data, secrets (keys and tokens) go through the same rounds; they are reported apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut as cut_packed
from .common import salted_lookup

#: The kinds whose spans are listed together, in the order of the list; and what is reported apart.
PERSONAL, SECRET = ("email", "ip", "card", "phone"), "secret"
KINDS = (*PERSONAL, SECRET)

# Leftmost, non-overlapping. A start inside a run whose first character failed must fail too, hence the look-behinds (\G: a run
# may begin where the last match ended); possessive repeats keep matching linear and the regex engine's stack flat.
SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
}
#: What must stand in a text for the kind to be looked for, by seeds and by candidates.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]"}
NEEDS_LOOSE = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9A-Fa-f](?:[.:]|\[\.\]|\(\.\))", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
#: Strings whose characters fit a kind, written in any other way; candidates only.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]++(?:(?:[.:]|::|\[\.\]|\(\.\))[0-9A-Fa-f]++){3,}+(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?=(?:[\x20./_-]?[0-9]){12})[0-9]++(?:[\x20./_-][0-9]++)*+(?![0-9A-Za-z])",
    "phone": r"(?<![+0-9A-Za-z(.-])(?=\(?[0-9](?:[\x20./()-]{0,2}[0-9]){6})(?:\([0-9]{2,4}\) ?)?+[0-9]++(?:[\x20./-][0-9]++)*+(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[0-9A-Za-z+/_-]{16,}+(?![0-9A-Za-z])",
}
#: A pattern needs so many different entities, and this share of entities among its judged instances; a candidate this score.
LEAST_SEEDS, LEAST_PATTERN, LEAST_SCORE = 3, 0.8, 0.9
#: The weight of the word on the right beside that of the words on the left.
RIGHT_ALONE = 0.5
SALTS = 64


def _contexts(before: Column, after: Column) -> Column:
    """The patterns of a match by the texts before and after it, in lower case: one to three words on the left, one on the right, one
    on either side. A string in quotes stands between these, so a quote is a word of its own context too."""
    last = F.lower(F.substring_index(F.trim(F.regexp_replace(before, r"\s+", " ")), " ", -3))
    right = F.lower(F.regexp_extract(after, r"^\s*(\S+)", 1))

    def named(x: Column) -> Column:
        words, right = F.split(x["last"], " "), x["right"]
        one = F.element_at(words, -1)
        some = F.array(
            F.when(one != "", F.concat(F.lit("l1 "), one)),
            F.when(F.size(words) >= 2, F.concat(F.lit("l2 "), F.substring_index(x["last"], " ", -2))),
            F.when(F.size(words) >= 3, F.concat(F.lit("l3 "), x["last"])),
            F.when(right != "", F.concat(F.lit("r1 "), right)),
            F.when((one != "") & (right != ""), F.concat(F.lit("lr "), one, F.lit(" _ "), right)),
        )
        return F.filter(some, lambda c: c.isNotNull())

    return _bound(F.struct(last.alias("last"), right.alias("right")), named)


def cut(df: DataFrame) -> DataFrame:
    return cut_packed(df, packed=False)


def _matches(text: Column, regex: str) -> Column:
    """array<struct<start, end, value, contexts>> of all matches; start and end in code points."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def sized(gaps: Column) -> Column:
        # The text after the last match is a gap too; it has no match beside it.
        each = lambda x, i: F.struct(x.alias("value"), F.char_length(x).alias("n"), F.char_length(F.get(gaps, i)).alias("skip"), _contexts(F.get(gaps, i), F.get(gaps, i + 1)).alias("contexts"))
        return F.transform(hits, each)

    return _bound(F.when(F.size(hits) > 0, F.split(text, regex, -1)), lambda gaps: _bound(F.when(gaps.isNotNull(), sized(gaps)), _placed))


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once: inside a higher-order function an expression is computed for each element."""
    return F.transform(F.array(value), body)[0]


def _placed(sized: Column) -> Column:
    """Adds up skip and n to offsets, in stretches of the square root of their number, so that the work stays small."""
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"] + x["skip"])
    running = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))

    def stretched(step: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / step).cast("int")), lambda k: length(F.slice(sized, k * step + 1, step)))
        return _bound(F.aggregate(stretches, F.array(F.lit(0)), running), lambda before: F.transform(sized, lambda x, i: at(step, before, x, i)))

    def at(step: Column, before: Column, x: Column, i: Column) -> Column:
        k = F.floor(i / step).cast("int")
        start = F.element_at(before, k + 1) + length(F.slice(sized, k * step + 1, i % step)) + x["skip"]
        return _bound(start, lambda at: F.struct(at.alias("start"), (at + x["n"]).alias("end"), x["value"].alias("value"), x["contexts"].alias("contexts")))

    return F.when(F.size(sized) > 0, _bound(F.ceil(F.sqrt(F.size(sized))).cast("int"), stretched))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    def add(s: Column, x: Column) -> Column:
        d = x.cast("int") * F.when(s["odd"], 2).otherwise(1)
        return F.struct((s["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~s["odd"]).alias("odd"))

    total = F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add)
    return total["sum"] % 10 == 0


def _valid(kind: str, value: Column, loose: bool) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        parts = F.split(F.regexp_replace(value, r"[\[\]()]", ""), r"\.")
        four = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$") & F.coalesce(part(p), F.lit(False)))
        return four | value.rlike("^[0-9A-Fa-f]{1,4}(:{1,2}[0-9A-Fa-f]{1,4}){3,7}$") if loose else F.forall(parts, part)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(7 if loose else 9, 15)
    return F.lit(True)


def _of_kind(k: int, matches: Column, loose: bool) -> Column:
    """The matches with ``good``: true for what passes the kind's check, false for what has its shape and fails, null for neither."""
    n = lambda x: F.length(_digits(x["value"]))
    shaped = (lambda x: n(x).between(12, 19)) if KINDS[k] == "card" else (lambda x: F.lit(not loose))
    good = lambda x: F.when(F.coalesce(_valid(KINDS[k], x["value"], loose), F.lit(False)), True).when(shaped(x), False)
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["contexts"].alias("contexts"), good(x).alias("good")))


def _found(text: Column, kinds: dict[str, str], needs: dict[str, str], loose: bool) -> Column:
    """All matches of the kinds in one array, with the kind's place in KINDS and whether they are good."""
    return F.array_sort(F.concat(*(_of_kind(k, F.coalesce(F.when(text.rlike(needs[kind]), _matches(text, kinds[kind])), F.array()), loose) for k, kind in enumerate(KINDS))))


def _entities(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, seeds, loose, wrong: the entities and the candidates of each row, and what has their shape only.

    row_key is a digest of the id and the text: equal rows share it, and what is found in them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.md5(text.cast("binary")), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", key.alias("row_key"), text.alias("text"))
    rows = rows.select("doc_id", "row_key", _found(F.col("text"), SEEDS, NEEDS, False).alias("strict"), _found(F.col("text"), CANDIDATES, NEEDS_LOOSE, True).alias("loose"))
    good, bad = (lambda x: F.coalesce(x["good"], F.lit(False))), (lambda x: ~F.coalesce(x["good"], F.lit(True)))
    wrong = F.concat(F.filter("strict", bad), F.filter("loose", bad))
    return rows.select("doc_id", "row_key", F.filter("strict", good).alias("seeds"), F.filter("loose", good).alias("loose"), F.transform(wrong, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["contexts"].alias("contexts"))).alias("wrong"))


def _instance(e: Column) -> Column:
    return F.xxhash64(e["kind"], e["value"])


def _instances(found: DataFrame) -> DataFrame:
    """The graph: distinct (pattern, side, instance), with whether the instance is a seed, and whether it is no entity."""
    named = lambda array, seed, wrong: F.transform(array, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["contexts"].alias("contexts"), F.lit(seed).alias("seed"), F.lit(wrong).alias("wrong")))
    rows = found.select(F.explode(F.concat(named("seeds", True, False), named("loose", False, False), named("wrong", False, True))).alias("e"))
    rows = rows.select(_instance(F.col("e")).alias("instance"), "e.kind", "e.seed", "e.wrong", F.explode("e.contexts").alias("context"))
    rows = rows.select(F.xxhash64("kind", "context").alias("pattern"), F.startswith("context", F.lit("r1 ")).alias("right"), "instance", "seed", "wrong")
    return rows.groupBy("pattern", "right", "instance").agg(F.max("seed").alias("seed"), F.min("wrong").alias("wrong"))


def discovered(found: DataFrame) -> DataFrame:
    """(instance, score) of the candidates that patterns discover, by rounds over the graph of patterns and instances.

    The tables are keyed by hash of a pattern or of an instance, either of which may be in any part of the rows: lookups are salted.
    Entities only become more, so the rounds end: at the first that discovers none.
    """
    graph = cut(_instances(found))
    loose = cut(graph.where(~F.col("seed") & ~F.col("wrong")).select("pattern", "right", "instance"))
    judged = graph.groupBy("pattern").agg(F.count(F.when(F.col("seed"), 1)).alias("seeds"), F.count(F.when(F.col("wrong"), 1)).alias("wrong"))
    judged = cut(judged.where("seeds > 0 or wrong > 0"))
    accepted = loose.select("instance", F.lit(0.0).alias("score")).limit(0)
    n = 0
    while True:
        more = salted_lookup(loose, accepted, "instance", F.col("pattern"), SALTS).groupBy("pattern").agg(F.count("*").alias("more"))
        known = judged.join(more, "pattern", "full").select("pattern", (F.coalesce("seeds", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("entities"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
        patterns = known.where("entities > 0").withColumn("share", F.col("entities") / (F.col("entities") + F.col("wrong")))
        good = patterns.where((F.col("entities") >= LEAST_SEEDS) & (F.col("share") >= LEAST_PATTERN)).select("pattern", (F.col("share") * (1 - 1 / (1.0 + F.col("entities")))).alias("worth"))
        # Patterns of one side are much alike, so the best of each side counts; what follows supports, but does not discover alone.
        told = salted_lookup(loose, good, "pattern", F.col("instance"), SALTS)
        side = lambda right: F.coalesce(F.max(F.when(F.col("right") == right, F.col("worth"))), F.lit(0.0))
        scores = told.groupBy("instance").agg((1 - (1 - side(False)) * (1 - RIGHT_ALONE * side(True))).alias("score"))
        accepted = cut(scores.where(F.col("score") >= LEAST_SCORE))
        before, n = n, accepted.count()
        if n == before:
            return accepted


def _clear(spans: DataFrame) -> DataFrame:
    """Of the rows' spans (row_key, seed, x), those that are no seed and overlap none."""
    in_row = Window.partitionBy("row_key").orderBy("x.start", "x.end", "x.kind")
    ends = F.max(F.when(F.col("seed"), F.col("x.end"))).over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("seed"), F.col("x.start"))).over(in_row.rowsBetween(1, Window.unboundedFollowing))
    rows = spans.withColumn("ends", ends).withColumn("starts", starts).where(~F.col("seed"))
    return rows.where((F.coalesce("ends", F.lit(0)) <= F.col("x.start")) & (F.coalesce("starts", F.col("x.end")) >= F.col("x.end"))).select("row_key", "x")


def _listed(spans: Column) -> Column:
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]))
    return F.array_join(named, ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_secret, secrets, n_spans: a row for each of docs.

    The counts of the four kinds and the digest are those of the seeds; spans lists all their entities as kind:start:end by start, then
    by kind in the order of PERSONAL, in code points, end exclusive; secrets lists the keys and tokens likewise. n_discovered counts
    what is no seed, n_spans all. Null text is empty, and has none. Rows that repeat a doc_id are rows of their own. An empty table
    gives an empty one. Other columns than doc_id and text are not read.
    """
    found = cut(_entities(docs))
    loose = found.where(F.size("loose") > 0).select("row_key", F.explode("loose").alias("x")).distinct()
    told = salted_lookup(loose.withColumn("instance", _instance(F.col("x"))), discovered(found), "instance", F.col("row_key"), SALTS).select("row_key", "x")
    told = cut(told)
    seeds = found.join(told.select("row_key").distinct(), "row_key", "left_semi").select("row_key", F.explode("seeds").alias("x")).distinct()
    # A row's own spans are as many as its text allows; equal rows have equal ones.
    both = told.select("row_key", F.lit(False).alias("seed"), "x").unionByName(seeds.select("row_key", F.lit(True).alias("seed"), "x"))
    more = _clear(both).groupBy("row_key").agg(F.collect_list("x").alias("more"))
    rows = found.select("doc_id", "row_key", "seeds").join(more, "row_key", "left").withColumn("more", F.coalesce("more", F.array()))
    rows = rows.withColumn("every", F.array_sort(F.concat("seeds", "more")))
    count = lambda k: F.size(F.filter("seeds", lambda x: x["kind"] == k)).cast("long")
    own = lambda c: F.filter(c, lambda x: x["kind"] < len(PERSONAL))
    secrets = F.filter("every", lambda x: x["kind"] == len(PERSONAL))
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(PERSONAL)),
        F.sha2(_listed(own("seeds")).cast("binary"), 256).alias("base_sha256"),
        _listed(own("every")).alias("spans"),
        F.size("more").cast("long").alias("n_discovered"),
        F.size(secrets).cast("long").alias("n_secret"),
        _listed(secrets).alias("secrets"),
        F.size("every").cast("long").alias("n_spans"),
    )
