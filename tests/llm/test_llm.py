"""The training-data operators against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import chat, components, embedding_join, exact_dedup, langid, mixing, near_texts, pii, queries, repeated_spans, sentencepiece, simhash, toxicity
from strandline.llm.queries import MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[\x20\x09-\x0D]")


def docs_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "a", "a", "\t a\n", " b", "x" * 50_000, "é\U0001f600 z", "same text", "same  text ", "samet ext"]


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---------------------------------------------------------------- exact dedup


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[WS.sub("", t or "")].append(i)
    out = {}
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("bits_per_row", "most"), [(16, 27), (1, 27), (512, 15)])
def test_exact_groups(spark, monkeypatch, bits_per_row, most):
    monkeypatch.setattr(exact_dedup, "MOST_LOG2", most)  # with the least, in rounds
    assert most > 15 or exact_dedup._filter_size(412, bits_per_row) == (7, 1 << 15)
    rng = random.Random(2)
    texts = ODD + [f"text {rng.randrange(150)}" + " " * rng.randrange(3) for _ in range(400)]
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs_of(spark, texts), bits_per_row).collect()}
    assert found == brute_exact(texts)
    kept = exact_dedup.drop_exact_copies(docs_of(spark, texts), bits_per_row)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in found.items() if x[2])


def test_exact_false_positives_change_nothing(spark):
    texts = [f"t{i}" for i in range(300)] + ["t1"]
    digests = exact_dedup._digests(docs_of(spark, texts))
    bitmaps = exact_dedup.repeated_cells(digests, 64)
    again = exact_dedup.may_repeat(digests, bitmaps, 64).where("__again")
    assert again.count() > 100  # a small filter lets nearly all through
    assert exact_dedup._verdicts(again, 301).where("doc_id <> keep_id").select("doc_id").collect()[0].doc_id == 300


def test_drop_exact_copies(spark):
    docs = docs_of(spark, ODD).withColumn("text_sha256", F.lit("mine")).withColumn("__again", F.lit(7))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute_exact(ODD).items() if x[2]}
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0 == exact_dedup.exact_groups(docs.limit(0)).count()


def test_drop_exact_copies_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "ab"), (3, "x"), (3, "y"), (None, "n"), (None, "n"), (None, None), (None, ""), (4, " ")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Counter(map(tuple, kept.collect()))
    assert found == Counter([(1, "a b"), (3, "x"), (3, "y"), (None, "n"), (4, " ")])


# ---------------------------------------------------------------- mixing


def test_mix(spark):
    rng = random.Random(3)
    texts = ODD + ["w " * int(rng.paretovariate(1.1) * 5) for _ in range(600)]
    source = {i: None if i % 29 == 0 else "big" if i % 2 else f"s{i % 5}" for i in range(len(texts))}
    docs = docs_of(spark, texts, source=source)
    rows = mixing.mix_plan(docs).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert {r.doc_id: r["size"] for r in rows} == dict(enumerate(size))
    whole = defaultdict(int)
    for i, n in enumerate(size):
        whole[source[i]] += n
    names = sorted((s for s in whole if s is not None)) + [None]
    weight = dict(zip(names, [3, 1, 2] * 9, strict=False))
    left, target = 1.5 * sum(size), {}
    while True:  # full sources stop, what they leave goes to the others
        free = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * whole[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * whole[s]
            left -= target[s]
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == whole[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken == r.copies * r["size"] and r.copies <= 2
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for i, n in enumerate(size) if source[i] == s) + 0.02 * target[s]
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mix_keeps_null_and_repeated_ids(spark):
    rows = [(None, f"w {i} x y", "en", "a", i) for i in range(40)] + [(7, "one two three", "en", "a", 1)] * 40 + [(i, "p q r s", None, None, 1) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, DOCS)
    plan, mixed = mixing.mix_plan(docs).collect(), mixing.mix(docs)
    copies = Counter()
    for r in plan:
        copies[r.doc_id] += r.copies
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert copies[None] > 20 and 20 < copies[7] <= 80 and max(Counter(map(tuple, mixed.where("doc_id is null").collect())).values()) <= 2
    assert sorted(mixed.collect(), key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)


def test_mix_of_nothing(spark):
    assert mixing.mix_plan(docs_of(spark, ["a"]).limit(0)).count() == 0
    [row] = mixing.mix_plan(docs_of(spark, [None])).collect()
    assert (row["size"], row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


# ---------------------------------------------------------------- near dedup


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, monkeypatch):
    texts = [*ODD, "One two", "ONE TWO three   four five", "É é " * 50]
    rows = simhash.fingerprints(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == {i: brute_print(t) for i, t in enumerate(texts)}
    monkeypatch.setattr(simhash, "STRETCH", 7)
    for t in ("alpha beta gamma delta epsilon", "a b", "a", "  "):
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def clustered_prints(n, seed):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n // 2):
        x = rng.choice(sorted(out)[: n // 4])
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        out.add(x)
    center = rng.getrandbits(64)  # one dense group
    out |= {center ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) for _ in range(n // 2)}
    return sorted(out)


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    prints = clustered_prints(400, 5)
    fps = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(prints)], "node long, fp long")
    found = [(r.a, r.b) for r in simhash.links(fps, len(prints)).collect()]
    every = [(i, j) for i, x in enumerate(prints) for j in range(i) if (x ^ prints[j]).bit_count() <= 3]
    assert roots(range(len(prints)), found) == roots(range(len(prints)), every)


def test_thresholds_are_the_cheapest():
    widths, pairs, n = [20, 12, 16, 16], [5.0, 4000.0, 90.0, 90.0], 1000
    cost = lambda t, w, p: 0.0 if t < 0 else simhash.SIGNATURE_COST * n * sum(math.comb(w, k) for k in range(t + 1)) + min(max(p, n * n / 2**w) * sum(math.comb(w, k) for k in range(t + 1)), n * n / 2)
    every = [ts for ts in np.ndindex(5, 5, 5, 5) if sum(ts) == 4]
    best = min(sum(cost(t - 1, w, p) for t, w, p in zip(ts, widths, pairs, strict=True)) for ts in every)
    got, chosen = simhash.deal_thresholds(widths, pairs, n)
    assert math.isclose(got, best) and sum(t + 1 for t in chosen) == 4


def test_correlated_bits_share_a_part():
    c = np.zeros((64, 64))
    for i in range(0, 64, 2):
        c[i, i + 1] = c[i + 1, i] = 0.9
    for mask in simhash.group_bits(c, 4):
        assert mask.bit_count() == 16 and all((mask >> i & 3) in (0, 3) for i in range(0, 64, 2))


def test_near_groups(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(400)) for _ in range(6)]
    texts = [*ODD, *base, *(b + " tail" for b in base), *base[:2] * 4]
    prints = [brute_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    docs = docs_of(spark, texts).withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    rows = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == roots(range(len(texts)), links)
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(4000 + i, 4001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(300)]
    found = {r.id: r.component_id for r in components.components(spark.createDataFrame([*links, (1, 1)], "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: r for i, r in roots(ids, links).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- similar texts


def brute_sets(texts, k=5):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    return [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]


@pytest.mark.parametrize("block", [512, 4])
def test_drop_similar(spark, monkeypatch, block):
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))] for _ in range(12)]
    texts = [*ODD, "One two", "ONE  two", *(" ".join(b) for b in base)]
    for b in base:
        for _ in range(12):  # similarities about 0.8, on both sides
            copy = list(b)
            for _ in range(rng.randrange(1, max(2, len(b) // 30))):
                copy[rng.randrange(len(b))] = "new"
            texts.append(" ".join(copy))
    sets = brute_sets(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    prints = [brute_print(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in links) > 20  # what 3 bits miss
    docs = docs_of(spark, texts).withColumn("sha", F.lit("clash")).withColumn("node", F.lit(1))
    kept = near_texts.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots(range(len(texts)), links).values()))


def test_drop_similar_nulls_and_repeats(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "A b  c"), (5, "A b  c"), (None, "z"), (None, "z"), (7, None), (8, ""), (None, None), (9, "q")]
    kept = near_texts.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(5, "A b  c"), (None, "z"), (7, None), (9, "q")])
    assert near_texts.drop_similar(kept.limit(0)).count() == 0


# ---------------------------------------------------------------- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, regex) in enumerate(BASE.items()):
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"email": False, "ip": kind == "ip" and any(int(x) > 255 for x in m[0].split(".")), "card": not (12 <= len(digits) <= 19 and luhn(digits or "0")), "phone": not 9 <= len(digits) <= 15}[kind]
            if not bad:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii_seeds(spark):
    rng = random.Random(8)
    texts = [*ODD, "+1 (988) 555-2485 x", "a@b.c_d@e.f", "éé a.b@c-d.e.f. z", "4111 1111 1111 1111", "4111-1111-1111-1111 192.168.001.1 999.1.1.1 1.2.3.4.5.6.7.8", "1 " * 20_000, "a" * 50_000, "@" * 500, "a@b.co," * 1000, "0000000001.2.3.4", "\U0001f600 p@q.r 4111111111111111"]
    texts += ["".join(rng.choice("12.+@ -()a") for _ in range(200)) for _ in range(150)]
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, texts).withColumn("seeds", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        for kind in BASE:
            assert rows[i][f"n_{kind}"] == base.count(kind)
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert pii.find(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    seeds = [f"so tel: +1 (988) 555-3{i:03d} ok" for i in range(20)]
    texts = [*seeds, "hi tel: (988) 555-4111 ok", "room number 988 555-4111 ok", "write to joe [at] site [dot] com"]
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    assert rows[20].spans == "phone:8:22" and rows[20].n_discovered == 1 and rows[20].n_phone == 0
    assert rows[21].spans == "" == rows[22].spans


@pytest.mark.parametrize("unseen", [9, 20])
def test_pii_discovers_many_and_in_chains(spark, unseen):
    texts = [f"so tel: +1 (988) 555-3{i:03d} ok" for i in range(20)]
    texts += [f"hi tel: (988) 555-4{i:03d} ok" for i in range(unseen)]
    # What one pattern discovers makes the next one hold, four patterns long.
    for k in range(1, 4):
        texts += [f"hi {'tel:' if k == 1 else f'p{k - 1}'} (977) 555-{k}{i:03d} and p{k} (977) 555-{k}{i:03d} ok" for i in range(12)]
    texts += ["hi p3 (966) 555-9999 ok"]
    mixed = [f"so fax: +1 (944) 555-3{i:03d} ok" for i in range(10)] + [f"so fax: +{i:03d}11 ok" for i in range(9)] + ["so fax: (944) 555-4111 ok"]
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, texts + mixed)).collect()}
    assert all(rows[i].n_discovered == (0 if i < 20 else 1 if i < 20 + unseen or i == len(texts) - 1 else 2) for i in range(len(texts)))
    assert rows[len(texts + mixed) - 1].n_discovered == 0  # half of what follows fax: is judged wrong


def plain_contexts(text, start, end, matches):
    """The patterns of a match, whose gaps end at the matches beside it."""
    before, after = max((e for _, e in matches if e <= start), default=0), min((s for s, _ in matches if s >= end), default=len(text))
    left, right = text[before:start].lower().split(), text[end:after].lower().split()
    out = [f"l{n} " + " ".join(left[-n:]) for n in (1, 2, 3) if len(left) >= n]
    if right:
        out.append(f"r1 {right[0]}")
    return out + ([f"lr {left[-1]} _ {right[0]}"] if left and right else [])


def plain_bootstrap(texts):
    """All spans of each text by the rounds, in plain Python."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    ip = lambda v: all(int(p) <= 255 for p in re.sub(r"[\[\]()]", "", v).split(".")) if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", re.sub(r"[\[\]()]", "", v)) else bool(re.fullmatch(r"[0-9A-Fa-f]{1,4}(:{1,2}[0-9A-Fa-f]{1,4}){3,7}", v))

    def judge(kind, value, loose):
        n = len(digits(value))
        good = {"email": True, "secret": True, "ip": ip(value), "card": 12 <= n <= 19 and luhn(digits(value) or "0"), "phone": (7 if loose else 9) <= n <= 15}[kind]
        return True if good else False if (12 <= n <= 19 if kind == "card" else not loose) else None

    found = []
    for i, text in enumerate(texts):
        for loose, shapes in ((False, pii.SEEDS), (True, pii.CANDIDATES)):
            for k, kind in enumerate(pii.KINDS):
                regex = (BASE | {"secret": pii.SEEDS["secret"]})[kind] if not loose else shapes[kind]
                places = [m.span() for m in re.finditer(regex, text or "")]
                found += [(i, k, s, e, text[s:e], loose, judge(kind, text[s:e], loose), plain_contexts(text, s, e, places)) for s, e in places]
    graph = defaultdict(lambda: [False, True])
    for _, k, _, _, v, loose, good, contexts in found:
        for c in contexts if good is not None else []:
            edge = graph[k, c, v]
            edge[0], edge[1] = edge[0] or (good and not loose), edge[1] and not good
    accepted = set()
    while True:
        sums = defaultdict(lambda: [0, 0])
        for (k, c, v), (seed, wrong) in graph.items():
            sums[k, c][0] += seed or (not wrong and (k, v) in accepted)
            sums[k, c][1] += wrong and not seed
        worth = {p: a / (a + b) * (1 - 1 / (1 + a)) for p, (a, b) in sums.items() if a >= 3 and a / (a + b) >= 0.8}
        best = defaultdict(lambda: [0.0, 0.0])
        for (k, c, v), (seed, wrong) in graph.items():
            if not seed and not wrong:
                side = c.startswith("r1 ")
                best[k, v][side] = max(best[k, v][side], worth.get((k, c), 0.0))
        now = {x for x, (left, right) in best.items() if 1 - (1 - left) * (1 - 0.5 * right) >= 0.9}
        if len(now) == len(accepted):
            break
        accepted = now
    out = []
    for i in range(len(texts)):
        seeds = [(s, k, e) for d, k, s, e, _, loose, good, _ in found if d == i and good and not loose]
        more = {(s, k, e) for d, k, s, e, v, loose, good, _ in found if d == i and good and loose and (k, v) in now and not any(a < e and s < b for a, _, b in seeds)}
        out.append(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted([*seeds, *more])))
    return out


def test_pii_agrees_with_plain_rounds(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [
        lambda: f"+1 (988) 555-{digits(4)}", lambda: f"(988) 555-{digits(4)}", lambda: f"555.{digits(4)}", lambda: f"+{digits(3)}", lambda: f"u{digits(2)}@ex.org", lambda: f"u{digits(2)} [at] ex [dot] org",
        lambda: f"10.{digits(1)}.0.{digits(2)}", lambda: f"10[.]{digits(1)}[.]0[.]7", lambda: f"300.1.1.{digits(1)}", lambda: "fe80:1:2:" + digits(2), lambda: rng.choice(["4111 1111 1111 1111", "5500000000000004", "4111.1111.1111.1111", digits(16)]),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: "".join(rng.choice("0123456789ABCXYZ") for _ in range(24)), lambda: digits(4),
    ]
    marks = [["call", "tel:", "phone"], ["tel:", "fax"], ["dial"], ["room", "call"], ["mail", "to"], ["mail", "write"], ["host", "at"], ["host"], ["at", "v"], ["host", "six"], ["card", "pay"], ["token =", "key"], ["token =", "key"], ["in", "of", "call"]]
    texts = []
    for _ in range(240):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(values))
            parts += [rng.choice(["so", "and", "we", "The  big"]), rng.choice(marks[k]), values[k](), rng.choice(["ok", "now", "", "é."])]
        texts.append(" ".join(parts) if rng.random() < 0.9 else "\n".join(parts))
    texts += [None, "", "+1 (988) 555-1234", texts[0], texts[0]]
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, texts).withColumn("x", F.lit(1)).withColumn("seeds", F.lit(2))).collect()}
    wanted = plain_bootstrap(texts)
    for i in range(len(texts)):
        both = [x for c in (rows[i].spans, rows[i].secrets) for x in c.split(",") if x]
        assert sorted(both) == sorted(filter(None, wanted[i].split(","))), (i, texts[i], both, wanted[i])
        assert rows[i].n_spans == len(both) and rows[i].n_secret == len([x for x in rows[i].secrets.split(",") if x])
    assert sum(r.n_discovered for r in rows.values()) > 60


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_pii_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    wanted = dict(zip(ids, plain_bootstrap([texts[i] for i in ids]), strict=True))
    rows = queries.op1_pii(spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        assert sorted(x for c in (r.spans, r.secrets) for x in c.split(",") if x) == sorted(filter(None, wanted[r.doc_id].split(",")))


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<<<s>s>", "<\\s>", "<|over|", "a\\\\<|over|>b", "<|turn|>x<|says|>\\", "", None, "<</SYS>> é\U0001f600"]
    rows = [(1, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, None, None, None), (None, 5, "user", "z"), (5, 0, "<|over|>", "odd role")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_segments(conversations)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.TEMPLATE.escape(x)) + len(chat.TEMPLATE.escape(role)) + len("<|turn|><|says|><|over|>") for _, _, role, x in turns)
    assert [got[c].in_order for c in (1, 2, 3, 5)] == [True, False, True, False]
    assert got[1].ended and not got[3].ended
    for x in nasty:
        escaped = chat.TEMPLATE.escape(x or "")
        assert not any(c in escaped for c in chat.TEMPLATE.controls) and chat.TEMPLATE.unescape(escaped) == (x or "")
    assert chat.read_back(chat.format_segments(conversations.limit(0))).count() == 0


# ---------------------------------------------------------------- embeddings


@pytest.mark.parametrize("blocks", [2, 40])
def test_embedding_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding_join, "BLOCKS", blocks)
    monkeypatch.setattr(embedding_join, "LEAST_BLOCK", 8)
    monkeypatch.setattr(embedding_join, "RUN", 8)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(150, 16)), *(c + rng.normal(size=(8, 16)) * s for c, s in zip(centers, np.linspace(0.02, 0.5, 30), strict=True)), np.repeat(centers[:1], 40, axis=0) * 3])
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [math.nan] * 16), (n + 3, [math.inf] + [0.0] * 15), (n + 4, []), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.similar_groups(vectors).collect()}
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = [*zip(*np.nonzero(np.tril(near)), strict=True), (n + 7, n + 6)]
    component = roots(range(n + 9), [(int(a), int(b)) for a, b in links])
    count = [int(c) for c in near.sum(axis=1)] + [0] * 6 + [1, 1, 0]
    assert got == {i: (count[i], component[i], component[i] == i) for i in range(n + 9)}
    assert embedding_join.similar_groups(vectors.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200]), (3, [5e-324, 5e-324]), (4, [1.7e308, -1.7e308]), (5, [-1e-300, 1e-300]), (6, [3.0, 3.0]), (7, [1e308, -1e308]), (8, [1e308, 1e-308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.similar_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (1, 4), 7: (1, 4), 5: (0, 5), 8: (0, 8)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_planted_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    rng = np.random.default_rng(8)
    for i, v in list(sorted(x.items()))[:60]:
        for k in (1, 2):  # cosines about the threshold
            noise = rng.normal(size=len(v))
            x[10_000 * k + i] = (v + noise * np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.05, 0.5)) * rng.uniform(0.1, 9)
    ids = sorted(x)
    unit = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    component = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.tril(near)), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.similar_groups(spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, embedding array<double>")).collect()}
    assert near.sum() > 100 and got == {i: (int(n), component[i]) for i, n in zip(ids, near.sum(axis=1), strict=True)}


# ---------------------------------------------------------------- repeats


def brute_removal(texts, span=200):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [word(rng.randrange(100)) + rng.choice(passages) + word(rng.randrange(200)) + rng.choice(passages) for _ in range(60)]
    return [None, "", "short", word(500), texts[0], texts[0], "ab" * 400, "z" * 199, "y" * 200, "y" * 200, *texts]


@pytest.mark.parametrize("small", [False, True])
def test_repeated_spans(spark, monkeypatch, small):
    if small:  # texts in many stretches, slices and buckets
        monkeypatch.setattr(repeated_spans, "SLICE", 300)
        monkeypatch.setattr(repeated_spans, "LEAST_BUCKETS", 5)
        monkeypatch.setattr(repeated_spans, "REMEMBERED", 40)
    texts = repeat_texts()
    expect = brute_removal([(t or "").encode() for t in texts])
    docs = docs_of(spark, texts).withColumn("key", F.lit("clash"))
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans.removal(docs).collect()}
    assert rows == dict(enumerate(expect))
    if small:
        kept = {r.doc_id: bytes(r.kept) for r in repeated_spans.remove_repeats(docs).collect()}
        assert {i: hashlib.sha256(k).hexdigest() for i, k in kept.items()} == {i: e[3] for i, e in enumerate(expect)}
        assert repeated_spans.removal(docs.limit(0)).count() == 0


def test_equal_first_prints_do_not_decide():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 500):
        h, g = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 9, n).astype(np.uint32)
        order, same = repeated_spans._sorted_equals(h, g)
        pairs = list(zip(h[order].tolist(), g[order].tolist(), strict=True))
        assert sorted(pairs) == sorted(zip(h.tolist(), g.tolist(), strict=True))
        assert same.tolist() == [i > 0 and pairs[i] == pairs[i - 1] for i in range(n)] and same.sum() == n - len(set(pairs))


def test_fingerprints_of_equal_strings():
    prints, rng = repeated_spans.Fingerprints(), np.random.default_rng(5)
    data = np.concatenate([rng.integers(0, 256, 900, np.uint8)] * 2)
    for made in (prints.at, prints.second):
        out = made(data, np.arange(1600), 200)
        assert (out[:700] == out[900:1600]).all() and len(set(out[:900].tolist())) == 900
    one = prints.second(data, np.array([37]), 200)[0]
    assert one == sum((int(b) + 1) * pow(repeated_spans.SECOND_BASE, k, repeated_spans.PRIME) for k, b in enumerate(data[37:237])) % repeated_spans.PRIME


def test_positions_by_stretch():
    rng = random.Random(3)
    for n in (0, 67, 200, 1700):
        cover = repeated_spans.cover_positions(n)
        assert cover.tolist() == [i for i in range(n - 67) if i % 133 in repeated_spans.COVER]
        numbers = sorted(rng.sample(range(len(cover)), len(cover) // 6))
        assert repeated_spans.nth_cover_positions(np.array(numbers, np.int64)).tolist() == cover[numbers].tolist()
        marks = repeated_spans.pack(np.array(numbers, np.int64))
        wanted = [i for i in range(n - 199) if any(i <= c < i + 133 for c in cover[numbers])]
        assert repeated_spans.open_positions(n, marks).tolist() == wanted
        for step in (64, 400):
            assert [i for a in range(0, n, step) for i in repeated_spans.open_positions(n, marks, a, a + step)] == wanted
            assert [i for a in range(0, n, step) for i in repeated_spans.cover_positions(n, None, a, a + step)] == cover.tolist()


def test_cover_and_numbers():
    p, c = repeated_spans.PERIOD, repeated_spans.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))
    for x in ([], [0], [5, 6, 300, 70_000], list(range(1000))):
        assert repeated_spans.unpack(repeated_spans.pack(np.array(x, np.int64))).tolist() == x


# ---------------------------------------------------------------- classifiers

WORDS = {"en": "the of and that with have this from", "de": "der die und nicht ist das ein mit", "fr": "le la les des est que une dans"}


def language_docs(spark, n=240):
    rng = random.Random(4)
    lang = {i: list(WORDS)[i % 3] for i in range(n)}
    texts = [" ".join(rng.choice(WORDS[lang[i]].split()) for _ in range(rng.randrange(5, 40))) for i in range(n)]
    return docs_of(spark, [*texts, None, "", "123 !?", "the", "x" * 40_000], lang=lang | {n: None, n + 1: None, n + 2: "en", n + 3: None, n + 4: None}), lang, n


def test_language_id(spark):
    docs, lang, n = language_docs(spark)
    rows = {r.doc_id: r for r in langid.identify(docs.withColumn("features", F.lit(0))).collect()}
    assert len(rows) == n + 5 and all(0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[i].lang_pred == lang[i] for i in range(n)) >= 0.98 * n
    assert [rows[n + k].lang_pred for k in range(3)] == ["und"] * 3 and rows[n + 3].lang_pred == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and set(range(n)) <= {r.doc_id for r in kept.collect()} and not {n, n + 1, n + 2} & {r.doc_id for r in kept.collect()}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_identified(nothing).collect()} == {*range(n), n + 3, n + 4}  # what has a letter
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 40)
    monkeypatch.setattr(langid, "LEAST_ROWS", 5)
    rng = random.Random(14)
    stems = [["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(4)] for _ in range(30)]
    lang = {i: f"l{i % 30:02}" for i in range(900)}
    docs = docs_of(spark, [" ".join(rng.choice(stems[i % 30]) for _ in range(30)) for i in range(900)], lang=lang)
    rows = langid.identify(docs).collect()
    assert {r.lang_pred for r in rows} == set(lang.values()) and sum(r.lang_pred == lang[r.doc_id] for r in rows) > 850


def test_decoding_takes_the_least_weighted_loss():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c", "d"], langid.codewords(4), None, None, rng.random(7))
    margins = rng.normal(size=(20, 7))
    loss = np.array([[sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(row, code, model.trust, strict=True)) for code in model.code] for row in margins])
    best, score, unsure = model.decode(margins)
    assert (best == loss.argmin(axis=1)).all() and np.allclose(score, np.exp(-loss.min(axis=1)) / np.exp(-loss).sum(axis=1))
    share = np.sort(np.exp(-loss) / np.exp(-loss).sum(axis=1, keepdims=True), axis=1)
    assert (unsure == (share[:, -1] - share[:, -2] < model.margin)).all()


def test_keep_identified_leaves_rows_as_they_are(spark):
    docs, _, n = language_docs(spark)
    odd = docs.where("doc_id < 6").withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    both = docs.unionByName(odd).unionByName(docs.where("doc_id = 7")).select(F.lit(1).alias("__text"), "*", F.lit("r").alias("row"), F.lit("x").alias("__row"))
    kept = langid.keep_identified(both)
    assert kept.columns == both.columns
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, both.where(f"doc_id is null or doc_id < {n} or doc_id > {n + 2}").collect()))
    level = langid.Model(["a", "b", "c"], langid.codewords(3), np.zeros((1 << langid.LOG2, 3), np.float32), np.zeros(3, np.float32), np.ones(3))
    assert langid.keep_identified(both, level).count() == 0 and langid.keep_identified(both, level, 0.0).count() == kept.count()
    assert langid.keep_identified(both.limit(0)).count() == 0


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 5, 9, 40):
        code = langid.codewords(k)
        assert len(code) == k and (k < 2 or min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 1)


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "ti", "ro", "ne", "su", "la"]) for _ in range(rng.randrange(2, 5)))
    texts, toxic = [], {}
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 60))]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumblo", "vexxit", "grumbla"])
        texts.append(" ".join(words))
    texts += [None, "", "grumblo", "12 34", "ba " * 20_000]
    docs = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert sum(rows[i].predicted == toxic[i] for i in toxic) >= 395 and all(0 <= r.score <= 1 for r in rows.values())
    hit = rows[0].spans
    assert hit and all(texts[0][s.start : s.end] in ("grumblo", "vexxit", "grumbla") for s in hit)
    assert rows[400].predicted == rows[401].predicted == rows[403].predicted == rows[404].predicted == 0 and rows[402].predicted == 1
    one_kind = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(docs, one_kind).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_words_are_read_whole():
    long = b"a" * 40
    whole = toxicity.features([long + b"b", long + b"c", long[:-1] + b"bb", b"xx" + long + b"quux", b"quux", b"ab", b"abc"])
    assert len(set(whole[:, 0].tolist())) == 7  # words that differ beyond their first bytes
    assert whole[3, 6] == whole[4, 6] and whole[3, 5] == whole[4, 5] and (whole[0, 1:5] == whole[1, 1:5]).all()
    text = "日本語abc déjà ไทย x".encode()
    assert toxicity.fold(text).decode() == "日 本 語 abc déjà ไ ท ย x"
    assert [m[0] for m in toxicity.TOKEN.finditer(text)] == toxicity.fold(text).split()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    assert right > max(np.mean([labels[r.doc_id] == k for r in rows]) for k in (0, 1)) + 0.03  # of what a constant answer gets
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").collect()}
    rows = [r for r in queries.op10_langid(spark, sf).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.98 * len(rows)


def test_chain_is_the_plain_recursion():
    rng = np.random.default_rng(0)
    for n in (1, 2, 57, 300):
        m, v, out = rng.random((4, n)) + 0.01, np.array([0.5, 0.5]), []
        for k in range(n):
            v = np.array([[m[0, k], m[1, k]], [m[2, k], m[3, k]]]) @ v
            v /= v.sum()
            out.append(v[1])
        assert np.allclose(toxicity.chain(*m), out)


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    model = toxicity.Model(moves=rng.normal(size=(2, 2)))
    e = rng.normal(size=7)
    first, last = np.array([1, 0, 0, 0, 1, 0, 0], bool), np.array([0, 0, 0, 1, 0, 0, 1], bool)
    total, hit = 0.0, np.zeros(7)
    for path in np.ndindex(*[2] * 7):
        w = np.exp(sum(e[k] * s for k, s in enumerate(path)) + sum(model.moves[path[k - 1], path[k]] for k in range(1, 7) if not first[k]))
        total += w
        hit += w * np.array(path)
    assert np.allclose(model.marginals(e, first, last), hit / total)


# ---------------------------------------------------------------- sentence pieces

has_model = pytest.mark.skipif(not Path(MODEL).exists(), reason="no model file")


@has_model
def test_pieces_agree_with_the_library(spark):
    import sentencepiece as library

    model, table = library.SentencePieceProcessor(model_file=MODEL), sentencepiece.Pieces.load(MODEL)
    rng = random.Random(1)
    texts = ["", "  a  b ", "a b\tc\nd", "ﬁ ①", "<s>x</s><unk>", "▁a", " ", "     ", "\x00", "日本語 🤗 ̀ x y", "a" * 1000, "word " * 200 + "x" * 300, "\n\n\n", "ab" * 40 + " " * 40 + "z"]
    texts += ["".join(rng.choice("abcdetinorsh  éß▁日.,'\n") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    docs = docs_of(spark, [*texts, None]).withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in sentencepiece.decode(sentencepiece.encode(docs, table), table).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t)
        assert rows[i].ids == ids and rows[i].decoded == model.decode(ids), t
    assert rows[len(texts)].ids == [] and rows[len(texts)].decoded == ""
    same = {r.doc_id: r.same_text for r in sentencepiece.round_trip(docs, table).collect()}
    assert all(same[i] == ("▁" not in t) for i, t in enumerate(texts))
    assert sentencepiece.round_trip(docs.limit(0), table).count() == 0


def test_unigram_lattice(spark):
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)} | {"a", "b"})
    scores = [-rng.random() * 5 for _ in pieces]
    table = sentencepiece.Pieces(["<unk>", *pieces], [0.0, *scores], [False] + [True] * len(pieces), None, 0, "unigram")
    words = ["", None, "a", "zz", *("".join(rng.choice("abcz") for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    got = {r.word: r.ids for r in sentencepiece.unigram_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    known = dict(zip(pieces, zip(range(1, 99), scores, strict=False), strict=False))

    def best(w):
        if not w:
            return 0.0
        return max((known[w[:k]][1] if w[:k] in known else min(scores) - 10) + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in known or k == 1)

    assert set(got) == {w for w in words if w}
    for w, ids in got.items():
        score = sum(scores[i - 1] if i else min(scores) - 10 for i in ids)
        assert math.isclose(score, best(w)) and sum(len(pieces[i - 1]) if i else 1 for i in ids) == len(w)
