"""The pipeline's stages on a small table of odd rows, each against plain Python on what the stage before kept."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm.mixing import mix_plan
from strandline.llm.queries import MODEL

from .test_llm import WS, brute_sets, language_docs, roots

CLASHES = ["__text", "__row", "__copy", "row", "sha", "node", "text_sha256", "__again", "key", "copies", "size", "salt"]


def odd_documents(spark):
    """Documents with near copies, doubled rows, one doc_id on two texts, null ids, nulls in other columns and clashing names."""
    docs, _, n = language_docs(spark)
    rng, rows = random.Random(13), [tuple(r) for r in docs.collect()]
    for i, text, *rest in rows[:60]:
        words = text.split()
        words[rng.randrange(len(words))] = "neu"
        rows.append((2000 + i, " ".join(words), *rest))
    rows += [(1000 + i, f" {t}\n", *rest) for i, t, *rest in rows[20:40]]
    rows += rows[5:30] + [(7, "the of and that with have this from the of and the", "en", "s1", None)]
    rows += [(None, t, None, None, None) for _, t, *_ in rows[40:50]] + [(None, "der die und nicht ist das ein mit", None, None, 1)] * 2
    table = spark.createDataFrame(rows, docs.schema)
    return table.select(F.lit("x").alias("id"), "*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[WS.sub("", text)].append((-len(text), doc_id is not None, doc_id or 0, text))
    return [(d if some else None, t) for _, some, d, t in map(min, groups.values())]


def near(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = brute_sets([t for _, t in rows])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of = roots(range(len(rows)), links)
    assert len(set(of.values())) < len(rows)
    return [rows[i] for i in sorted(set(of.values())) if of[i] == i]


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no model file")
def test_stages_lose_and_multiply_nothing(spark, tmp_path):
    docs = odd_documents(spark)
    plain = {
        "language ID": lambda rows: [r for r in rows if re.search("[a-z]", r[1] or "")],
        "exact dedup": exact,
        "near dedup": near,
    }
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, before, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        given, kept = ([(r.doc_id, r.text) for r in x.collect()] if "text" in x.columns else None for x in (before, out))
        if name in plain:
            assert out.columns == docs.columns and Counter(kept) == Counter(plain[name](given)), name
            # Rows stay whole.
            assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
        elif name == "mixing sources":
            copies = Counter()
            for r in mix_plan(before).collect():
                copies[r.doc_id] += r.copies
            assert Counter(d for d, _ in kept) == Counter({k: n for k, n in copies.items() if n}) and set(kept) <= set(given)
            assert max(Counter(kept).values()) <= 2 and None in copies
        else:
            assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, _ in given) and out.where("not same_text").count() == 0
    assert out.columns == ["doc_id", "n_tokens", "ids", "same_text"]
    again = corpus_pipeline.STAGES[3][1](spark, before.limit(0), str(tmp_path))
    assert again.count() == 0


def test_stages_on_nothing(spark, tmp_path):
    out = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, str(tmp_path))
        assert out.count() == 0
