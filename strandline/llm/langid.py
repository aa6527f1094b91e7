"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier on hashed byte n-grams predicts each bit. A text gets the
language whose codeword has the least loss against the margins, each bit weighted by how reliable its classifier is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy, utf8

#: n-grams of 1 to ORDER bytes fall into 2 ** LOG2 features.
ORDER, LOG2 = 3, 13
#: The bounds of the training sample: rows for each label, and rows in all, unless LEAST_ROWS for each label are more.
PER_LANGUAGE, MOST_ROWS, LEAST_ROWS = 300, 4000, 8
#: Long texts are counted in stretches of this many bytes.
STRETCH = 1 << 22
#: ASCII letters in lower case; other ASCII is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "und"


def features(text: bytes) -> np.ndarray:
    """The square roots of the n-grams' shares of the text."""
    folded = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    counts = np.zeros(1 << LOG2)
    for at in range(0, len(folded), STRETCH):
        b = np.frombuffer(folded, np.uint8)[at : at + STRETCH + ORDER - 1].astype(np.uint32)
        gram = np.zeros(min(STRETCH, len(b)), np.uint32)
        for n in range(1, ORDER + 1):
            most = min(STRETCH, len(b) - n + 1)
            if most <= 0:
                break
            gram = gram[:most] << np.uint32(8) | b[n - 1 : n - 1 + most]
            counts += np.bincount(((gram + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - LOG2), minlength=1 << LOG2)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all distinct splits of few classes, else the best of some random codes from a fixed seed."""
    if k <= 5:
        rows = [x for x in product((1, -1), repeat=max(k, 1)) if x[0] == 1 and (-1 in x or k < 2)]
        return np.array(rows, np.float32).T
    length, rng, best, gap = 10 * int(np.ceil(np.log2(k))), np.random.default_rng(0), None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.float32), (k, length))
        code = code[:, (np.abs(code.sum(axis=0)) < k)]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * length).min()
        if apart > gap:
            best, gap = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: Of each bit, by how much its classifier beats chance on the sample.
    trust: np.ndarray
    #: Below this difference of the two best shares a prediction is ambiguous.
    margin: float = 0.2

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, score and whether ambiguous, for rows of margins."""
        loss = (np.logaddexp(0, -margins) * self.trust) @ (self.code.T > 0) + (np.logaddexp(0, margins) * self.trust) @ (self.code.T < 0)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        second = order[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return share.argmax(axis=1), share.max(axis=1), order[:, -1] - second < self.margin


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", most_rows=512):
            rows = [features(x).astype(np.float16).tobytes() for x in utf8(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(rows, pa.binary())], names=["lang", "features"])


def train(docs: DataFrame, seed: int = 5) -> Model | None:
    """A model of the labelled rows of docs (doc_id, text, lang) outside the held-out fold; None if there are none.

    Every label is learned, from a bounded sample: about PER_LANGUAGE rows of each, fewer if there are so many labels that they
    would be more than MOST_ROWS, but LEAST_ROWS at least (or all that there are). They are picked by a hash of doc_id; whole texts
    are read, and only their features come to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.trim("text") != ""))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, min(PER_LANGUAGE, MOST_ROWS // len(counts)))
    chance = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < F.coalesce(F.element_at(chance, F.col("lang")), F.lit(0.0)))
    rows = sorted(((r.lang, bytes(r.features)) for r in sample.select("lang", "text").mapInArrow(tidy(_feature_batches), "lang string, features binary").collect()))
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    x = np.stack([np.frombuffer(f, np.float16) for _, f in rows]).astype(np.float32)
    y = np.array([languages.index(lang) for lang, _ in rows])
    code = codewords(len(languages))
    target = code[y]
    balance = (1 / np.bincount(y))[y][:, None] / len(languages)
    mean = (x * balance).sum(axis=0)
    z = (x - mean) * 30
    weights, bias = np.zeros((z.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, bias_speed = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(60):  # gradient descent with momentum on the logistic loss
        pull = -target / (1 + np.exp(np.clip(target * (z @ weights + bias), -30, 30))) * balance
        speed = 0.9 * speed - 0.05 * (z.T @ pull + 1e-3 * weights)
        bias_speed = 0.9 * bias_speed - 0.05 * pull.sum(axis=0)
        weights, bias = weights + speed, bias + bias_speed
    right = ((target * (z @ weights + bias) > 0) * balance).sum(axis=0)
    scale = 30 * weights
    return Model(languages, code, scale.astype(np.float32), (bias - mean @ scale).astype(np.float32), np.maximum(2 * right - 1, 0.01))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


PREDICTION = "doc_id long, lang_pred string, score double, ambiguous boolean"


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most_rows=4096):
                texts = utf8(part.column(1))
                named, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                rows = [i for i, x in enumerate(texts) if model and has_letter(x)]
                if rows:
                    margins = np.stack([features(texts[i]) @ model.weights for i in rows]) + model.bias
                    found, score[rows], unsure[rows] = model.decode(margins.astype(np.float64))
                    for i, k in zip(rows, found.tolist(), strict=True):
                        named[i] = model.languages[k]
                yield pa.record_batch([part.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(unsure)], names=[x.split()[0] for x in PREDICTION.split(", ")])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous: one row for each row of docs (doc_id, text, and lang unless a model is given).

    The text alone is read for a prediction, whole. Null text and texts without a letter are "und" with score 0, and so is every
    text if nothing is labelled. Repeated rows are kept. An empty table gives an empty one. Other columns are not read.
    """
    model = model or train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_predict(model)), PREDICTION)


def _keep(model: Model | None, least: float):
    """Batches of (row: struct, text): the rows whose text has a letter and, if there is a model, a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(model)
        for batch in batches:
            for part in slices(batch, "text", most_rows=4096):
                if model is None:
                    good = np.array([has_letter(x) for x in utf8(part.column(1))], bool)
                else:
                    asked = pa.record_batch([pa.array(range(len(part)), pa.int64()), part.column(1)], names=["doc_id", "text"])
                    found = pa.Table.from_batches(list(predict(iter([asked]))))
                    beyond_chance = found["score"].to_numpy() * len(model.languages) - 1
                    named = pa.compute.not_equal(found["lang_pred"], UNKNOWN).to_numpy()
                    good = named & ((len(model.languages) < 2) | (beyond_chance >= least * (len(model.languages) - 1)))
                yield pa.record_batch([part.column(0).filter(pa.array(good, pa.bool_()))], names=["row"])

    return run


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.1) -> DataFrame:
    """docs without rows that have no letter or that are like no language that the labels teach; all columns stay, whatever their names.

    A text is like no language if its best language's share is above chance, 1 in all languages, by less than ``least`` of the way
    from chance to certainty. If no row is labelled there is no model: then only rows without a letter go. Rows go through whole, so
    nulls in other columns, null and repeated ids stay as they are. An empty table gives an empty one.
    """
    model = model or train(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", docs.schema, False)])
    return rows.mapInArrow(tidy(_keep(model, least)), schema).select("row.*")
