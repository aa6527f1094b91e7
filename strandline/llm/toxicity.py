"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are on documents, so labelled tokens are made from them: in a toxic document of the sample, a token is toxic if its word,
or a beginning of it, is found in toxic documents far more often than in others. The field has two states; a token's evidence
is the sum of learned weights of hashed features of its word and of the words beside it. Forward and backward passes run over
all tokens of a slice at once, as prefix products of 2 x 2 matrices in blocks, and begin anew at each document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, tidy, utf8
from .langid import held_out

#: A word's features: the whole word and its beginnings and ends of these many bytes, in 2 ** LOG2 weights.
BEGINNINGS, ENDS, LOG2 = (3, 4, 5, 6), (3, 4), 18
#: The bounds of the training sample: toxic rows, other rows, and the bytes of a sampled text.
TOXIC_ROWS, OTHER_ROWS, MOST_BYTES = 900, 1500, 20_000
#: A token is labelled toxic if a beginning of its word is this many times as frequent in toxic documents, after so many different
#: words, and after as many as this share of the toxic documents.
RATIO, LEAST_CONTEXTS, LEAST_SHARE = 12.0, 4, 0.01
#: Documents, copies not counted, that a telling beginning must stand in; parts of the sample that take turns in being held back.
LEAST_DOCUMENTS, FOLDS = 3, 3
#: The chance that any beginning of the sample is taken for telling that is not.
DOUBT = 0.05
#: Steps of the fit, and the parts of the sample that they take in turn.
STEPS, TURNS = 80, 4
#: Words whose evidence a task remembers.
REMEMBERED = 200_000
#: ASCII letters in lower case; other ASCII parts tokens.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A character of a script that writes without spaces (Thai to Lao, CJK and its extensions) is a token of its own.
CHARACTER = rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe2[\xba-\xbf][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
ALONE, WIDE = re.compile(CHARACTER), re.compile(rb"[\xe0\xe2-\xe9\xef\xf0]")
TOKEN = re.compile(rb"%s|(?:(?!%s)[A-Za-z\x80-\xff])+" % (CHARACTER, CHARACTER))


def fold(text: bytes) -> bytes:
    """The tokens of a text in lower case A-Z, with one space between."""
    text = text.translate(FOLD)
    if WIDE.search(text):
        text = ALONE.sub(rb" \g<0> ", text)
    return b" ".join(text.split())


def features(words: list[bytes]) -> np.ndarray:
    """Rows of feature numbers, one row a word: hashes of all its bytes, of its beginnings and of its ends."""
    n = len(words)
    out = np.zeros((n, 1 + len(BEGINNINGS) + len(ENDS)), np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    if not n or not length.min():
        raise ValueError("words have bytes")
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, np.uint64(1099511628211))))
    out[:, 0] = np.add.reduceat(flat * power[np.arange(len(flat)) - np.repeat(start, length)], start) ^ length.astype(np.uint64)
    for k, m in enumerate((*BEGINNINGS, *ENDS), 1):
        at = start if k <= len(BEGINNINGS) else start + length - m
        long = length >= m
        out[long, k] = (flat[at[long, None] + np.arange(m)] * power[:m] if m <= len(power) else np.zeros((0, m), np.uint64)).sum(axis=1) * np.uint64(2 * (100 * (k > len(BEGINNINGS)) + m) + 3) + np.uint64(m)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - LOG2)).astype(np.int64)


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """State shares after each step of v <- [[a, b], [c, d]] v, from (1/2, 1/2), scaled to sum 1: the share of the second.

    In blocks of about the square root of the length: products within all blocks side by side, then from block to block.
    """
    n = len(a)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    m = np.zeros((4, rows * width))
    m[0], m[3] = 1.0, 1.0
    m[:, :n] = a, b, c, d
    m = m.reshape(4, rows, width).transpose(0, 2, 1).copy()
    for k in range(1, width):
        a0, b0, c0, d0 = m[:, k]
        a1, b1, c1, d1 = m[:, k - 1]
        p = np.stack([a0 * a1 + b0 * c1, a0 * b1 + b0 * d1, c0 * a1 + d0 * c1, c0 * b1 + d0 * d1])
        m[:, k] = p / p.sum(axis=0)
    start = np.empty((2, rows))
    x, y = 0.5, 0.5
    for r, (p, q, s, t) in enumerate(m[:, -1].T.tolist()):
        start[0, r], start[1, r] = x, y
        x, y = p * x + q * y, s * x + t * y
        x, y = x / (x + y), y / (x + y)
    first = m[0] * start[0] + m[1] * start[1]
    second = m[2] * start[0] + m[3] * start[1]
    return (second / (first + second)).T.ravel()[:n]


@dataclass
class Model:
    #: Weights of a token's own word, of the word before and of the word after.
    own: np.ndarray = field(default_factory=lambda: np.zeros(1 << LOG2))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1 << LOG2))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1 << LOG2))
    #: log weights of [from][to], of the first token, and of the toxic state itself.
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.0, -2.0], [-1.0, 0.0]]))
    bias: float = -3.0
    #: Of the document's evidence, to its score.
    slope: float = 1.0
    shift: float = 0.0
    #: The share of toxic labels; the score of every text if nothing could be learned.
    base: float = 0.0
    learned: bool = False

    def word_evidence(self, rows: np.ndarray) -> np.ndarray:
        """Of rows of features: own, before, after."""
        return np.stack([w[rows].sum(axis=1) for w in (self.own, self.before, self.after)])

    def evidence(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log odds of each token from words (3 rows, a column a token)."""
        e = words[0] + self.bias
        e[1:] += np.where(first[1:], 0, words[1, :-1])
        e[:-1] += np.where(last[:-1], 0, words[2, 1:])
        return np.clip(e, -30, 30)

    def passes(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forward and the backward share of the toxic state at each token; each document's first token starts even."""
        w, x = np.exp(self.moves), np.exp(e)
        move = lambda i, j: np.where(first, 1.0, w[i, j])
        forward = chain(move(0, 0), move(1, 0), x * move(0, 1), x * move(1, 1))
        # Backwards, a step takes in the token after; after a document's last token there is none.
        nxt = np.append(x[1:], 1.0)
        back = lambda i, j, z: np.where(last, 1.0, w[i, j] * z)[::-1]
        backward = chain(back(0, 0, 1.0), back(0, 1, nxt), back(1, 0, 1.0), back(1, 1, nxt))[::-1]
        return forward, backward

    def marginals(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        f, b = self.passes(e, first, last)
        return f * b / (f * b + (1 - f) * (1 - b))

    def document(self, marginals: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """The evidence of each of n documents: the logarithm of a count of its toxic tokens, in which unlikely ones hardly count,
        so that a long document's many small marginals do not add up to a toxic one."""
        return np.log(np.bincount(doc, marginals**4, n) + 1e-3)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40)))


class Tokens:
    """The tokens of texts, in a row: distinct words, the word of each token, its document, whether it is first or last."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = pc.ascii_split_whitespace(pa.array([fold(x) for x in texts], pa.binary()).cast(pa.string(), safe=False))
        flat = pc.list_flatten(parts).cast(pa.binary())
        self.doc = pc.list_parent_indices(parts).to_numpy()
        keep = pc.greater(pc.binary_length(flat), 0)
        flat, self.doc = flat.filter(keep), self.doc[keep.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.word = coded.indices.to_numpy()
        apart = self.doc[1:] != self.doc[:-1]
        self.first, self.last = np.append(True, apart)[: len(self.doc)], np.append(apart, True)[: len(self.doc)]


def _labelled_tokens(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """The label of each token, from its document's label and where its word's beginnings are found.

    A beginning counts once for each different word before it, and that for the first document which has the two, so that copies
    of a passage are not taken for evidence, nor a word that one document repeats.
    """
    sizes = [max(1, int((toxic[tokens.doc] == k).sum())) for k in (False, True)]
    beginnings = [[w] + [w[:k] for k in BEGINNINGS[1:] if len(w) > k] for w in tokens.words]
    before = np.where(tokens.first, -1, np.append(-1, tokens.word[:-1]))[: len(tokens.doc)]
    seen: tuple[dict, dict] = ({}, {})
    for label in (0, 1):
        mine = np.flatnonzero(toxic[tokens.doc] == bool(label))
        pairs, first = np.unique(np.stack([before[mine], tokens.word[mine]]), axis=1, return_index=True)
        for (p, w), d in zip(pairs.T.tolist(), tokens.doc[mine][first].tolist(), strict=True):
            for b in beginnings[w]:
                contexts = seen[label].setdefault(b, {})
                contexts[p] = min(d, contexts.get(p, d))
    least = max(LEAST_CONTEXTS, LEAST_SHARE * int(toxic.sum()))
    # By chance a context is a toxic document's as often as any token is; among so many beginnings, none should pass by chance.
    chance = sizes[1] / sum(sizes)
    beyond_chance = np.log((len(seen[0]) + len(seen[1])) / DOUBT)

    def telling(b: bytes) -> bool:
        yes = seen[1].get(b, {})
        if len(yes) < least or len(set(yes.values())) < LEAST_DOCUMENTS:
            return False
        k, n = len(yes), len(yes) + len(seen[0].get(b, {}))
        if k / sizes[1] <= RATIO * (n - k) / sizes[0]:
            return False
        return k * np.log(k / n / chance) + ((n - k) * np.log((n - k) / n / (1 - chance)) if n > k else 0.0) > beyond_chance

    word = np.array([any(map(telling, x)) for x in beginnings], bool)
    return (word[tokens.word] & toxic[tokens.doc]).astype(np.float64)


def _fit_field(texts: list[bytes], toxic: np.ndarray, base: float) -> Model:
    """The field: the likelihood of the labelled tokens by adaptive gradient steps, each on one part of the texts in turn."""
    model = Model(base=base)
    tokens = Tokens(texts)
    if not len(tokens.doc) or not toxic.any() or toxic.all():
        return model
    labels, rows = _labelled_tokens(tokens, toxic), features(tokens.words)
    sums = {k: np.full(1 << LOG2, 1e-6) for k in ("own", "before", "after")}
    move_sum, bias_sum = np.full((2, 2), 1e-8), 1e-8
    turns = [np.flatnonzero(tokens.doc % TURNS == t) for t in range(TURNS)]
    parts = []
    for at in (t for t in turns if len(t)):
        y, first, last = labels[at], tokens.first[at], tokens.last[at]
        used, word = np.unique(tokens.word[at], return_inverse=True)
        inner = ~first
        prior, later = y[:-1][inner[1:]], y[1:][inner[1:]]
        seen = np.array([[((1 - prior) * (1 - later)).sum(), ((1 - prior) * later).sum()], [(prior * (1 - later)).sum(), (prior * later).sum()]])
        parts.append((y, first, last, rows[used], word, inner, seen, max(1.0, y.sum())))
    for step in range(STEPS):
        y, first, last, mine, word, inner, seen, n = parts[step % len(parts)]
        e = model.evidence(model.word_evidence(mine)[:, word], first, last)
        f, b = model.passes(e, first, last)
        p = f * b / (f * b + (1 - f) * (1 - b))
        wrong = (p - y) / n
        shifted = (wrong, np.append(np.where(first[1:], 0, wrong[1:]), 0.0), np.append(0.0, np.where(last[:-1], 0, wrong[:-1])))
        for name, g in zip(("own", "before", "after"), shifted, strict=True):
            by_word = np.bincount(word, g, len(mine))
            grad = np.bincount(mine.ravel(), np.repeat(by_word, mine.shape[1]), 1 << LOG2) + 1e-5 * getattr(model, name)
            sums[name] += grad**2
            setattr(model, name, getattr(model, name) - (0.5 if name == "own" else 0.1) * grad / np.sqrt(sums[name]))
        # Expected moves: the two sides of each pair of neighbours, and the move between.
        x, w = np.exp(e), np.exp(model.moves)
        both = np.stack([1 - f, f])[:, None, :-1] * w[:, :, None] * np.stack([1 - b, b * x])[None, :, 1:]
        both = (both / both.sum(axis=(0, 1)))[:, :, inner[1:]].sum(axis=2)
        grad = (both - seen) / n
        move_sum += grad**2
        model.moves = np.clip(model.moves - 0.2 * grad / np.sqrt(move_sum), -6, 6)
        bias_grad = wrong.sum()
        bias_sum += bias_grad**2
        model.bias -= 0.3 * bias_grad / np.sqrt(bias_sum)
    model.learned = True
    for name in sums:
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


def _evidence_of(model: Model, texts: list[bytes]) -> np.ndarray:
    tokens = Tokens(texts)
    m = np.zeros(0)
    if len(tokens.doc):
        m = model.marginals(model.evidence(model.word_evidence(features(tokens.words))[:, tokens.word], tokens.first, tokens.last), tokens.first, tokens.last)
    return model.document(m, tokens.doc, len(texts))


Job = Callable[[int], "Model | np.ndarray | None"]


def fit(texts: list[bytes], labels: list[int], share: float | None = None, run: Callable[[Job, int], list] | None = None) -> Model:
    """A model of whole texts and their labels; share is that of toxic labels among all.

    The field is fitted on all texts. The scale of the document's score is fitted on evidence of texts that the field has not seen:
    FOLDS times a part of them is held back from a field of its own. Equal texts are held back together. With labels of one kind
    only, every score is their share. ``run`` does the FOLDS + 1 fits, by their numbers; here, one after the other, if none is given.
    """
    toxic = np.array(labels, bool)
    model = Model(base=float(toxic.mean()) if len(toxic) else 0.0)
    if not toxic.any() or toxic.all():
        return model
    part = np.array([zlib.crc32(x) % FOLDS for x in texts])

    def job(k: int) -> Model | np.ndarray | None:
        """The field of all texts, or the evidence of those of part k by a field of the others."""
        if k == FOLDS:
            return _fit_field(texts, toxic, model.base)
        rest, mine = np.flatnonzero(part != k), np.flatnonzero(part == k)
        apart = _fit_field([texts[i] for i in rest], toxic[rest], model.base)
        return _evidence_of(apart, [texts[i] for i in mine]) if apart.learned and len(mine) else None

    *apart, model = run(job, FOLDS + 1) if run else [job(k) for k in range(FOLDS + 1)]
    if not model.learned:
        return model
    z = np.full(len(texts), np.nan)
    for k, found in enumerate(apart):
        if found is not None:
            z[part == k] = found
    unseen = np.isnan(z)  # where the others of a part teach nothing
    if unseen.any():
        z[unseen] = _evidence_of(model, [texts[i] for i in np.flatnonzero(unseen)])
    share = model.base if share is None else share
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    x = np.stack([z, np.ones_like(z)])
    for _ in range(30):  # two numbers by Newton's method, held back a little
        p = model.score(z)
        curve = (x * (weight * p * (1 - p) + 1e-6)) @ x.T + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, x @ (weight * (p - toxic)) + 0.05 * np.array([model.slope, model.shift]))
        model.slope, model.shift = (np.array([model.slope, model.shift]) - np.clip(step, -1, 1)).tolist()
    return model


def _on_executors(spark: SparkSession) -> Callable[[Job, int], list]:
    """Runs numbered jobs as tasks; what they need, the bounded sample, goes along with them."""

    def run(job: Job, n: int) -> list:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    made = job(k)
                    # A class that went to a worker by value is another one there, so a model goes back as its fields.
                    plain = pickle.dumps(vars(made) if isinstance(made, Model) else made)
                    yield pa.record_batch([pa.array([k], pa.int64()), pa.array([plain], pa.binary())], names=["k", "made"])

        rows = spark.range(0, n, 1, n).mapInArrow(tidy(kernel), "k long, made binary").collect()
        made = [pickle.loads(r.made) for r in sorted(rows, key=lambda r: r.k)]
        return [Model(**x) if isinstance(x, dict) else x for x in made]

    return run


def train(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """A model of the rows of labels (doc_id, toxic) outside the held-out fold and their texts.

    It is fitted on a bounded sample: about TOXIC_ROWS toxic and OTHER_ROWS other labelled rows picked by a hash of doc_id (so
    the list of their ids is bounded, and is broadcast), whose whole texts have at most MOST_BYTES bytes.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    chance = F.when(F.col("toxic") == 1, min(1.0, TOXIC_ROWS / max(1, counts.get(1, 0)))).otherwise(min(1.0, OTHER_ROWS / max(1, counts.get(0, 0))))
    chosen = known.where(draw < chance).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).where((F.octet_length("text") <= MOST_BYTES)).select("doc_id", "text", "__toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r.text.encode() for r in rows], [r["__toxic"] for r in rows], share, _on_executors(docs.sparkSession))


SCORES = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(text: bytes, flagged: np.ndarray) -> list[dict]:
    """Code point offsets of the flagged tokens (their numbers in the text, rising)."""
    out, want, chars, at = [], flagged.tolist()[::-1], 0, 0
    for k, m in enumerate(TOKEN.finditer(text)):
        if not want:
            break
        if k == want[-1]:
            want.pop()
            start = chars + len(text[at : m.start()].decode("utf-8", "replace"))
            chars = start + len(m[0].decode("utf-8", "replace"))
            at = m.end()
            out.append({"start": start, "end": chars})
    return out


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for part in slices(batch, "text", most_bytes=2 << 20):
                texts = utf8(part.column(1))
                score, spans = np.full(len(texts), model.base), [[] for _ in texts]
                if model.learned:
                    tokens = Tokens(texts)
                    fresh = [w for w in tokens.words if w not in known]
                    if len(known) + len(fresh) > REMEMBERED:
                        known, fresh = {}, tokens.words
                    if fresh:
                        known.update(zip(fresh, map(tuple, model.word_evidence(features(fresh)).T.tolist()), strict=True))
                    m = np.zeros(0)
                    if len(tokens.doc):
                        words = np.array([known[w] for w in tokens.words]).T[:, tokens.word]
                        m = model.marginals(model.evidence(words, tokens.first, tokens.last), tokens.first, tokens.last)
                    score = model.score(model.document(m, tokens.doc, len(texts)))
                    starts = np.searchsorted(tokens.doc, np.arange(len(texts)))
                    hot = np.nonzero(m >= 0.5)[0]
                    for i in np.unique(tokens.doc[hot]).tolist():
                        spans[i] = _spans(texts[i], hot[tokens.doc[hot] == i] - starts[i])
                yield pa.record_batch([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, SPAN)], names=["doc_id", "score", "predicted", "spans"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), spans of toxic tokens in code points: a row for each row of docs.

    Whole texts are read, and nothing but the text. Null text is empty; an empty text has no toxic token and the score that
    belongs to that. Repeated rows are kept. An empty table gives an empty one. Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_score(model)), SCORES)
