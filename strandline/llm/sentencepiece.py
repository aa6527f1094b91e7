"""SentencePiece encoding and decoding of whole texts with a given model.

A unigram model is encoded as a relational lattice: substrings of distinct words are exploded, equi-joined to the piece table,
grouped by word and folded by Viterbi in a higher-order aggregate (``unigram_words``). The best sum of scores is not what a BPE
model means, whose scores rank merges; its texts are encoded by merging all distinct words of a slice side by side
(``encode``). In both, a word is a run of meta spaces with what follows, which no piece reaches over.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

SPACE = "▁"
#: Words up to this many characters are merged side by side; longer ones one by one, with a heap.
SIDE_BY_SIDE = 48
#: Words that a task remembers.
REMEMBERED = 200_000
NONE = np.iinfo(np.int32).max


@dataclass
class Pieces:
    """A model's table: what is written for each id, the scores, and which ids text can have."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    #: id of each byte, for characters without a piece; else unknown is used.
    byte_ids: list[int] | None
    unknown: int
    kind: str
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a model file on the driver. Only models that leave the text as it is (no normalisation, spaces kept) are taken."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        fields = _proto(m.serialized_model_proto())
        trainer, normalizer = _proto(fields[2][0]), _proto(fields[3][0])
        if normalizer.get(2, [b""])[0] or normalizer.get(4, [1])[0]:
            raise ValueError("a model that normalises text or drops spaces is not supported")
        pieces = [m.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches over a space")
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(n)]
        to_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
        return cls(pieces, [m.get_score(i) for i in range(n)], [not x for x in special], [to_id[b] for b in range(256)] if len(to_id) == 256 else None, m.unk_id(), {1: "unigram", 2: "bpe"}[trainer.get(3, [1])[0]], bool(normalizer.get(3, [1])[0]))

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


def _proto(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message: numbers and bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        out.setdefault(key >> 3, []).append(value)
    return out


def words_of(text: str, dummy_prefix: bool = True) -> list[str]:
    """The words of a text, which joined give it back with meta spaces and the prefix."""
    if not text:
        return []
    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE if dummy_prefix else "") + text.replace(" ", SPACE))


class Merger:
    """BPE over symbols: every plain piece, and every character of one. A merge is any two symbols that make a piece."""

    def __init__(self, table: Pieces) -> None:
        self.table = table
        plain = {p: i for i, p in enumerate(table.pieces) if table.plain[i]}
        chars = sorted({c for p in plain for c in p} - set(plain))
        self.symbol = plain | {c: len(table.pieces) + k for k, c in enumerate(chars)}
        rank = {s: k for k, s in enumerate(sorted({table.scores[i] for i in plain.values()}, reverse=True))}
        merges = sorted(((self.symbol[p[:k]] << 24) | self.symbol[p[k:]], rank[table.scores[i]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self.keys, self.rank, self.made = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair's merge in the table, or -1."""
        pair = (left.astype(np.int64) << 24) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == pair), at, -1)

    def _ids(self, symbols: list[int], word: str) -> list[int]:
        """Symbols to ids; one that is no piece, or no symbol, is a single character of the word at that place."""
        out, at = [], 0
        for x in symbols:
            if 0 <= x < len(self.table.pieces):
                out.append(x)
                at += len(self.table.pieces[x])
            else:
                out += self.table.fallback(word[at])
                at += 1
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        single: list[tuple[int, list[int]]] = []
        n_pieces = len(self.table.pieces)
        for length, rows in by_length.items():
            if length > SIDE_BY_SIDE:
                single += [(i, self._ids(self._alone(words[i]), words[i])) for i in rows]
                continue
            for at in range(0, len(rows), 1 << 15):
                chunk = np.array(rows[at : at + (1 << 15)])
                codes = np.frombuffer("".join(words[i] for i in chunk.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
                for mine, symbols in self._together(codes):
                    plain = ((symbols >= 0) & (symbols < n_pieces)).all(axis=1)
                    whole.append((chunk[mine[plain]], symbols[plain]))
                    single += [(int(i), self._ids(x, words[i])) for i, x in zip(chunk[mine[~plain]].tolist(), symbols[~plain].tolist(), strict=True)]
        lengths = np.zeros(len(words), np.int64)
        for rows, symbols in whole:
            lengths[rows] = symbols.shape[1]
        for i, x in single:
            lengths[i] = len(x)
        starts = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), np.int64)
        for rows, symbols in whole:
            ids[starts[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        for i, x in single:
            ids[starts[i] : starts[i] + len(x)] = x
        return ids, lengths

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of code points, -1 where there is none."""
        if not hasattr(self, "_codes"):
            pairs = sorted((ord(c), i) for c, i in self.symbol.items() if len(c) == 1)
            self._codes, self._of = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.full(1, -1), np.full(1, -1))
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        return np.where(self._codes[at] == codes, self._of[at], -1)

    def _together(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length (rows of code points): the best merge of each at once, the leftmost of equals, until none has one.

        Each round takes one symbol from every word that is not done, so that all words at work stay equally long. Yields rows
        and their symbols.
        """
        s, rows = self._symbols(codes), np.arange(len(codes))
        place = self._look(s[:, :-1], s[:, 1:]) if len(self.keys) else np.full((len(s), s.shape[1] - 1), -1)
        rank = np.where(place >= 0, self.rank[place], NONE) if place.size else np.full(place.shape, NONE)
        while len(rows):
            if s.shape[1] == 1:
                yield rows, s
                return
            best = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), best] != NONE
            if not live.all():
                yield rows[~live], s[~live]
                rows, s, place, rank, best = rows[live], s[live], place[live], rank[live], best[live]
            n, at = len(rows), np.arange(len(rows))
            if not n:
                return
            s[at, best] = self.made[place[at, best]]
            keep = np.ones(s.shape, bool)
            keep[at, best + 1] = False
            s = s[keep].reshape(n, -1)
            place, rank = place[keep[:, 1:]].reshape(n, -1), rank[keep[:, 1:]].reshape(n, -1)  # the pair right of the merge moves up
            for side in (best - 1, best):
                ok = (side >= 0) & (side < place.shape[1])
                found = self._look(s[at[ok], side[ok]], s[at[ok], side[ok] + 1])
                place[at[ok], side[ok]] = found
                rank[at[ok], side[ok]] = np.where(found >= 0, self.rank[found], NONE)

    def _alone(self, word: str) -> list[int]:
        """One word of any length, with a heap of merges: time in proportion to n log n."""
        s = [self.symbol.get(c, -1) for c in word]
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list = []

        def push(i: int) -> None:
            j = nxt[i] if i >= 0 else len(s)
            if j < len(s) and s[i] >= 0 and s[j] >= 0:
                at = int(np.searchsorted(self.keys, s[i] << 24 | s[j]))
                if at < len(self.keys) and self.keys[at] == s[i] << 24 | s[j]:
                    heapq.heappush(heap, (int(self.rank[at]), i, j, s[i], s[j], int(self.made[at])))

        for i in range(len(s) - 1):
            push(i)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if s[i] != a or s[j] != b or nxt[i] != j:
                continue
            s[i], s[j] = made, -3
            nxt[i] = nxt[j]
            if nxt[j] < len(s):
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return [x for x in s if x != -3]


def _encode(table: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(table)
        index: dict[str, int] = {}
        ids = starts = lengths = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", most_bytes=1 << 19):
                texts = [words_of(x or "", table.dummy_prefix) for x in part.column(1).to_pylist()]
                coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(index) + len(distinct) > REMEMBERED:
                    index, ids, starts, lengths = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                fresh = [w for w in distinct if w not in index]
                if fresh:
                    made, size = merger.encode_words(fresh)
                    starts = np.append(starts, len(ids) + np.cumsum(size) - size)
                    lengths = np.append(lengths, size)
                    ids = np.append(ids, made)
                    index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                word = np.fromiter(map(index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
                per_word = lengths[word]
                ends = np.cumsum(per_word)
                flat = ids[np.repeat(starts[word] - ends + per_word, per_word) + np.arange(ends[-1] if len(ends) else 0)]
                per_text = np.fromiter(map(len, texts), np.int64, len(texts))
                offsets = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "text", "ids"])

    return run


def encode(docs: DataFrame, table: Pieces) -> DataFrame:
    """doc_id, text, ids: the ids of each whole text of docs (doc_id, text), row by row, without a shuffle.

    Null and empty texts have no ids. Characters without a piece are the ids of their bytes, or unknown. Control pieces written
    out in a text are ordinary characters. Repeated rows are kept. An empty table gives an empty one. Other columns are not read.
    """
    if table.kind != "bpe":
        raise ValueError("unigram models are encoded by unigram_words")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_encode(table)), "doc_id long, text string, ids array<int>")


def _decode(table: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = [p.replace(SPACE, " ").encode() if table.plain[i] else b"" for i, p in enumerate(table.pieces)]
        for b, i in enumerate(table.byte_ids or []):
            written[i] = bytes([b])
        if not table.byte_ids:
            written[table.unknown] = " ⁇ ".encode()
        size = np.fromiter(map(len, written), np.int64, len(written))
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(written), np.uint8)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                lists = part.column(part.num_columns - 1).fill_null([])
                ids, counts = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy()
                per_id = size[ids]
                ends = np.cumsum(per_id)
                flat = data[np.repeat(start[ids] - ends + per_id, per_id) + np.arange(ends[-1] if len(ends) else 0)]
                bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
                keep = np.ones(len(flat), bool)
                if table.dummy_prefix:
                    first = bounds[:-1][bounds[:-1] < bounds[1:]]
                    keep[first] = flat[first] != 32
                offsets = np.append(0, np.cumsum(keep))[bounds]
                texts = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat[keep].tobytes())])
                try:
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:  # ids that are not whole characters
                    texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, table: Pieces) -> DataFrame:
    """encoded (doc_id, text, ids) plus decoded, the text that the ids stand for; null ids are no ids."""
    return encoded.select("doc_id", "text", "ids").mapInArrow(tidy(_decode(table)), "doc_id long, text string, ids array<int>, decoded string")


def _round_trip(table: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decode(table)(_encode(table)(batches)):
            doc_id, text, ids, decoded = batch.columns
            yield pa.record_batch([doc_id, ids, pa.compute.equal(decoded, text.fill_null(""))], names=["doc_id", "ids", "same_text"])

    return run


def round_trip(docs: DataFrame, table: Pieces) -> DataFrame:
    """doc_id, ids, same_text: encode and decode in one pass of one worker; same_text tells whether the ids give the text back."""
    if table.kind != "bpe":
        raise ValueError("unigram models are encoded by unigram_words")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_round_trip(table)), "doc_id long, ids array<int>, same_text boolean")


# ---------------------------------------------------------------- unigram: the relational lattice


def unigram_words(words: DataFrame, table: Pieces) -> DataFrame:
    """word, ids: the segmentation of each distinct word with the best sum of scores; of equal sums, that whose last piece is
    longest, and so on backwards.

    The piece table is broadcast: it is the model's vocabulary, which does not grow with the input. A character without a piece
    costs ten less than the worst score and is unknown. Null and empty words have no row. A word's edges are folded in one
    row, which takes time in proportion to its length times its edges.
    """
    spark = words.sparkSession
    plain = [(p, i, s) for i, (p, s, ok) in enumerate(zip(table.pieces, table.scores, table.plain, strict=True)) if ok]
    longest = max((len(p) for p, _, _ in plain), default=1)
    worst = min((s for _, _, s in plain), default=0.0) - 10
    pieces = F.broadcast(spark.createDataFrame(plain, "piece string, id int, score double"))
    distinct = words.select("word").where("word <> ''").distinct().withColumn("n", F.char_length("word"))
    starts = distinct.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edges = starts.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))))
    edges = edges.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("length"))).join(pieces, "piece", "left")
    edges = edges.where(F.col("id").isNotNull() | (F.col("length") == 1))
    edge = F.struct((F.col("start") + F.col("length")).alias("end"), "start", F.coalesce("id", F.lit(table.unknown)).alias("id"), F.coalesce("score", F.lit(worst)).alias("score"))
    lattice = edges.groupBy("word", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # best[k]: the best sum of the first k characters, and the piece that ends there.
    nothing = "cast(null as struct<sum: double, start: int, id: int>)"
    first = "named_struct('sum', 0D, 'start', -1, 'id', -1)"
    fold = f"""aggregate(edges, concat(array({first}), array_repeat({nothing}, n)), (best, e) ->
        if(best[e.start] is not null and (best[e.end] is null or best[e.start].sum + e.score > best[e.end].sum),
           transform(best, (x, i) -> if(i = e.end, named_struct('sum', best[e.start].sum + e.score, 'start', e.start, 'id', e.id), x)), best))"""
    back = """aggregate(sequence(n, 1, -1), named_struct('at', n, 'ids', cast(array() as array<int>)), (s, k) ->
        if(s.at = k, named_struct('at', best[k].start, 'ids', concat(array(best[k].id), s.ids)), s), s -> s.ids)"""
    return lattice.withColumn("best", F.expr(fold)).withColumn("ids", F.expr(back)).select("word", "ids")
