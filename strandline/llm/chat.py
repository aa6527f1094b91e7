"""Chat formatting: a finite-state machine over roles and a declarative template, streamed turn by turn.

A conversation's rows are sorted within one partition and formatted one at a time, so a task holds one turn, not a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Put before the second character of a control string in a text, and doubled where a text has it.
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles carry the loss, and which role may follow which."""

    opening: str = "<|turn|>{role}<|says|>"
    closing: str = "<|over|>"
    #: Roles, by name, whose text the model is to learn.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> state; a role without a state is out of order.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("answered",)
    #: Control strings of this template and of others, none of which may stand in a text.
    controls: tuple[str, ...] = ("<|turn|>", "<|says|>", "<|over|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self) -> None:
        marks = re.findall(r"<\|\w+\|>", self.opening + self.closing)
        assert set(marks) <= set(self.controls) and "{role}" in self.opening, "each mark of the template must be a control string"
        assert not any(ESCAPE in x or len(x) < 2 for x in self.controls)

    def escape(self, text: str) -> str:
        """The text with every control string broken by ESCAPE; unescape gives it back."""
        at = "|".join(map(re.escape, self.controls))
        return re.sub(rf"(\\)|(?=(?:{at}))(.)", lambda m: ESCAPE * 2 if m[1] else m[2] + ESCAPE, text, flags=re.DOTALL)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


TEMPLATE = Template()
SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, in_order boolean, ended boolean"


def _text(x: str | None) -> str:
    return x or ""


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run  # no conversation yet
        state, turn = "start", 0
        for batch in batches:
            out: list[tuple] = []
            ids, roles, texts, last = (batch.column(i).to_pylist() for i in range(4))
            for conv_id, role, text, is_last in zip(ids, roles, texts, last, strict=True):
                if conv_id != conv:
                    conv, state, turn = conv_id, "start", 0
                role = _text(role)
                state = template.moves.get(state, {}).get(role, "out of order")
                ended = is_last and state in template.ends
                good = state != "out of order"
                opening = template.opening.replace("{role}", template.escape(role))
                for part, (x, loss) in enumerate(((opening, False), (template.escape(_text(text)), role in template.loss_roles), (template.closing, False))):
                    out.append((conv_id, turn, part, x, loss, good, ended))
                turn += 1
                if len(out) >= 3000:
                    yield _segments(out)
                    out = []
            if out:
                yield _segments(out)

    return run


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn_no", "part", "text", "loss", "in_order", "ended"])


def format_segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The formatted text of each conversation as segments, three a turn, with a loss flag on each.

    Turns stand by turn, then role, then text, nulls first; null text and null role are empty. Repeated rows are turns of their
    own. in_order is false on a turn that the state machine has no move for, and on all later ones; ended is true on the last
    turn of a conversation that may end there. Rows of a null conv_id are one conversation. Partitions hold whole
    conversations in order, so a later map over them may stream. Other columns are not read. An empty table gives an empty one.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # One conversation's order and digest are one sequence; it is sorted outside memory and streamed, never held.
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text", F.lit(True).alias("last")).mapInArrow(_marked_last, "conv_id long, role string, text string, last boolean").mapInArrow(_format(template), SEGMENTS)


def _marked_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """last is set where the next row is another conversation's; one batch is held back to know."""
    held = None

    def marked(batch: pa.RecordBatch, after: object) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        ends = [x != y for x, y in zip(ids, [*ids[1:], after], strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.bool_())], names=["conv_id", "role", "text", "last"])

    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            yield marked(held, batch.column(0)[0].as_py())
        held = batch
    if held is not None:
        yield marked(held, object())


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, ended boolean"


def _read_back(template: Template):
    """Parses the formatted text, as it comes, by its marks; of the segments' columns it uses text, loss and the flags."""
    role_mark, text_mark = template.opening.split("{role}")

    class Reader:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.left, self.role = conv_id, "", None
            self.turns = self.loss_chars = self.chars = 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()
            self.in_order, self.ended = True, False

        def take(self, text: str, loss: bool, in_order: bool, ended: bool) -> None:
            self.chars += len(text)
            self.in_order, self.ended = self.in_order and in_order, ended
            if loss:
                plain = template.unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
            self.left += text
            while True:
                if self.role is None:
                    if (at := self.left.find(text_mark)) < 0:
                        return
                    assert self.left.startswith(role_mark), "no turn starts here"
                    self.role, self.left = template.unescape(self.left[len(role_mark) : at]), self.left[at + len(text_mark) :]
                if (at := self.left.find(template.closing)) < 0:
                    return
                self.all.update(f"{self.role}\n{template.unescape(self.left[:at])}\n".encode("utf-8", "surrogatepass"))
                self.turns += 1
                self.role, self.left = None, self.left[at + len(template.closing) :]

        def row(self) -> tuple:
            assert self.role is None and not self.left, "the last turn is not closed"
            return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order, self.ended

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for conv_id, text, loss, in_order, ended in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conv_id)
                reader.take(text, loss, in_order, ended)
            if done:
                yield out(done)
        if reader is not None:
            yield out([reader.row()])

    return run


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row for each conversation of format_segments, parsed from the formatted text.

    n_turns, turns_sha256 (of role, line feed, text, line feed, for each turn), loss_chars and loss_sha256 (code points and
    digest of all unescaped text under the loss mask), formatted_chars, in_order, ended.
    """
    return segments.select("conv_id", "text", "loss", "in_order", "ended").mapInArrow(_read_back(template), DIGEST)
