"""Chat formatting: a finite-state machine over roles checks turn order and a declarative template emits segments.

A segment is a piece of the formatted text with one loss flag. Control strings of the template inside texts are
escaped reversibly: the backslash is doubled, and one is put after the first character of a control string, so that
a reader never takes a text for a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text


@dataclass(frozen=True)
class Template:
    """Turn markers by role, the roles whose texts bear loss, and the allowed successions of roles."""

    marks: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[ROLE=", "]", " [/ROLE]")
    loss: tuple = ("assistant",)
    start: str = "begin"
    moves: dict = field(default_factory=lambda: {("begin", "system"): "ready", ("begin", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple = ("answered",)

    @property
    def controls(self) -> list[str]:
        marks = {m.strip() for pair in self.marks.values() for m in pair} | {m.strip() for m in (self.other[0], self.other[2])}
        return sorted(marks, key=lambda m: (-len(m), m))

    def escape(self, text: str) -> str:
        pattern = "|".join(map(re.escape, ["\\", "]", *self.controls]))
        return re.sub(pattern, lambda m: "\\" + m[0] if len(m[0]) == 1 else m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        """A backslash stands before a single character that would read as control, or breaks a control string."""
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.marks:
            head, tail = self.marks[role]
        else:
            head, tail = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(head, False), (self.escape(text), role in self.loss), (tail, False)]

    def read(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, (head, tail) in self.marks.items():
            if turn.startswith(head) and turn.endswith(tail):
                return role, self.unescape(turn[len(head) : len(turn) - len(tail)])
        head, mid, tail = self.other
        m = re.match(re.escape(head) + r"((?:[^\\\]]|\\.)*)" + re.escape(mid), turn, re.S)
        if not m or not turn.endswith(tail):
            raise ValueError(f"not a turn: {turn[:40]!r}")
        return self.unescape(m[1]), self.unescape(turn[m.end() : len(turn) - len(tail)])


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of every conversation, in order: conv_id, turn_no, segment, role, text, loss, valid, state.

    valid: the state machine accepts all turns up to this one; state: where it stands after the turn ("broken" once a
    turn isn't allowed). Turns are ordered by turn, ties by role and text, null turns first; repeated rows are turns
    of their own. A conversation is one stream by nature and so one task, but its rows are sorted outside of memory
    and pass one turn at a time, so its length isn't bounded by memory. Null roles and texts count as empty, rows
    with a null conversation form one conversation, unknown roles get the general marks and are not valid. An empty
    table gives none. Other columns of df aren't looked at.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, no, state, first = None, 0, t.start, True
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column("conv_id").to_pylist(), as_text(batch.column("role")), as_text(batch.column("text"))):
                if first or c != conv:
                    conv, no, state, first = c, 0, t.start, False
                state = t.moves.get((state, role), "broken")
                out += [(c, no, k, role, s, loss, state != "broken", state) for k, (s, loss) in enumerate(t.segments(role, text))]
                no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()))], ["conv_id", "turn_no", "segment", "role", "text", "loss", "valid", "state"])

    return _ordered(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, turn_no long, segment int, role string, text string, loss boolean, valid boolean, state string")


def digest_chat(segments: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """Read formatted conversations back from their segments: one row of counts and digests per conversation.

    valid: the state machine accepts all turns and ends in a final state. in_order: the rows are format_chat's own,
    not yet written or moved, so they needn't be sorted again; a segment out of order raises all the same. Segments
    with a null conversation are one conversation; an empty table gives none; other columns aren't looked at.
    """
    t = template or Template()
    if not in_order:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, buffer, next_ = None, "", 0
        for batch in batches:
            done = []
            for c, no, k, s, loss, ok, state in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn_no", "segment", "text", "loss", "valid", "state"))):
                if conv is None or c != conv[0]:
                    if conv:
                        done.append(conv)
                    conv, buffer, next_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True], "", 0
                if (no, k) != (conv[1], next_):
                    raise ValueError(f"segment {k} of turn {no} is out of order or there twice")
                next_ = (k + 1) % 3
                buffer = s if k == 0 else buffer + s
                conv[5] += len(s)
                conv[6] = ok and state in t.final
                if loss:
                    plain = t.unescape(s)
                    conv[3] += len(plain)
                    conv[4].update(plain.encode())
                if k == 2:
                    role, text = t.read(buffer)
                    conv[1] += 1
                    conv[2].update(f"{role}\n{text}\n".encode())
            if done:
                yield rows(done)
        if conv:
            yield rows([conv])

    def rows(done: list) -> pa.RecordBatch:
        flat = [[c, n, a.hexdigest(), x, b.hexdigest(), y, ok] for c, n, a, x, b, y, ok in done]
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*flat), kinds)], names)

    columns = segments.select("conv_id", "turn_no", "segment", "text", "loss", "valid", "state")
    return columns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
