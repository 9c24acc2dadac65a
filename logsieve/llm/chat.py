"""Conversations as text with loss flags: a state machine over roles and a declarative template.

Turns are read as sorted streams, so a conversation of any length needs memory for one turn.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """A turn is open + role + "\\n" + text + close. `reserved`: further strings that no text may contain."""

    open: str = "<|turn|>"
    close: str = "<|end|>\n"
    reserved: tuple[str, ...] = ("<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)
    #: the states of the machine: which role may come after which; "" is the start
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({self.open, self.close.strip(), *self.reserved}, key=lambda s: (-len(s), s))


class Writer:
    """Text of turns and back. A backslash before a character means that character itself; control strings are broken up
    by one after their first character, so none of them is left in an escaped text."""

    def __init__(self, template: Template):
        self.template = template
        self.start = re.compile(f"(?=(?:{'|'.join(map(re.escape, template.controls()))}))(.)", re.S)
        self.turn = re.compile(f"{re.escape(template.open)}((?:\\\\.|[^\\\\\n])*)\n((?:\\\\.|[^\\\\])*?){re.escape(template.close)}", re.S)

    def escape(self, text: str) -> str:
        return self.start.sub(r"\1\\", text.replace(ESCAPE, ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def pieces(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) segments of a turn."""
        head = self.template.open + self.escape(role).replace("\n", ESCAPE + "\n") + "\n"
        return [(head, False), (self.escape(text), role in self.template.learned), (self.template.close, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        found = self.turn.fullmatch(formatted)
        if found is None:
            raise ValueError("not a turn of this template")
        return self.unescape(found[1]), self.unescape(found[2])


class RoleMachine:
    """Follows the roles of one conversation; `step` says whether a turn may stand where it stands."""

    def __init__(self, template: Template):
        self.template, self.state = template, ""

    def step(self, role: str) -> bool:
        allowed = role in self.template.follows.get(self.state, ())
        self.state = role
        return allowed

    def finished(self) -> bool:
        return self.state in self.template.ends


SEGMENTS = "segments array<struct<text:string,loss:boolean>>"


def _formatting(template: Template):
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        writer, machine, current, number = Writer(template), RoleMachine(template), object(), 0
        for batch in batches:
            rows, numbers, allowed, ends = [], [], [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != current:
                    machine, current, number = RoleMachine(template), conv, 0
                role, text = role or "", text or ""
                allowed.append(machine.step(role))
                ends.append(machine.finished())
                rows.append([{"text": t, "loss": loss} for t, loss in writer.pieces(role, text)])
                numbers.append(number)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(rows, kind), pa.array(allowed, pa.bool_()), pa.array(ends, pa.bool_())],
                ["conv_id", "number", "segments", "in_order", "may_end"],
            )

    return run


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: conv_id, number (from 0 without gaps), segments (text, loss), in_order and may_end.

    A conversation's text is its segments one after the other. Turns are taken by `turn`, nulls first; ties by role and
    text, so repeated rows are repeated turns. Null texts and roles are empty; roles outside the machine are written and
    are not in order. Turns that are not in order are flagged, not dropped; a conversation is valid if all its turns are
    in order and the last one may end it. Rows with a null conv_id form one conversation. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatting(template or Template()), f"conv_id long, number long, {SEGMENTS}, in_order boolean, may_end boolean")


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _reading(template: Template):
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        writer = Writer(template)
        state, current = None, None

        def result():
            turns, learned, n, loss, chars, valid, end = state
            return current, n, turns.hexdigest(), loss, learned.hexdigest(), chars, valid and end

        for batch in batches:
            done = []
            for conv, segments, in_order, may_end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(result())
                    state, current = [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, False], conv
                formatted = "".join(s["text"] for s in segments)
                role, text = writer.read(formatted)
                learned = writer.unescape("".join(s["text"] for s in segments if s["loss"]))
                state[0].update(f"{role}\n{text}\n".encode())
                state[1].update(learned.encode())
                state[2] += 1
                state[3] += len(learned)
                state[4] += len(formatted)
                state[5] = state[5] and in_order
                state[6] = may_end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(result(), types, strict=True)], names)

    return run


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from the segments that `format_conversations` wrote.

    n_turns, the hash of roles and texts, length and hash of all text under the loss mask, length of the formatted text
    and whether the conversation is valid. Takes the rows in their order within partitions; rows that were stored are
    dealt and sorted anew by (conv_id, number) before.
    """
    return formatted.mapInArrow(_reading(template or Template()), SUMMARY)
