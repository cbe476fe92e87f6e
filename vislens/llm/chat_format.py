"""Conversations as marked-up text with a loss mask.

A template declares, for each role, the marks around a turn and whether its text
is trained on, and which role may follow which. A finite-state machine walks the
turns of a conversation in order, judges the order and emits segments; marks and
texts are separate segments, each with its own loss flag. Control strings inside
texts, and the escape itself, are escaped, so the segments laid end to end can be
read back to the turns.

Both directions stream over rows sorted by conversation and place: no
conversation is ever gathered, only its running state is held.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, ANY = "", "*"


@dataclass(frozen=True)
class Template:
    """Marks (open, close) and loss by role; ANY serves roles not named, its open mark ends where the escaped role name begins."""

    marks: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
            ANY: ("[ROLE]", "[/TURN]", False),
        }
    )
    name_end: str = "[/ROLE]"
    escape: str = "\\"
    #: roles that may come next, by the role before
    follows: dict = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: roles that may come last
    last: tuple = ("user", "assistant")

    def controls(self) -> list[str]:
        """Longest first, so that no control string is taken for its beginning."""
        found = {x for a, b, _ in self.marks.values() for x in (a, b)} | {self.name_end}
        return sorted(found, key=lambda x: (-len(x), x))

    def pattern(self) -> str:
        return "|".join(re.escape(x) for x in [self.escape, *self.controls()])

    def escaped(self, text: str) -> str:
        return re.sub(self.pattern(), lambda m: self.escape + m.group(), text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self.pattern()})", r"\1", text)


SEGMENTS = "conv_id {kind}, seq bigint, kind string, text string, loss boolean, error string"


def format_conversations(rows: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq, kind, text, loss, error): the segments of every conversation, sorted within partitions.

    kind is open, name, text or close. error is null, or says on the open segment
    of the first turn that may not stand there what is wrong; on the last segment
    "unfinished" if the conversation may not end so. Wrong conversations are
    formatted all the same. Turns go by (turn, role, text), nulls first, so ties
    and repeated rows have a place; a null role or text counts as empty, a null
    conv_id is a conversation. Other columns are not read.
    """
    template = template or Template()
    kind = rows.schema[conv_id].dataType.simpleString()
    parts = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "seq", "kind", "text", "loss", "error"]

    def run(batches):
        here, state, bad, seq, held = None, START, None, 0, None
        begun = False
        out: list[list] = [[] for _ in names]

        def put(*values):
            for column, v in zip(out, values):
                column.append(v)

        def end():
            # the close segment of the last turn, held back until it is known to be the last
            if held is not None:
                put(here, held[0], "close", held[1], False, "unfinished" if state not in template.last else None)

        def block(id_type):
            made = pa.record_batch([pa.array(out[0], id_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.string())], names=names)
            for column in out:
                column.clear()
            return made

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for conv, who, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not begun or conv != here:
                    if begun:
                        end()
                    here, state, bad, seq, held, begun = conv, START, None, 0, None, True
                elif held is not None:
                    put(here, held[0], "close", held[1], False, None)
                error = None
                if bad is None and who not in template.follows.get(state, ()):
                    error = bad = f"{who or '(none)'} after {state or '(start)'}"
                named = who in template.marks and who != ANY
                open_, close, loss = template.marks[who if named else ANY]
                put(here, seq, "open", open_, False, error)
                seq += 1
                if not named:
                    put(here, seq, "name", template.escaped(who) + template.name_end, False, None)
                    seq += 1
                put(here, seq, "text", template.escaped(said), loss, None)
                held = (seq + 1, close)
                seq += 2
                state = who
            yield block(id_type)
        if begun:
            end()
            yield block(id_type)

    return parts.mapInArrow(run, SEGMENTS.format(kind=kind))


def read_conversations(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid): what segments laid end to end say.

    `segments` must come sorted by (conv_id, seq) with a conversation in one
    partition, as `format_conversations` gives them; `sorted_segments` restores
    that for segments read from a table. Turns are found by the control strings in
    the text alone; the segments' kinds are not used. A text that is no sequence
    of turns raises an error.
    """
    template = template or Template()
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    opens = {a: (role, b) for role, (a, b, _) in template.marks.items()}
    escape = re.escape(template.escape)
    token = re.compile(f"{escape}(?:{template.pattern()})|" + "|".join(map(re.escape, template.controls())), re.S)

    class Reader:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars, self.valid = conv, 0, 0, 0, True
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()
            self.role, self.close, self.named = None, None, False

        def feed(self, text, loss, error):
            self.chars += len(text)
            self.valid &= error is None
            at = 0
            for m in token.finditer(text):
                self.take(text[at : m.start()], loss)
                at = m.end()
                mark = m.group()
                if mark.startswith(template.escape):
                    self.take(mark[len(template.escape) :], loss)
                elif self.close is None and mark in opens:
                    role, self.close = opens[mark]
                    self.named = role == ANY
                    self.role = "" if self.named else role
                    if not self.named:
                        self.all.update(f"{role}\n".encode())
                elif self.named and mark == template.name_end:
                    self.named = False
                    self.all.update(f"{self.role}\n".encode())
                elif mark == self.close and not self.named:
                    self.all.update(b"\n")
                    self.turns += 1
                    self.close = None
                else:
                    raise ValueError(f"conversation {self.conv}: {mark} does not belong here")
            self.take(text[at:], loss)

        def take(self, text, loss):
            if not text:
                return
            if self.close is None:
                raise ValueError(f"conversation {self.conv}: text outside of turns")
            if self.named:
                self.role += text
            else:
                self.all.update(text.encode())
                if loss:
                    self.loss.update(text.encode())
                    self.loss_chars += len(text)

        def row(self):
            if self.close is not None:
                raise ValueError(f"conversation {self.conv}: its last turn does not end")
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

    def run(batches):
        reader, id_type, done = None, None, []

        def block():
            columns = list(zip(*done)) or [[] for _ in names]
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for conv, text, loss, error in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conv)
                reader.feed(text, loss, error)
            yield block()
            done = []
        if reader is not None:
            done.append(reader.row())
            yield block()

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return segments.select("conv_id", "text", "loss", "error").mapInArrow(run, schema)


def sorted_segments(segments: DataFrame) -> DataFrame:
    """Segments from a table, each conversation in one partition and in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
