"""Chat formatting with a grammar round trip.

The grammar of a formatted conversation is a row of turns, each ``[role]text[/role]`` and a line end.  The roles
user, assistant and system are marked INST, OUT and SYS; any other role's mark is ``ROLE:`` and its escaped name.
Text that could be read as a mark, or as a mark under escapes, gets one backslash after its bracket; taking one
backslash away there is the inverse.  A turn is first rendered as it is, reparsed, and only if the parser doesn't
return the turn itself is its conflicting content escaped (and reparsed again).

Turns are rendered in parallel.  A conversation of any length is then read in turn order as a stream of its rows,
so no task ever holds a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage

MARKS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
ROLES = {v: k for k, v in MARKS.items()}
LOSS_ROLE = "assistant"
# Control strings: this grammar's marks, and those of common chat templates, which readers of the output may act on.
_CONTROL = re.compile(r"(?:(?<=\[)|(?<=<))(\\*)(?=/?(?:INST|OUT|SYS|ROLE:[^\[\]\n]*)\]|/?s>|/?SYS>>|\|[a-z_]+\|>)")
_ESCAPED = re.compile(r"(?:(?<=\[)|(?<=<))\\(\\*)(?=/?(?:INST|OUT|SYS|ROLE:[^\[\]\n]*)\]|/?s>|/?SYS>>|\|[a-z_]+\|>)")
_NAME = re.compile(r"[\\\[\]\n/]")
_TURN = re.compile(r"\[(INST|OUT|SYS|ROLE:[^\[\]\n]*)\](.*?)\[/\1\]\n", re.DOTALL)


class GrammarError(ValueError):
    """Text that is no row of turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _mark(role: str) -> str:
    return MARKS.get(role) or "ROLE:" + _NAME.sub(lambda m: f"\\{ord(m[0]):02x}", role)


def _role(mark: str) -> str:
    return ROLES.get(mark) or re.sub(r"\\(..)", lambda m: chr(int(m[1], 16)), mark[5:])


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the stored text) of each turn; the whole of ``formatted`` must be turns."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise GrammarError(f"no turn at {at}")
        turns.append((_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str | None, text: str | None) -> tuple[str, bool]:
    """A turn in the grammar, and whether its text had to be escaped; nulls count as empty."""
    role, text = role or "", text or ""
    mark = _mark(role)
    plain = f"[{mark}]{text}[/{mark}]\n"
    if not _CONTROL.search(text):
        if [x[:2] for x in parse(plain)] == [(role, text)]:
            return plain, False
    safe = f"[{mark}]{escape(text)}[/{mark}]\n"
    if [x[:2] for x in parse(safe)] != [(role, text)]:
        raise GrammarError(f"turn of role {role!r} does not come back")
    return safe, True


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render each turn and prove its round trip: conv_id, turn, formatted, escaped.

    A conversation's text is its turns' ``formatted`` joined by turn.  A null text or role is empty; repeated rows are
    turns of their own; an empty table gives no row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(role.as_py(), text.as_py()) for role, text in zip(batch.column("role"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.bool_())], names=["conv_id", "turn", "formatted", "escaped"])

    named = turns.select(storage.col(conv_col).cast("long").alias("conv_id"), storage.col(turn_col).cast("long").alias("turn"), storage.col(role_col).alias("role"), storage.col(text_col).alias("text"))
    return storage.map_batches(named, run, "conv_id long, turn long, formatted string, escaped boolean")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.escaped = 0

    def add(self, formatted: str) -> None:
        for role, text, start, end in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
            self.n += 1
            self.escaped += end - start != len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.escaped


def audit_conversations(formatted: DataFrame) -> DataFrame:
    """Reparse formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped_turns.

    The loss mask covers the assistant's texts; turns of the same number follow each other by their text.  A null or empty
    ``formatted`` holds no turn; repeated rows are turns of their own; rows of a null conversation are one; an empty table
    gives no row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"])

        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, *digest.row()))
                    current, digest = conv, _Digest()
                digest.add(text.as_py() or "")
            if len(done) >= 4096:
                yield out()
        if digest is not None:
            done.append((current, *digest.row()))
            yield out()

    ordered = formatted.select("conv_id", "turn", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return storage.map_batches(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long")


def formatted_table(turns: DataFrame) -> DataFrame:
    """``format_turns`` written as a table in the shared folder, and read back."""
    return storage.materialize(format_turns(turns), "chat")
