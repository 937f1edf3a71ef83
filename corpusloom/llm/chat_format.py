"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  What a turn renders to is parsed
again by the reader's own deterministic parser; where the recovered turn isn't the
source, its text and then its role are escaped, until both are identical.  Escaping
puts a backslash after the ``<`` of whatever reads as a control string, escaped or
not, so it can be undone and leaves all other text as it is.

Conversations stream through tasks in order and leave as pieces of whole turns, so
none has to fit into memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A piece of a formatted conversation is closed once it has this many characters.
PIECE = 1 << 16
LEARNED = "assistant"

_CONTROL = re.compile(r"<\|im_(?:start|end)\|>")
_TEXT = re.compile(r"<(\\*)(\|im_(?:start|end)\|>)")
# A role ends at its line's end, so line ends in it are written as <|nl|>.
_ROLE = re.compile(r"<(\\*)(\|(?:im_start|im_end|nl)\|>)")
_NEW_LINE = "<|nl|>"


def escape(text: str, marks: re.Pattern = _TEXT) -> str:
    return marks.sub(r"<\1\\\2", text)


def unescape(text: str, marks: re.Pattern = _TEXT) -> str:
    return marks.sub(lambda m: f"<{m[1][1:]}{m[2]}", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role, _ROLE).replace("\n", _NEW_LINE)


def unescape_role(role: str) -> str:
    return unescape(role.replace(_NEW_LINE, "\n"), _ROLE)


class Broken(ValueError):
    """The text isn't a row of turns."""


def reparse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the text's bounds in ``formatted``.

    Every step is decided by what stands at one place, so a row of turns has one reading.
    """
    at = 0
    while at < len(formatted):
        head = formatted.find("\n", at)
        if not formatted.startswith(START, at) or head < 0:
            raise Broken(f"no turn begins at {at}")
        role = formatted[at + len(START) : head]
        mark = _CONTROL.search(formatted, head + 1)
        if _CONTROL.search(role) or mark is None or mark[0] != END or not formatted.startswith("\n", mark.end()):
            raise Broken(f"the turn at {at} doesn't end")
        yield unescape_role(role), unescape(formatted[head + 1 : mark.start()]), head + 1, mark.start()
        at = mark.end() + 1


def _holds(formatted: str, role: str, text: str) -> bool:
    try:
        return [turn[:2] for turn in reparse(formatted)] == [(role, text)]
    except Broken:
        return False


def render(role: str, text: str) -> str:
    """The turn, escaped as far as reading it back needs."""
    for as_text, as_role in ((text, role), (escape(text), role), (text, escape_role(role)), (escape(text), escape_role(role))):
        formatted = f"{START}{as_role}\n{as_text}{END}\n"
        if _holds(formatted, role, text):
            return formatted
    raise AssertionError("escaped turns read back as they were")


def _formatted(kind: pa.DataType, learned: str):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", kind), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", spans)])

    def piece(conv, number: int, turns: list[tuple[str, str]], parts: list[str]) -> tuple:
        formatted = "".join(parts)
        read = list(reparse(formatted))
        if [r[:2] for r in read] != turns:  # turns that read back alone do so in a row
            raise AssertionError("the formatted turns read back differently")
        return conv, number, formatted, [{"start": a, "end": b} for role, _, a, b in read if role == learned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, turns, parts, size, out = None, 0, [], [], 0, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if turns and (c != conv or size >= PIECE):
                    out.append(piece(conv, number, turns, parts))
                    number, turns, parts, size = number + 1, [], [], 0
                if c != conv:
                    number = 0
                conv = c
                turns.append((role, text))
                parts.append(render(role, text))
                size += len(parts[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if turns:
            out = [piece(conv, number, turns, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED) -> DataFrame:
    """conv_id, piece, formatted, loss: each conversation's turns as text, in pieces of whole turns.

    ``loss`` has the bounds, in the piece's code points, of the texts said by
    ``learned``, without their marks.  Turns are taken by turn (null first), role and
    text; rows that repeat one are turns too.  A null role or text is empty; a null
    conv_id names a conversation like any other.  An empty table gives no rows.  A
    conversation's pieces follow each other in one partition, in order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    kind = turns.schema["conv_id"].dataType
    sorted_ = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return sorted_.mapInArrow(_formatted(to_arrow_type(kind), learned), f"conv_id {kind.simpleString()}, piece long, formatted string, loss array<struct<start: long, end: long>>")


class _Reader:
    """What one conversation's pieces read back as."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text, _, _ in reparse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv, number, formatted, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "piece", "formatted", "loss"))):
                if number == 0:
                    if reader:
                        out.append(reader.row())
                    reader = _Reader(conv)
                reader.add(formatted, loss)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.row(), schema.types)], schema=schema)

    return run


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from :func:`format_chats`' rows in their order.

    All is read from the formatted text: the turns by the parser, the loss by its
    bounds.  A digest of turns has ``role``, a line end, ``text`` and a line end each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pieces.schema["conv_id"].dataType
    return pieces.mapInArrow(_read_back(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
