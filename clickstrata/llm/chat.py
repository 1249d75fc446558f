"""Chat formatting from event logs.

An event is (conv_id, seq, message, kind, role, text). ``delta`` appends text to a message, ``edit``
replaces its text, ``regenerate`` drops the message's text and what later deltas bring is the new one. Events are
dealt by conversation and message and sorted by sequence, and each message is folded as a stream, whatever came in
between: an edit may be any number of messages late. Final messages are then dealt by conversation and sorted by
the place of their first event. Both sorts spill, and a worker holds one message at a time, so a conversation may be
of any length; a conversation's messages are in one partition, several conversations share one.

The template writes every message as ``<s>[ROLE] text </s>`` with role and text escaped: a backslash, ``<``,
``>``, ``[`` and ``]`` inside them become a backslash and a letter, so control strings never occur inside and
reading back is exact. The text of assistant messages is under the loss mask. A conversation is one text, its turns one
after the other; it is moved in pieces of ``PIECE`` characters, cut anywhere, each with its part of the mask. The reader
gets pieces and finds the turns by their marks.

Null text, role and kind are empty (an empty kind is a delta); a message's role is the first that is not empty; a
null message is one of its own; events without a conversation id form one conversation; null seq comes first; ties
in seq are ordered by kind, role and text, messages that begin at one seq by role and final text; repeated rows are
repeated turns of a table log, and repeated events of an event log; an empty log gives an empty result; very long
texts are moved whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = {"\\": "\\b", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_TO = str.maketrans(_ESCAPES)
_FROM = re.compile(r"\\[blgoc]")
_TURN = re.compile(r"<s>\[([^\[\]<>]*)\] ([^\[\]<>]*) </s>")
LOSS_ROLE = "assistant"
PIECE = 1 << 16
SCHEMA = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return text.translate(_TO)


def unescape(text: str) -> str:
    return _FROM.sub(lambda m: _BACK[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string and the loss range in it (empty range: none)."""
    head, body = f"<s>[{escape(role)}] ", escape(text)
    start = len(head)
    return f"{head}{body} </s>", start, start + (len(body) if role == LOSS_ROLE else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def table_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log that a client would have sent: each row is a message of its own.

    A third of the turns each is streamed in two deltas, edited from a draft, and generated again after one.
    """
    text, seq = F.coalesce(F.col("text"), F.lit("")), F.col("turn").cast("long") * 4
    half = (F.length(text) / 2).cast("int")
    event = lambda k, kind, words: F.struct(
        (seq + k).alias("seq"),
        F.lit(kind).alias("kind"),
        F.lit(words).alias("text") if isinstance(words, str) else words.alias("text"),
    )
    streamed = F.array(event(0, "delta", F.substring(text, F.lit(1), half)), event(1, "delta", F.substring(text, half + 1, F.length(text))))
    edited = F.array(event(0, "delta", "a draft"), event(1, "edit", text))
    again = F.array(event(0, "delta", "a draft"), event(1, "regenerate", ""), event(2, "delta", text))
    kind = F.pmod(F.coalesce(F.col("turn").cast("long"), F.lit(0)), F.lit(3))
    events = F.when(kind == 0, streamed).when(kind == 1, edited).otherwise(again)
    numbered = conversations.select("conv_id", F.monotonically_increasing_id().alias("message"), "role", events.alias("events"))
    rows = numbered.select("conv_id", "message", "role", F.explode("events").alias("event"))
    return rows.select("conv_id", "event.seq", "message", "event.kind", "role", "event.text")


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def fold(events) -> Iterator[tuple]:
    """(conv_id, seq, role, text) of final messages, seq that of the first event, from (conv_id, message, seq, kind, role, text) sorted by the first three; holds one message."""
    now, first, role, parts = None, None, "", []
    for conv, message, seq, kind, who, text in events:
        if now is None or message is None or now != (conv, message):
            if now is not None:
                yield now[0], first, role, "".join(parts)
            now, first, role, parts = (conv, message), seq, "", []
        role = role or who or ""
        if kind in ("edit", "regenerate"):
            parts.clear()
        if text:
            parts.append(text)
    if now is not None:
        yield now[0], first, role, "".join(parts)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    columns: list[list] = [[] for _ in schema]
    held = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(columns[0]) >= 4096 or held > 1 << 22:
            yield out()
            columns, held = [[] for _ in schema], 0
    if columns[0]:
        yield out()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _batched(fold(_rows(batches)), schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now, turn = object(), 0
    for conv, _, role, text in _rows(batches):
        turn = turn + 1 if conv == now else 0
        now = conv
        yield conv, turn, role, *render(role, text)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("formatted", pa.string()),
            ("loss_start", pa.int64()),
            ("loss_end", pa.int64()),
        ]
    )
    return _batched(_turns(batches), schema)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, seq (of the first event), role, text: one row a final message."""
    kinds = {"conv_id": "long", "message": "long", "seq": "long", "kind": "string", "role": "string", "text": "string"}
    keyed = events.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    own = F.when(F.col("message").isNull(), F.xxhash64("seq", "text"))  # messages without a number are spread too
    return (
        keyed.repartition("conv_id", "message", own)
        .sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
        .mapInArrow(_folded, "conv_id long, seq long, role string, text string")
    )


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end: one row a final message, each conversation's in order within its partition."""
    return messages(events).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").mapInArrow(_formatted, SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(conv_id, piece, text, loss) from rows of turns: pieces of each conversation's one text, with the ranges in them under the mask."""
    now, held, length, mask, piece = None, [], 0, [], 0

    def pieces(last: bool) -> Iterator[tuple]:
        nonlocal held, length, mask, piece
        text = "".join(held)
        at = 0
        while length - at >= size or last and at < length:
            end = min(at + size, length)
            inside = [{"start": max(a, at) - at, "stop": min(b, end) - at} for a, b in mask if a < end and b > at]
            yield now[0], piece, text[at:end], inside
            at, piece = end, piece + 1
        held, length = [text[at:]], length - at
        mask = [(max(a - at, 0), b - at) for a, b in mask if b > at]

    for conv, _, _, formatted, a, b in _rows(batches):
        if now != (conv,):
            if now:
                yield from pieces(True)
            now, held, length, mask, piece = (conv,), [], 0, [], 0
        if b > a:
            mask.append((length + a, length + b))
        held.append(formatted)
        length += len(formatted)
        if length >= size:
            yield from pieces(False)
    if now:
        yield from pieces(True)


def texts(formatted: DataFrame, size: int = PIECE) -> DataFrame:
    """conv_id, piece, text, loss: each conversation of format_log()'s rows as one text, in pieces, in its partitions and order."""
    loss = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss", loss)])
    cut = lambda batches: _batched(_cut(batches, size), schema)
    return formatted.mapInArrow(cut, "conv_id long, piece long, text string, loss array<struct<start:bigint,stop:bigint>>")


class Reader:
    """Reads a conversation from its pieces: turns by their marks, and the text under the mask. Holds a turn and a piece at most."""

    def __init__(self):
        self.n_turns, self.chars, self.loss_chars, self.rest, self.cut = 0, 0, 0, "", ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        begin = max(0, len(self.rest) - len("</s>") + 1)
        self.rest += text
        while (end := self.rest.find("</s>", begin)) >= 0:
            for role, words in parse(self.rest[: end + 4]):
                self.n_turns += 1
                self.turns.update(f"{role}\n{words}\n".encode())
            self.rest, begin = self.rest[end + 4 :], 0
        for part in loss:
            masked = self.cut + text[part["start"] : part["stop"]]
            self.cut = "\\" if len(masked) - len(masked.rstrip("\\")) & 1 else ""  # an escape that goes on in the next piece
            told = unescape(masked[: len(masked) - len(self.cut)])
            self.loss_chars += len(told)
            self.loss.update(told.encode())

    def row(self, conv) -> tuple:
        if self.rest or self.cut:
            raise ValueError(f"conversation {conv} ends within a turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now, reader = None, Reader()
    for conv, _, text, loss in _rows(batches):
        if now != (conv,):
            if now:
                yield reader.row(now[0])
            now, reader = (conv,), Reader()
        reader.feed(text, loss)
    if now:
        yield reader.row(now[0])


def digests(formatted: DataFrame, size: int = PIECE) -> DataFrame:
    """Read back from the conversations' texts."""
    types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    read = lambda batches: _batched(_read(batches), pa.schema(list(types.items())))
    return texts(formatted, size).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
