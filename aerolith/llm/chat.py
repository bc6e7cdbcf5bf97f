"""Event-sourced chat reconstruction and rendering.

A log of events is dealt by conversation and sorted by sequence. One pass folds
the events of a message into its final text:

    message     a whole message
    delta       text that is appended to the message
    edit        text that replaces what the message has
    regenerate  the message starts again from this text

and renders each final message as one segment. Segments of a conversation in
order, joined, are its formatted text, so a conversation of any length needs
the memory of one message. A conversation is read by one task, in order and a
batch at a time, as the digest of all its turns has to be.

The template puts a turn between ``<|im_start|>role`` and ``<|im_end|>``.
Inside texts and roles a backslash is put before the bar of every ``<``,
backslashes, ``|``; taking one away reads the text back, whatever it holds.

Defined cases: a null text counts as empty, a null role as the empty role, a
null kind as ``message``; a null conversation is one of its own; null sequences
come first; a message stands where its first event does, however late others
come; events of the same sequence are taken in order of message, kind, role and
text; repeated rows are events of their own; a text of any length is one event;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.workers import tidy

#: The template.
START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
SEGMENTS = "conv_id long, message_no long, role string, segment string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_MARK = regex.compile(r"<(\\*)\|")
_UNMARK = regex.compile(r"<\\(\\*)\|")
_TURN = regex.compile(regex.escape(START) + r"(.*?)\n(.*?)" + regex.escape(END) + r"\n", regex.DOTALL)
_COLUMNS = ("conv_id", "seq", "message", "kind", "role", "text")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNMARK.sub(r"<\1|", text)


def _role(role: str) -> str:
    """Roles stand on one line: a backslash is doubled and a line end is a backslash and n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether it is under the loss mask) of each turn of a formatted text."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        role = _unrole(m[1])
        yield role, unescape(m[2]), role == TRAINED
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at} on")


#: Places in the sequence between two turns: for the events of up to 2**27 rows of one turn.
_TURN_ROOM = 1 << 32


def events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log of a chat that ends in them.

    By the conversation's and the turn's number a row comes as a whole message,
    as a start and a delta, as a draft that an edit replaces after the next turn,
    or as a draft that is regenerated from deltas. Rows of the same turn are
    messages of their own, in order of role and text.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 30)))
    own = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.row_number().over(own))
    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring(text, half + 1, F.length("text"))
    at = turn * _TURN_ROOM + F.col("row") * 16

    def log(*given: tuple) -> Column:
        return F.array(*(F.struct((at + k + late).alias("seq"), F.lit(kind).alias("kind"), part.alias("text")) for k, (kind, part, late) in enumerate(given)))

    how = F.pmod(F.coalesce("conv_id", F.lit(0)) + turn, F.lit(4))
    told = (
        F.when(how == 0, log(("message", text, 0)))
        .when(how == 1, log(("message", head, 0), ("delta", tail, 0)))
        .when(how == 2, log(("delta", tail, 0), ("edit", text, _TURN_ROOM + 8)))
        .otherwise(log(("delta", tail, 0), ("delta", head, 0), ("regenerate", F.lit(""), 0), ("delta", head, 0), ("delta", tail, 0)))
    )
    rows = rows.select("conv_id", "role", at.alias("message"), F.explode(told).alias("e"))
    return rows.select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(conversation, role, final text) of each message, from events that are sorted by conversation and sequence.

    Events of one message follow each other; a null message is one event's own.
    """
    open_: list | None = None  # conversation, message, role, parts
    for b in batches:
        for conv, _, message, kind, role, text in zip(*(b.column(c).to_pylist() for c in _COLUMNS), strict=True):
            kind, text = kind or "message", text or ""
            if open_ is not None and message is not None and open_[:2] == [conv, message]:
                if kind == "delta":
                    open_[3].append(text)
                else:
                    open_[3] = [text]
                open_[2] = role if role is not None else open_[2]
                continue
            if open_ is not None:
                yield open_[0], open_[2] or "", "".join(open_[3])
            open_ = [conv, message, role, [text]]
    if open_ is not None:
        yield open_[0], open_[2] or "", "".join(open_[3])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, last, no = 0, object(), 0
    names = ["conv_id", "message_no", "role", "segment"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for conv, role, text in _fold(batches):
        no = no + 1 if conv == last else 0
        last = conv
        rows.append((conv, no, role, render(role, text)))
        size += len(text)
        if len(rows) >= 10_000 or size >= 8 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def with_first(log: DataFrame) -> DataFrame:
    """Add where each message began, so that late edits sort beside their message."""
    began = log.where(F.col("message").isNotNull()).groupBy("conv_id", "message").agg(F.min("seq").alias("first"))
    return (
        log.alias("l")
        .join(began.alias("b"), (F.col("l.conv_id").eqNullSafe(F.col("b.conv_id"))) & (F.col("l.message") == F.col("b.message")), "left")
        .select(*(F.col(f"l.{c}").alias(c) for c in _COLUMNS), F.coalesce("b.first", "l.seq").alias("first"))
    )


def reconstruct(log: DataFrame) -> DataFrame:
    """Segments (conv_id, message_no, role, segment) of all conversations in a log with _COLUMNS."""
    keyed = with_first(log).select(*_COLUMNS, "first")
    dealt = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "first", "message", "seq", "kind", "role", "text")
    return dealt.select(*_COLUMNS).mapInArrow(tidy(_segments), SEGMENTS)


#: Segments of a row of formatted text.
PART = 1000


def formatted(segments: DataFrame) -> DataFrame:
    """Formatted text in rows (conv_id, part, formatted) of PART segments each: a conversation's parts in order, joined, are its text."""
    parts = segments.groupBy("conv_id", F.floor(F.col("message_no") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("message_no", "segment"))).alias("p"))
    return parts.select("conv_id", "part", F.concat_ws("", F.transform("p", lambda x: x["segment"])).alias("formatted"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read segments back, in order, and digest each conversation while it passes by."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    conv, state = None, None

    def close() -> None:
        if state is not None:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for b in batches:
        for c, segment in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist(), strict=True):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, trained in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if trained:
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(segment)
        if len(out) >= 10_000:
            yield batch()
    close()
    yield batch()


def digest(segments: DataFrame) -> DataFrame:
    """Per conversation: turns, loss text and length, read back from segments that come in order."""
    return segments.mapInArrow(tidy(_digest), DIGESTS)
