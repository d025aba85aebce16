"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " body "\\n</turn>\\n"
    role         := User | Assistant | System | Tool | a JSON string
    body         := text in which "###" and "</turn>" stand only after a backslash, which is not part of the text

A turn is rendered as it is, read back by the parser, and if role and text are not the same, its control strings are
escaped by a backslash. Turns end themselves, so a conversation's rendering is its turns' renderings end to end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_ROLES = {v: k for k, v in NAMES.items()}
_CONTROL = re.compile(r"###|</turn>")
_ESCAPED = re.compile(r"\\(###|</turn>)")
_HEAD = re.compile(r'### (?:(User|Assistant|System|Tool)|(?="))')


def render_turn(role: str | None, text: str | None) -> str:
    """One turn; null role and null text count as empty."""
    role, text = role or "", text or ""
    name = NAMES.get(role) or json.dumps(role).replace("#", "\\u0023").replace("<", "\\u003c")
    for body in (text, _CONTROL.sub(r"\\\g<0>", text)):
        turn = f"### {name}: {body}\n</turn>\n"
        if _read(turn) == [(role, text)]:
            return turn
    raise ValueError("a turn can't be rendered so that it reads back the same")


def _read(text: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, body) for role, body, _ in parse(text)]
    except ValueError:
        return None


def parse(text: str) -> Iterator[tuple[str, str, int]]:
    """Turns of a rendering: role, text, and where the escaped text begins. ValueError where the grammar does not hold."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        at = head.end()
        if head[1]:
            role = _ROLES[head[1]]
        else:
            role, at = json.JSONDecoder().raw_decode(text, at)
        if not text.startswith(": ", at):
            raise ValueError(f"no role ends at {at}")
        at = begin = at + 2
        for m in _CONTROL.finditer(text, at):
            if m.start() == begin or text[m.start() - 1] != "\\":
                break
        else:
            raise ValueError("a turn does not end")
        if m[0] != "</turn>" or m.start() <= begin or text[m.start() - 1] != "\n" or not text.startswith("\n", m.end()):
            raise ValueError(f"a control string stands at {m.start()}")
        yield role, _ESCAPED.sub(r"\1", text[begin : m.start() - 1]), begin
        at = m.end() + 1


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, turn, segment, loss_start, loss_end: each turn's rendering, in order.

    A conversation's text is its segments end to end; the loss mask covers [loss_start, loss_end) of a segment's code
    points, the escaped text of an assistant's turn, and is empty for others. Conversations stay within a partition, in the
    order of turn, then role and text (nulls first), so a long conversation is streamed and never held whole. A null conv_id
    is one conversation; repeated rows are turns of their own.
    """
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([turns.schema["conv_id"], turns.schema["turn"], *[T.StructField(c, k) for c, k in (("segment", T.StringType()), ("loss_start", T.LongType()), ("loss_end", T.LongType()))]])

    def run(batches):
        for batch in batches:
            segments, start, end = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s = render_turn(role, text)
                a = len("### Assistant: ") if role == "assistant" else 0
                segments.append(s)
                start.append(a)
                end.append(len(s) - len("\n</turn>\n") if role == "assistant" else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=schema.names)

    return ordered.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from what format_conversations() returns, by parsing it again.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; must follow it without a shuffle between.
    """
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([formatted.schema["conv_id"], *[T.StructField(c, k) for c, k in fields]])

    def digests(rows: Iterable[tuple]):
        now, state = None, None
        for conv, segment, a, b in rows:
            if state is None or conv != now:
                if state:
                    yield now, state
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _ in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if b > a:
                loss = _ESCAPED.sub(r"\1", segment[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += len(segment)
        if state:
            yield now, state

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(4))))
        out: list[tuple] = []
        for conv, (n, turns, chars, loss, total) in digests(rows):
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) == 5_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[formatted.schema["conv_id"].dataType.simpleString()]
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    return formatted.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, schema)


def planted(spark) -> DataFrame:
    """Conversation -7: both turns hold the template's own control strings."""
    says = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")


def format_documents(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(planted(turns.sparkSession))
    return read_back(format_conversations(rows))
