"""Chat formatting: message logs folded into final messages, rendered with marked turns and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

START, END = "<|im_start|>", "<|im_end|>"
#: Events that begin a message's text anew, and the one that goes on with it.
RESETS, DELTA = ("message", "edit", "regenerate"), "delta"
#: Characters after which a conversation goes on in another segment.
SEGMENT_CHARS = 1 << 20
LOSS_ROLE = "assistant"


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id", kind: str = "kind",
                role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text): the final messages of an event log.

    Events of one conversation and message are taken by ``seq``: ``message``, ``edit`` and ``regenerate`` begin
    its text anew, a ``delta`` goes on with it.  The message stands where its first event stood and has the role last given.  A
    null kind is a ``message``, a null text is empty; an unknown kind is an error.  An event without a message id is a whole message by itself
    and is never gathered with others, nor is a conversation: only the events of one message meet in a task.  Events of
    one message with the same ``seq`` are taken by kind (resets first), then text, so repeated deltas both count.
    """
    kinds = F.coalesce(F.col(kind), F.lit("message"))
    known = kinds.isin(*RESETS, DELTA)
    rows = events.select(
        F.col(conv).alias("conv_id"), F.col(seq).alias("seq"), F.col(message).alias("message_id"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.when(known, kinds == DELTA).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), kinds))).alias("delta"))
    single = rows.where("message_id is null").select("conv_id", F.col("seq").alias("position"), "role", "text")
    parts = rows.where("message_id is not null").groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("position"), F.array_sort(F.collect_list(F.struct("seq", "delta", "text", "role"))).alias("events"),
        F.max(F.when(~F.col("delta"), F.struct("seq", "text"))).alias("reset"))
    folded = parts.select(
        "conv_id", "position",
        F.expr("try_element_at(filter(transform(events, e -> e.role), r -> r is not null), -1)").alias("role"),
        F.expr("concat(coalesce(reset.text, ''), array_join(transform(filter(events, e -> e.delta and "
               "(reset is null or reset.seq is null or e.seq is null or e.seq >= reset.seq)), e -> e.text), ''))").alias("text"))
    return single.unionByName(folded)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    """The text behind an escaped one."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, turn) with the rendered turn of every message; nothing is shuffled.

    ``<|im_start|>role\\ntext<|im_end|>\\n``, where in role and text a backslash is doubled and ``<|`` becomes ``<\\|``, and in a role a line
    break becomes ``\\n``: no control string can come from a text, and the escape can be read back.  A null role or text is empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return messages.select("conv_id", "position", role.alias("role"), text.alias("text"), F.concat(
        F.lit(START), F.replace(_escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), _escaped(text), F.lit(END + "\n")).alias("turn"))


def format_chats(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, part, segment, text, loss): rendered conversations in segments of about ``SEGMENT_CHARS`` characters.

    Joined by (part, segment), the segments of a conversation are its formatted text, turns ordered by position, then role and
    text; most have one.  ``loss`` has the code point spans of each ``loss_role`` text within the segment.  Turns are dealt by range of
    (conversation, position), so a conversation with a third of all rows is spread over many tasks, and each task streams.
    Turns without a conversation id are one conversation with a null id; repeated rows are turns of their own; an empty table gives no rows.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    id_type = to_arrow_type(messages.schema["conv_id"].dataType)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        conv: object = segments
        texts: list[str] = []
        loss: list[dict] = []
        chars = 0
        done: list[dict] = []
        schema = pa.schema([("conv_id", id_type), ("part", pa.int32()), ("segment", pa.int64()), ("text", pa.string()),
                            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

        def close() -> None:
            nonlocal made, texts, loss, chars
            if texts:
                done.append({"conv_id": conv, "part": part, "segment": made, "text": "".join(texts), "loss": loss})
                made += 1
            texts, loss, chars = [], [], 0

        for batch in batches:
            for c, role, turn in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != conv or chars >= SEGMENT_CHARS:
                    close()
                    conv = c
                texts.append(turn)
                if role == loss_role:
                    loss.append({"start": chars + turn.index("\n") + 1, "end": chars + len(turn) - len(END) - 1})
                chars += len(turn)
                if len(done) >= 512:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    turns = render(messages)
    order = ["conv_id", "position", "role", "text"]
    return (turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "turn").mapInArrow(
        segments, f"conv_id {kind}, part int, segment long, text string, loss array<struct<start:long,end:long>>"))


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    at = 0
    while at < len(text):
        stop = text.find(END + "\n", at)
        line = text.find("\n", at)
        if not text.startswith(START, at) or line < 0 or stop < line:
            raise ValueError("not a rendered conversation")
        yield unescape(text[at + len(START):line]), unescape(text[line + 1:stop])
        at = stop + len(END) + 1


def digest_chats(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted segments.

    A digest over a conversation is sequential by nature, so its segments stream through one task in order; that task
    holds a segment and the hash states.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    schema = pa.schema([("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        conv: object = run
        turns = masked = None
        counts = [0, 0, 0]

        def close() -> None:
            if turns is not None:
                done.append(dict(zip(schema.names, (conv, counts[0], turns.hexdigest(), counts[1], masked.hexdigest(), counts[2]))))

        for batch in batches:
            for c, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != conv:
                    close()
                    conv, counts = c, [0, 0, 0]
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for span in loss:
                    said = unescape(text[span["start"]:span["end"]])
                    masked.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
            if len(done) >= 512:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").select("conv_id", "text", "loss")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
