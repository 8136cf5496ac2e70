"""Conversations as one formatted text each, with the part that is trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import over_batches, table
from .template import compiled

# The strings that steer a model, which no text may hold as they are.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: What opens and closes a turn of each role; any other role is written out.
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Every backslash doubled, and one put after the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatter(template: str = TEMPLATE):
    """messages (dicts of role and text, as a stream) -> (text, trained) pieces."""
    render = compiled(template, {"escape": escape})
    return lambda messages: render(messages=messages)


class Reader:
    """Reads turns back from formatted text that comes in pieces; it holds one turn at most."""

    def __init__(self) -> None:
        self.held: list[str] = []
        self.close = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        # a close may lie across pieces, but text before it never does: look near the end only
        self.held.append(piece)
        tail = "".join(self.held[-2:])
        if self.close and self.close not in tail and len(piece) > len(self.close):
            return
        text = "".join(self.held)
        while text:
            opened = next(((role, *marks) for role, marks in TURNS.items() if text.startswith(marks[0])), None)
            if opened:
                role, start, self.close = opened
                end = text.find(self.close, len(start))
                if end < 0:
                    break
                yield role, unescape(text[len(start) : end])
            elif text.startswith(OTHER[0]):
                start, middle, self.close = OTHER
                end = text.find(self.close, len(start))
                if end < 0:
                    break
                cut = text.index(middle, len(start))
                yield unescape(text[len(start) : cut]), unescape(text[cut + len(middle) : end])
            elif len(text) < max(map(len, CONTROLS)):
                break  # an opening that has not come whole
            else:
                raise ValueError(f"no turn starts with {text[:20]!r}")
            text = text[end + len(self.close) :]
            self.close = ""
        self.held = [text] if text else []


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)


def _digest(batches: Iterable[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    render = formatter(template)
    out: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        for piece, trained in render({"role": r[1], "text": r[2]} for r in rows):
            chars += len(piece)
            if trained:
                bare = unescape(piece)
                loss_chars += len(bare)
                loss.update(bare.encode())
            for role, text in reader.feed(piece):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
        if reader.held:
            raise ValueError("the formatted text ends inside a turn")
        out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _formatted(batches: Iterable[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    render = formatter(template)
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        text, spans, at = [], [], 0
        for piece, trained in render({"role": r[1], "text": r[2]} for r in rows):
            if trained and piece:
                spans.append({"start": at, "end": at + len(piece)})
            text.append(piece)
            at += len(piece)
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array(["".join(text)], pa.string()), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "trained"]
        )


def _in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation next to each other, in order, in one task's stream."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, trained): the text of each conversation and its trained spans in code points.

    Rows of a conversation go by turn (null first), then role, then text; repeated rows
    are repeated turns. A null role or text is empty; a null conv_id is a conversation of
    its own. Roles other than user, system and assistant are written out. Other columns
    are not read; an empty table gives an empty result.
    """
    return over_batches(_in_order(turns), lambda batches: _formatted(batches, template), "conv_id long, formatted string, trained array<struct<start: long, end: long>>")


def conversation_digests(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from the formatted text of each conversation, as digests.

    Conversations are as in format_conversations. Each is rendered and read as a stream:
    a task holds a few turns, however long a conversation is.
    """
    return over_batches(_in_order(turns), lambda batches: _digest(batches, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], schema)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(turns.unionByName(more))


_ESCAPED = "replace(text, chr(92), chr(92) || chr(92))"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in TURNS.items())

ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED}) + CASE role {_MARKS} ELSE {sum(map(len, OTHER))} + length(role) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
