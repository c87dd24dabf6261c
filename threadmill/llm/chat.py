"""Chat formatting with typed content parts.

A visitor flattens a turn's parts in order: text is escaped, every other part becomes a placeholder
and leaves a reference to its attachment with the number of tokens it expands to. Each turn becomes
one segment; a conversation's text is its segments in turn order. Control strings inside texts and
roles are escaped so that a reader gets every turn back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The first sign of any control string: placeholders and turn marks, and those of other templates.
_CONTROL = re.compile(r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\([\\n-])")
_SEGMENT = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*){re.escape(CLOSE)}\n\Z", re.DOTALL)
_BACK = {"\\": "\\", "n": "\n", "-": ""}
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    """Double each backslash and put ``\\-`` behind the first sign of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


class PartVisitor:
    """Turns parts into text, attachment references and expanded token counts."""

    def __init__(self, image_patch: int = 28, audio_tokens_per_second: float = 25.0, tokens_per_page: int = 1024):
        self.image_patch, self.audio_rate, self.page_tokens = image_patch, audio_tokens_per_second, tokens_per_page

    def visit(self, part: dict, attachments: list[dict]) -> str:
        kind = part.get("kind") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown kind of content part: {kind!r}")
        return handler(part, attachments)

    def visit_text(self, part: dict, attachments: list[dict]) -> str:
        return escape(part.get("text") or "")

    def _place(self, kind: str, part: dict, tokens: int, attachments: list[dict]) -> str:
        attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}_{len(attachments)}|>"

    def visit_image(self, part: dict, attachments: list[dict]) -> str:
        wide, high = (max(1, math.ceil((part.get(k) or 0) / self.image_patch)) for k in ("width", "height"))
        return self._place("image", part, wide * high, attachments)

    def visit_audio(self, part: dict, attachments: list[dict]) -> str:
        return self._place("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)), attachments)

    def visit_document(self, part: dict, attachments: list[dict]) -> str:
        return self._place("document", part, max(1, part.get("pages") or 0) * self.page_tokens, attachments)


def format_turn(role: str | None, parts: list[dict] | None, visitor: PartVisitor) -> tuple[str, int, int, list[dict]]:
    """Segment, start and end of the body, attachments."""
    attachments: list[dict] = []
    body = "".join(visitor.visit(p, attachments) for p in parts or [] if p is not None)
    head = f"{OPEN}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body), attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders stay in the text."""
    m = _SEGMENT.match(segment)
    if m is None:
        raise ValueError("not a segment")
    return unescape(m[1]), unescape(m[2])


PART = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType()),
])
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_SEGMENTS = [
    T.StructField("segment", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
    T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())]))),
]


def text_parts(text) -> Column:
    """A plain text as the one part of its turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]))


def format_conversations(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """One segment per input row: conv_id, turn, segment, n_chars, loss_start, loss_end, attachments.

    ``turns`` has conv_id, turn, role and parts (an array of PART). The loss mask is the body of each
    assistant turn, as code points of the segment; null elsewhere. A null role or text is empty, a
    turn without parts has an empty body, repeated rows are turns of their own, and a very long text is
    one segment in whole. A part of an unknown kind is a ValueError that names it and ends the job; a
    null part is passed over. Other columns are ignored; an empty table gives no rows. No shuffle.
    """
    visitor = visitor or PartVisitor()
    read = turns.select("conv_id", "turn", "role", "parts")
    schema = T.StructType([read.schema["conv_id"], read.schema["turn"], *_SEGMENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turn(role, parts, visitor) for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist())]
            loss = [r == TRAINED_ROLE for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] if x else None for r, x in zip(rows, loss)], pa.int64()), pa.array([r[2] if x else None for r, x in zip(rows, loss)], pa.int64()), pa.array([r[3] for r in rows], _ATTACHMENTS)],
                names=["conv_id", "turn", *(f.name for f in _SEGMENTS)],
            )

    return read.mapInArrow(run, schema)


class _Digest:
    """What is kept of a conversation while its segments pass."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        role, text = read_turn(segment)
        self.turns += 1
        self.chars += len(segment)
        self.said.update(f"{role}\n{text}\n".encode())
        if start is not None:
            trained = unescape(segment[start:end])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come in the order of turn (null first), then of their segments. The rows of a conversation
    stream through one sorted task in bounded memory: a digest of a whole text has to see it in order.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_field = segments.schema["conv_id"]
    schema = T.StructType([id_field] + [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in names[1:]])
    ordered = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], types if i == 0 else pa.string() if n.endswith("sha256") else pa.int64()) for i, n in enumerate(names)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        now, done = None, []
        for batch in batches:
            types = batch.schema.field("conv_id").type
            for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(segment, start, end)
            if len(done) >= 5000:
                yield batch_of(done)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """All turns and conversation -1, whose two texts hold control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_probe(table(spark, sf_dir, "conversations"))
    return read_back(format_conversations(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|<SYS>>|</SYS>>)', '<\\-\1', 'g'), '\[(/?INST\])', '[\\-\1', 'g') AS body FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(role) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
