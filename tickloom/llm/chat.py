"""Chat formatting of typed content parts, with loss masks and attachment references."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.registry import query, table

TURN, BODY, END = "<|turn|>", "\n", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Strings that steer a model in this or another usual template.  A text that holds one gets a backslash after the
# string's first sign; a text that already has backslashes there gets one more, so taking one away restores it.
_CONTROL = r"(\||/?s>|</?SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_MARK = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))

PART = "struct<type string, text string, uri string, width int, height int, seconds double, pages int>"
SEGMENT = ("conv_id long, turn long, role string, segment string, loss_start long, loss_end long, "
           "attachments array<struct<kind string, uri string, place long, tokens long>>, attachment_tokens long")

PATCH = 28  # pixels of an image that make one token, each way
SECOND_TOKENS, PAGE_TOKENS = 25, 512
UNKNOWN = 256  # tokens of an attachment whose size is not given


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def one_line(text: str) -> str:
    """Line ends as backslash and n, backslashes doubled."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(line: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", line)


@dataclass
class Flattener:
    """Visitor over the parts of one turn: text as it is, escaped; anything else as a placeholder in its place."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, "visit_" + (part.get("type") or "text"), self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        width, height = part.get("width"), part.get("height")
        known = width and height
        self._attach(part, math.ceil(width / PATCH) * math.ceil(height / PATCH) if known else UNKNOWN)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._attach(part, math.ceil(seconds * SECOND_TOKENS) if seconds else UNKNOWN)

    def visit_document(self, part: dict) -> None:
        self._attach(part, part["pages"] * PAGE_TOKENS if part.get("pages") else UNKNOWN)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of unknown type {part['type']!r}")

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["type"], "uri": part.get("uri"), "place": self.size, "tokens": tokens})
        self._add(PLACEHOLDERS[part["type"]])

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The segment of one turn, the range under the loss mask (empty but for assistants), and its attachments."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    head = TURN + one_line(escape(role)) + BODY
    body = "".join(visitor.out)
    for item in visitor.attachments:
        item["place"] += len(head)
    end = len(head) + (len(body) if role == "assistant" else 0)
    return head + body + END, len(head), end, visitor.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment; attachments leave no text."""
    head, _, body = segment.removeprefix(TURN).removesuffix(END).partition(BODY)
    return unescape(many_lines(head)), read_text(body)


def read_text(body: str) -> str:
    """The text of (a range of) a segment's body."""
    return "".join(unescape(piece) for piece in _MARK.split(body))


def format_conversations(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per turn with its segment; the segments of a conversation, by ``turn``, are its formatted text.

    ``turns`` has conv_id, turn, role and ``parts``, an array of content parts.  Turns are formatted each on its own, so
    nothing is shuffled and no conversation is ever held whole.  ``loss_start`` and ``loss_end`` are code points
    within the segment; ``place`` of an attachment likewise.  A null role is the empty one; null parts, null texts and
    null part types are empty text; an unknown part type fails the job.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turn(role or "", [p for p in parts or [] if p])
                    for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.list_(pa.struct(
                    [("kind", pa.string()), ("uri", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))),
                pa.array([sum(a["tokens"] for a in r[3]) for r in rows], pa.int64())],
                names=[c.split()[0] for c in ("conv_id", "turn", "role", "segment", "loss_start", "loss_end",
                                              "attachments", "attachment_tokens")])

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
               F.col("role").cast("string").alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")]
    return turns.select(*columns).mapInArrow(build, SEGMENT)


def text_parts(text: str = "text"):
    """A plain text as one text part."""
    null = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"),
                                                      ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), *null))


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its segments.

    Rows are dealt by conversation and sorted by turn on disk where need be; a task then streams over them and keeps
    two running hashes, so a conversation with very many turns takes time but no memory.  Turns that share a number are
    ordered by role and segment; rows without conv_id are one conversation of their own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def closed() -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                              names=[c.split()[0] for c in DIGESTS.split(", ")])

        for batch in batches:
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(segment)
                learned = read_text(segment[start:end])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(segment)
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if state is not None:
            rows.append(closed())
        if rows:
            yield batch_of(rows)

    return (segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
            .select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(read, DIGESTS))


_SQL_TEXT = "coalesce(text, '')"
_SQL_CONTROL = r"([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])"

ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {_SQL_TEXT} AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END)} + length(role)
    + length(regexp_replace(text, '{_SQL_CONTROL}', '\\1\\2\\\\\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op3_chat_format", ORACLE_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    turns = given.union(own)
    return conversation_digests(format_conversations(turns.withColumn("parts", text_parts())))
