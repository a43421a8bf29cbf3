"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved
from tickloom.llm.tokens import piece_ids
from tickloom.llm.wordhash import portions

CAPACITY = 4096
END = 2  # closes every document
GROUP_TOKENS = 2_000_000  # tokens packed together by one task
SMALLEST = 64  # shortest sequence that the rest of a group is cut into
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # cost of a token, and of a pair of tokens that attend to each other
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "cost double, sequence_cost double")


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every document with the closing id: (doc_id, n_tokens, ids as 16-bit numbers)."""
    end = np.array([END], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_ids(tokenizer)
        for batch in (p for b in batches for p in portions(b)):
            ids = [i + end for i in table.of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequences for ``total`` tokens: full ones, then powers of two, which need no padding, for the rest."""
    full, rest = divmod(total, capacity)
    out = [capacity] * full
    size = capacity // 2
    while rest >= SMALLEST and size >= SMALLEST:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    if rest:
        out.append(1 << (rest - 1).bit_length())
    return out


def assign(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) and the cost of each sequence.

    Documents come in descending length; one longer than a sequence first fills whole ones.  The rest goes to the
    cheapest sequence that has room for all of it; where none has, it is cut over those with most room.
    """
    sizes = capacities(sum(lengths), capacity)
    room, costs = np.array(sizes, np.int64), np.zeros(len(sizes))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, seq, sizes[seq] - int(room[seq])))
        room[seq] -= length
        costs[seq] += cost(length)

    rest, filled = [], 0
    for doc, length in enumerate(lengths):
        whole = length // capacity
        for i in range(whole):
            put(doc, i * capacity, capacity, filled + i)
        filled += whole
        if length % capacity:
            rest.append((-(length % capacity), doc, whole * capacity))
    for length, doc, start in sorted(rest):
        length = -length
        open_ = np.flatnonzero(room >= length)
        if len(open_):
            put(doc, start, length, int(open_[np.argmin(costs[open_])]))
            continue
        while length:
            seq = int(np.argmax(room))
            part = min(length, int(room[seq]))
            put(doc, start, part, seq)
            start, length = start + part, length - part
    return pieces, costs.tolist()


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack all documents into sequences of at most ``CAPACITY`` tokens; one row per piece.

    Every row is a document of its own: its ids and the closing id, each in exactly one piece.  Rows are dealt at
    random, by a hash, into groups of about ``group_tokens`` tokens, and each group is packed by one task, so no task
    sees more than a group, whatever the table holds.  A group wastes fewer than ``SMALLEST`` tokens.  The ids are
    written once and reread, so a lost executor never tokenizes twice and the groups stay as they are.

    Null and empty texts are documents of the closing id alone; an empty table gives no pieces; other columns are not
    returned.  A document longer than a sequence is cut; a null key stays null.
    """
    rows = saved(tokenized(docs, tokenizer, key, text), "token-ids")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_tokens))
    dealt = rows.withColumn(
        "pack_group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def one(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        ids, names, sizes = frame["ids"].tolist(), frame["doc_id"].tolist(), frame["n_tokens"].tolist()
        pieces, costs = assign(sizes)
        out = []
        for doc, start, length, seq, offset in pieces:
            part = np.frombuffer(ids[doc], "<u2", length, 2 * start).astype("<u4").tobytes()
            out.append((names[doc], start, length, zlib.crc32(part), sizes[doc], (int(keys[0]) << 32) + seq, offset,
                        cost(length), costs[seq]))
        names_out = [c.split()[0] for c in PIECES.split(", ")]
        found = pd.DataFrame(out, columns=names_out)
        return found.astype({"doc_id": "Int64"}) if found["doc_id"].isna().any() else found

    return dealt.groupBy("pack_group").applyInPandas(one, PIECES)


@query("op7_pack")
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
