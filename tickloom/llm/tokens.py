"""Token counts from a digest cache, and token ids, as the tokenizer library itself gives them.

The tokenizers cut a text at white space before they merge anything, so a text's tokens are those of its pieces.
A worker keeps the tokens of pieces it has met, and only new pieces are encoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import string
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import new_path, saved

PIECES = 300_000  # tokens of so many pieces are kept by a worker, some 45 MB; then it starts anew
LONGEST = 64  # characters of a piece that is kept; longer ones hardly come again
_CUT = re.compile(r"(?<=\S)(?= )")  # no token holds a space behind a visible character
_WIDE = re.compile(r"\s ")
# A run of signs behind a letter is a token run of its own, so "word" and "word," share one encoding.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@functools.lru_cache(maxsize=4)
def load(path: str):
    # One thread per task, as Spark counts cores.
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_of_sign() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(free)}


CLOSE = b"\xff"  # stands for the end of a word; no UTF-8 text holds it


@functools.lru_cache(maxsize=4)
def merger(path: str):
    """The vocabulary's merges for one run of letters, in the faster loop of another library, and ids by its ranks.

    A rank is a token's place in the order of merges.  Where the vocabulary marks word ends, a last byte and the
    mark are joined before all else.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, signs = model.get("end_of_word_suffix") or "", _byte_of_sign()

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(signs[c] for c in (token.removesuffix(suffix) if ends else token)) + (CLOSE if ends else b"")

    ids = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
    made = [raw("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    last = [bytes([b]) + CLOSE for b in range(256)] if suffix else []
    order = dict.fromkeys([*last, *(bytes([b]) for b in range(256)), *made])
    ranks = {token: rank for rank, token in enumerate(order)}
    encoding = tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    back = [ids.get(token) for token in order]
    if suffix:
        return lambda word: [back[i] for i in encoding._encode_single_piece(word.encode() + CLOSE)]
    return lambda word: [back[i] for i in encoding.encode_ordinary(word)]


class Pieces(dict):
    """What the library gives for a piece (with ``before`` put before it), learned when first asked for."""

    special = "<|"  # how the tokenizers' own strings begin
    punctuation = string.punctuation

    def __init__(self, path: str, before: str = ""):
        super().__init__()
        self.before, self.merge, self.whole, self.signs = before, merger(path), load(path), {}

    def __missing__(self, piece):
        word = piece.rstrip(self.punctuation)
        last = word[-1:]
        if len(word) < len(piece) and last.isalpha() and last.isascii() and self.special not in piece:
            value = self[word] + self.sign(piece[len(word):])
        else:
            value = self.value(self.ids(piece))
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = value
        return value

    def ids(self, piece) -> list[int]:
        """Runs of plain letters by the merge loop, anything else by the library itself."""
        text = piece if isinstance(piece, str) else piece.decode()
        if (text.isalpha() and text.isascii()) or _LETTERS.fullmatch(text):
            return self.merge(self.before + self.folded(text))
        return self.whole.encode(self.before + text, add_special_tokens=False).ids

    @staticmethod
    def folded(text: str) -> str:
        return text

    def sign(self, signs):
        value = self.signs.get(signs)
        if value is None:
            text = signs if isinstance(signs, str) else signs.decode()
            value = self.value(self.whole.encode(text, add_special_tokens=False).ids)
            if len(signs) <= LONGEST:
                if len(self.signs) >= PIECES:
                    self.signs.clear()
                self.signs[signs] = value
        return value


class PieceCounts(Pieces):
    """Token counts of pieces with one space before them; ``heads`` has those without."""

    value = staticmethod(len)

    def __init__(self, path: str):
        super().__init__(path, " ")
        self.heads = Pieces(path)
        self.heads.value = len

    def of(self, texts: list) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            if _WIDE.search(text) or text[0] == " ":
                first, *rest = _CUT.split(text)
                rest = [piece[1:] for piece in rest]
            else:
                first, *rest = text.split(" ")
            out.append(self.heads[first] + sum(map(self.__getitem__, rest)))
        return out


class PieceIds(Pieces):
    """Ids as little-endian 16-bit numbers, for tokenizers that drop white space and case.  Keys are UTF-8."""

    special = b"<|"
    punctuation = string.punctuation.encode()
    folded = staticmethod(str.lower)

    @staticmethod
    def value(ids: list) -> bytes:
        return array("H", ids).tobytes()

    def of(self, texts: list) -> list[bytes]:
        out = []
        for text in texts:
            data = (text or "").encode()
            pieces = (data if b"<|" in data else data.lower()).split()  # of ASCII alone
            out.append(b"".join(map(self.__getitem__, pieces)))
        return out


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    if load(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    return PieceIds(path)


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file, so that a changed vocabulary never meets old counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


HOT = 1 << 16  # a content with more than this share of all rows is joined by a broadcast; there are at most so many
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def content(text: str = "text"):
    """Normalised content: null is the empty text.  Anything else could change a count."""
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: str = "text"):
    return F.unhex(F.sha2(content(text), 256))


def count_misses(docs: DataFrame, cache: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Digest, version and count of every distinct content that ``cache`` lacks for this tokenizer.

    Equal contents meet once: partial aggregation leaves one copy per task before the shuffle.
    """
    version = tokenizer_version(tokenizer)
    known = cache.filter(F.col("version") == version).select("digest")
    misses = (docs.select(digest(text).alias("digest"), content(text).alias("content"))
              .groupBy("digest").agg(F.first("content").alias("content"))
              .join(known, "digest", "left_anti"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(tokenizer)
        for batch in batches:
            n = counts.of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["digest", "version", "n_tokens"])

    return misses.mapInArrow(encode, CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = 512, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Token count of every whole text, through the digest cache at ``cache_path``.

    The cache is a Parquet table of (content digest, tokenizer version, count) that only grows: misses are encoded
    once each and appended, then every row takes its count from the cache by a join.  Two runs that append the
    same digest at once do no harm, since the count is the same and is read once.

    A content with many copies is no hot key: the contents with at least 1 / ``HOT`` of all rows (and two rows), at most
    ``HOT`` of them, are broadcast with their counts, and only the other rows are shuffled.

    Null and empty texts have 0 tokens and 0 bytes; repeated rows each keep their row; an empty table gives an empty
    result; other columns of ``docs`` are not returned.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    count_misses(docs, cache, tokenizer, text).write.mode("append").parquet(cache_path)
    cache = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
             .filter(F.col("version") == tokenizer_version(tokenizer))
             .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    rows = saved(docs.select(F.col(key).alias("doc_id"), digest(text).alias("digest"),
                             F.octet_length(content(text)).cast("long").alias("n_bytes")), "token-rows")
    often = max(2, -(-rows.count() // HOT))
    hot = rows.groupBy("digest").agg(F.count("*").alias("copies")).filter(F.col("copies") >= often).select("digest")
    hot = saved(cache.join(F.broadcast(hot), "digest"), "token-hot")  # at most HOT rows
    known = rows.join(F.broadcast(hot), "digest", "left")
    found = known.filter(F.col("n_tokens").isNotNull()).unionByName(
        known.filter(F.col("n_tokens").isNull()).drop("n_tokens").join(cache, "digest"))
    # Written at once: Spark takes scans of one folder for equal, whatever files each has listed, so two results that
    # met in one plan would both read the older state of the cache.
    return saved(found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")


def token_counts_in_batches(batches: list[DataFrame], cache_path: str, tokenizer: str, limit: int = 512) -> DataFrame:
    """``token_counts`` of one batch after another through one cache, so that a batch encodes only what none before had."""
    out = token_counts(batches[0], cache_path, tokenizer, limit)
    for batch in batches[1:]:
        out = out.unionByName(token_counts(batch, cache_path, tokenizer, limit))
    return out


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches by the parity of their id: the first fills the cache, the second also uses it."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    even = F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(False))
    return token_counts_in_batches([docs.filter(even), docs.filter(~even)], new_path(spark, "token-cache"),
                                   public_tokenizers.path("byte_bpe_50k.json"))
