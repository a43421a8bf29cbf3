"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over every document that may be learned from.  The weights are trained on a bounded sample by
follow-the-regularised-leader with an elastic net (so most of them are zero); a temperature fitted on a part of the
sample that the weights have not seen turns log-odds into probabilities.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.labelled import fold
from tickloom.llm.registry import query, table
from tickloom.llm.wordhash import numbers

SAMPLE = 4_000  # documents the weights and the temperature are learned from, at most
SIZES = (1, 2, 3, 4)  # code points of an n-gram
BITS = 16  # n-grams are hashed to so many bits
SPAN = 1 << 18  # code points whose n-grams are in memory at once
SCALE = 100.0  # the shares of n-grams are in percent
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.05, 0.01
CALIBRATE = 5  # every so-many-th document of the sample sets the temperature
UNKNOWN = "und"

_STEP = numbers(max(SIZES), 31)
_SALT = numbers(max(SIZES), 32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def spans(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, place of the first new one): lower case, each run of other signs than letters one zero.

    A span begins with the end of the one before, so that every n-gram ends in exactly one span's new part.
    """
    tail, back = np.zeros(1, np.uint64), max(SIZES) - 1
    for at in range(0, len(text) + 1, SPAN):
        piece = text[at:at + SPAN].lower().replace("ς", "σ") + (" " if at + SPAN > len(text) else "")
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_letters()[code], code, 0).astype(np.uint64)
        code = code[(code != 0) | (np.concatenate([tail[-1:], code[:-1]]) != 0)]
        yield np.concatenate([tail, code]), len(tail)
        tail = np.concatenate([tail, code])[-back:]


def span_grams(code: np.ndarray, new: int) -> Iterator[np.ndarray]:
    """Hashes of the n-grams that end in the new part of a span, by n."""
    total = np.zeros(len(code) + 1, np.uint64)
    for n in SIZES:
        if len(code) < n:
            break
        with np.errstate(over="ignore"):
            total = total[:len(code) - n + 1] + code[n - 1:] * _STEP[n - 1]
            yield ((total[max(new - n + 1, 0):] + _SALT[n - 1]) * _SALT[0] >> np.uint64(64 - BITS)).astype(np.int64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, in pieces."""
    for one in spans(text):
        yield from span_grams(*one)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of a text and how often each occurs."""
    count = np.zeros(1 << BITS, np.int64)
    for one in spans(text):
        count += np.bincount(np.concatenate(list(span_grams(*one))), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, count[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed n-gram occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        held = np.zeros(1 << BITS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for h in grams(text):
                    held[h] = True
                at = np.flatnonzero(held)
                total[at] += 1
                held[at] = False
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["gram", "n"])

    got = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[gram[gram >= 0]] = n[gram >= 0]
    return out, int(n[gram < 0].sum())


def idf_of(frequencies: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + frequencies)) + 1


class Leader:
    """Multinomial logistic regression by follow-the-regularised-leader, one document at a time."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))  # the last row is the bias

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights(np.append(at, 1 << BITS))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        pull = softmax(x @ w)
        pull[label] -= 1
        g = x[:, None] * pull
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """By which the log-odds are divided so that the labels are likeliest; golden-section search, 1 without labels."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, cut = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and their values: the share of the text's n-grams in percent, times idf; the bias last."""
    at, count = counted(text)
    return at, np.append(SCALE * count / max(count.sum(), 1) * idf[at], 1.0)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # n-grams x languages: weight times idf
    bias: np.ndarray
    temperature: float

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, probability) of a whole text."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        total, count = np.zeros(len(self.names)), 0
        for h in grams(text):
            total += np.ones(len(h)) @ np.take(self.table, h, axis=0)
            count += len(h)
        chance = softmax((SCALE * total / max(count, 1) + self.bias) / self.temperature)
        best = int(chance.argmax())
        return self.names[best], float(chance[best])


def train(sample: DataFrame, names: list[str], idf: np.ndarray) -> Model:
    """Fit on (key, text, lang) rows, a bounded sample, streamed through one task in the order of a hash."""
    number = {name: i for i, name in enumerate(names)}
    late = (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(CALIBRATE)) == 0).alias("late")
    ordered = sample.select("key", "text", "lang", late).repartition(1) \
        .sortWithinPartitions("late", F.xxhash64("key", F.lit(5)), "key").select("text", "lang", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, logits, labels = Leader(len(names)), [], []
        for batch in batches:
            for text, lang, late in zip(*(c.to_pylist() for c in batch.columns)):
                at, x = features(text, idf)
                if late:
                    logits.append(leader.logits(at, x))
                    labels.append(number[lang])
                else:
                    leader.learn(at, x, number[lang])
        weights = leader.weights(slice(None))
        weights = np.vstack([weights, np.full(len(names), temperature(np.array(logits), np.array(labels)))])
        used = np.flatnonzero(weights.any(axis=1))
        for i in range(0, len(used), 4096):
            part = used[i:i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(weights[part].tolist(), pa.list_(pa.float64()))],
                                             names=["gram", "weights"])

    got = ordered.mapInArrow(run, "gram long, weights array<double>").toArrow()
    full = np.zeros(((1 << BITS) + 2, len(names)))
    full[got.column("gram").to_numpy()] = np.array(got.column("weights").to_pylist()).reshape(-1, len(names))
    return Model(names, full[:1 << BITS] * idf[:, None], full[1 << BITS], float(full[-1, 0]) or 1.0)


def drawn(docs: DataFrame, sample: int) -> DataFrame:
    """(key, text, lang) of at most ``sample`` documents: ids by hash; of rows with one id the one with the least digest."""
    ids = docs.select(F.col("doc_id").alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = docs.select(F.col("doc_id").alias("key"), "text", "lang").join(F.broadcast(ids), "key")
    return rows.groupBy("key").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("r")).select("key", "r.*")


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the (doc_id, text, lang) rows of ``docs``, those without a null, text included."""
    whole = docs.select("doc_id", "text", "lang").na.drop()
    frequencies, texts = document_frequencies(whole.select("text"))
    if not texts:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    rows = drawn(whole, sample)
    names = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]
    return train(rows, names, idf_of(frequencies, texts))


def languages(docs: DataFrame, learn: Column, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learned only from rows that ``learn`` marks, with a text and a lang; document frequencies over all of them, weights and temperature
    over at most ``sample``.  Texts that are null or have no letter are ``und`` with score 0, and so is every text where nothing could be
    learned.  Rows with a null doc_id are neither learned from nor held out; repeated rows each keep a row; an empty table gives
    an empty result.  Memory grows with 65,536 n-grams times the number of languages.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs.filter(learn), sample))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.judge(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    shape = rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, shape)


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fold(F.col("doc_id"), 3)
    return languages(table(spark, sf_dir, "documents"), at != 1, at == 1)
