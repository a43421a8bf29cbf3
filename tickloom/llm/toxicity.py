"""Counterfactual-regularised toxicity classifier."""

from __future__ import annotations

import functools
import logging
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.labelled import fold, learning_rows
from tickloom.llm.registry import query, table
from tickloom.llm.wordhash import portions, prefix_hashes, text_buffer, word_places

log = logging.getLogger(__name__)

SAMPLE = 8_000  # labelled documents learned from, at most
BITS = 20  # features are hashed to so many bits
PREFIXES = (3, 4, 5, 6, 7, 8, 64)  # bytes of a word's beginning that make a feature
FEWEST = 3  # documents of the sample that hold a feature, at least
SIGNIFICANT = 3.0  # standard errors by which a feature's share differs between the classes, at least
STEPS, RATE, DECAY = 300, 0.08, 2e-6
CALM = 4.0  # weight of the penalty on score changes
THRESHOLD = 0.7
PORTION = 1 << 20  # bytes of text whose features are in memory at once; a longer text is taken whole

# Groups of people as neutral texts name them, by kind.  A counterfactual puts the next of its kind in each place.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("immigrants", "refugees", "natives"), ("africans", "americans", "europeans", "asians"),
    ("disabled", "deaf", "blind"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"),
    ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
Terms = Sequence[Sequence[str]]


@functools.lru_cache(maxsize=8)
def _swaps(identities: tuple[tuple[str, ...], ...]) -> tuple[dict[str, str], re.Pattern]:
    after = {term.lower(): kind[(i + 1) % len(kind)] for kind in identities for i, term in enumerate(kind)}
    terms = "|".join(map(re.escape, sorted(after, key=len, reverse=True)))
    return after, re.compile(rf"\b({terms})\b" if terms else "(?!)", re.IGNORECASE)


def counterfactual(text: str, identities: Terms = IDENTITIES) -> str | None:
    """The text with every identity term swapped, or None where it has none."""
    after, term = _swaps(tuple(map(tuple, identities)))
    swapped, n = term.subn(lambda m: after[m[0].lower()], text)
    return swapped if n else None


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every text, and n + 1 offsets."""
    data, offsets = text_buffer(column)
    start, end, first = word_places(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    owner = np.repeat(np.arange(len(column)), np.diff(first)) << BITS
    keys = np.unique(np.concatenate([np.unique(owner + (prefix_hashes(data, start, end, (size,))[0] >> np.uint64(64 - BITS)).astype(np.int64))
                                     for size in PREFIXES]))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(len(column) + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def steps(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` features each, so that what is computed from them stays small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, to
        at = to


def fit(feature: np.ndarray, offsets: np.ndarray, labels: np.ndarray, swapped: np.ndarray, swapped_offsets: np.ndarray,
        original: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on feature presence.

    ``swapped`` are the features of counterfactuals, and ``original`` the rows they come from.  The loss adds the squared
    change of the log-odds between a text and its counterfactual, so weight moves off the identity terms.  Only features
    whose share differs significantly between the classes take part; the others would be fitted to noise.
    """
    size = 1 << BITS
    held, toxic = np.zeros(size), np.zeros(size)
    for at, to in steps(offsets):
        found = feature[offsets[at]:offsets[to]]
        held += np.bincount(found, minlength=size)
        toxic += np.bincount(found, np.repeat(labels[at:to], np.diff(offsets[at:to + 1])), size)
    n, ones = len(labels), labels.sum()
    share = held / max(n, 1)
    apart = toxic / max(ones, 1) - (held - toxic) / max(n - ones, 1)
    error = np.sqrt(share * (1 - share) * (1 / max(ones, 1) + 1 / max(n - ones, 1)))
    use = (held >= FEWEST) & (np.abs(apart) > SIGNIFICANT * error)
    at = np.flatnonzero(use)
    number = np.full(size, -1, np.int32)
    number[at] = np.arange(len(at))

    def narrowed(f: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for first, last in steps(o):
            named = number[f[o[first]:o[last]]]
            kept = named >= 0
            parts.append(named[kept])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(kept)])[o[first:last + 1] - o[first]]))
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    x, xo = narrowed(feature, offsets)
    c, co = narrowed(swapped, swapped_offsets)
    xn, cn = np.diff(xo), np.diff(co)
    rate = min(max(labels.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    w, b = np.zeros(len(at)), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        odds = sums(w[x], xo) + b
        pull = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) / max(n, 1)
        mine = pull.copy()
        grad = DECAY * w
        if len(original):
            change = sums(w[c], co) - (odds[original] - b)
            push = 2 * CALM * change / max(n, 1)
            grad += np.bincount(c, np.repeat(push, cn), len(w))
            np.subtract.at(mine, original, push)
        grad += np.bincount(x, np.repeat(mine, xn), len(w))
        grad_b = pull.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        scale = 1 / (1 - 0.9 ** step), 1 / (1 - 0.99 ** step)
        w -= RATE * m * scale[0] / (np.sqrt(v * scale[1]) + 1e-5)
        b -= RATE * mb * scale[0] / (np.sqrt(vb * scale[1]) + 1e-5)
    out = np.zeros(size, np.float32)
    out[at] = w
    return out, b


def train(rows: DataFrame, identities: Terms = IDENTITIES) -> tuple[np.ndarray, float]:
    """Fit on (text, label) rows, a bounded sample.  Features and counterfactuals are made by the executors.

    The number of counterfactual pairs is logged; without any the penalty is zero and this is plain logistic regression.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, 0, PORTION)):
            texts = batch.column(0).fill_null("")
            swapped = [counterfactual(t, identities) for t in texts.to_pylist()]
            out = []
            for column in (texts, pa.array(swapped, pa.string())):
                found, offsets = features(column)
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(1), *out, pa.array([s is not None for s in swapped])],
                                             names=["label", "features", "swapped", "has"])

    got = rows.select("text", "label").mapInArrow(
        extract, "label int, features array<int>, swapped array<int>, has boolean").toArrow()

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks] or [np.zeros(0, np.int32)])
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int32)])
        return flat.astype(np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    x, xo = lists(got.column("features"))
    c, co = lists(got.column("swapped"))
    original, labels = np.flatnonzero(got.column("has").to_numpy()), got.column("label").to_numpy().astype(float)
    del got  # the driver holds one copy of the features
    pa.default_memory_pool().release_unused()
    log.log(logging.INFO if len(original) else logging.WARNING, "%d counterfactual pairs in %d texts", len(original), len(labels))
    return fit(x, xo, labels, c, np.append(co[original], co[-1]), original)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """``row``, the whole row as a struct, and ``score``, the probability that its whole text is toxic.

    Only the text goes through Python, and only a score comes back.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = model.value
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            odds = [sums(w[found], offsets) + b for found, offsets in (features(p.column(0)) for p in portions(batch, 0, PORTION))]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(odds or [np.zeros(0)]), -30, 30))))

    probability = F.arrow_udf("double")(judge)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, probability(F.col(f"`{text}`")).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
                  identities: Terms = IDENTITIES) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``threshold`` or more; learned from ``labels`` on them."""
    weights, bias = train(learning_rows(docs, labels, "toxic", F.lit(True), sample), identities)
    return scored(docs, weights, bias).filter(F.col("score") < threshold).select("row.*")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE,
                    threshold: float = THRESHOLD, identities: Terms = IDENTITIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learned from a hash sample of at most ``sample`` labelled documents outside the held-out fold; scored over all words
    of every whole text.  Null and empty texts have the score of the bias alone; rows with a null doc_id are in no
    fold and not held out; repeated rows each keep a row; no labels at all give the score 0.5; an empty table gives an empty
    result.  Label 1 is toxic.
    """
    at = fold(F.col("doc_id"), folds)
    weights, bias = train(learning_rows(docs, labels, "toxic", at != held, sample), identities)
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text")
    return scored(rows, weights, bias).select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", F.coalesce(at == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
