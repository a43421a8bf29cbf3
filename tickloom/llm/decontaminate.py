"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved, text_key
from tickloom.llm.wordhash import Words, batch_shingles, portions, words

BLOCK_BYTES = 32 << 20  # text of the items that a pass over the documents carries to every task
MATCH, MISS = 2, -1  # alignment scores of a pair of equal words, and of a changed, missing or added one
PAIRS = 1 << 20  # pairs of a seed in a text and in an item that are in memory at once
_SCORE, _EQUAL = 1 << 40, 1 << 20


@lru_cache(maxsize=None)
def bounds(size: int, similarity: float) -> tuple[int, int, int, int]:
    """Of a similar alignment with an item of ``size`` words: the fewest equal words, the most other columns, the words
    of a seed and the fewest seeds.

    Other columns cut the equal words into runs, at most one more than there are such columns.  The longest run that is
    sure to be there is the width of a seed, and a run loses one seed less than that width.
    """
    equal = max(0, int(size * similarity) - 1)
    while equal < size and equal / size < similarity:
        equal += 1
    runs = [(e, _others(e, similarity) + 1) for e in range(max(1, equal), size + 1)] or [(0, 1)]
    width = min(-(-e // n) for e, n in runs)
    return equal, runs[-1][1] - 1, width, max(1, min(e - (width - 1) * n for e, n in runs))


def _others(equal: int, similarity: float) -> int:
    """The most columns without equal words beside ``equal`` ones."""
    columns = int(equal / similarity) + 1
    while columns > equal and equal / columns < similarity:
        columns -= 1
    return columns - equal


class Items:
    """A block of test items: their words, and the place of every seed among them, by the seed's width."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        found = words(pa.array([text for _, text in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.words = [found.of(i) for i in range(len(rows))]
        self.size = np.array([len(w) for w in self.words], np.int64)
        known = np.array([bounds(n, similarity) for n in self.size.tolist()], np.int64).reshape(-1, 4).T
        self.equal, self.spare, widths, self.least = known
        self.seeds = {}
        for width in sorted(set(widths.tolist()) - {0}):
            hashes, at = batch_shingles(found, width)
            owner = np.searchsorted(found.first, at, "right") - 1
            own = widths[owner] == width
            hashes, owner, place = hashes[own], owner[own], (at - found.first[owner])[own]
            order = np.argsort(hashes, kind="stable")
            self.seeds[width] = hashes[order], owner[order], place[order]

    def stretches(self, found: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, stretch, seeds): every stretch of a text that shares enough seeds with an item, and how many.

        A hit lies on the diagonal (place in the text less place in the item).  Stretches begin every item's length and
        are as long as the item and the columns that an alignment may add, so one of them has all hits of an alignment.
        """
        for width, (seeds, owner, place) in self.seeds.items():
            hashes, at = batch_shingles(found, width)
            low = np.searchsorted(seeds, hashes, "left")
            hit = np.flatnonzero(np.append(seeds, np.uint64(0))[low] == hashes)
            at, low, high = at[hit], low[hit], np.searchsorted(seeds, hashes[hit], "right")
            text = np.searchsorted(found.first, at, "right") - 1
            for rows, low, high in _parts(text, low, high, owner, len(self.ids)):
                many = high - low
                which = np.repeat(rows, many)
                s = np.arange(len(which)) + np.repeat(low - np.cumsum(many) + many, many)
                item, t = owner[s], text[which]
                diagonal = at[which] - found.first[t] - place[s]
                first = (diagonal - self.spare[item]) // self.size[item]
                many = diagonal // self.size[item] - first + 1
                i = np.repeat(np.arange(len(s)), many)
                stretch = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                keys = np.stack([t[i], item[i], stretch, place[s][i]])
                keys = keys[:, np.lexsort(keys[::-1])]
                keys = keys[:, np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))]
                new = np.flatnonzero(np.append(True, (keys[:3, 1:] != keys[:3, :-1]).any(axis=0)))
                count = np.diff(np.append(new, keys.shape[1]))
                enough = count >= self.least[keys[1, new]]
                yield *keys[:3, new[enough]], count[enough]


def _parts(text, low, high, owner, items: int):
    """Hits in parts of at most about ``PAIRS`` pairs with items; a text's hits on an item stay together."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1 if len(text) else []
    pairs = np.append(0, np.cumsum(high - low))
    at = 0
    while at < len(text):
        k = int(np.searchsorted(pairs[ends], pairs[at] + PAIRS, "right"))
        to = int(ends[max(k - 1, int(np.searchsorted(ends, at, "right")))])
        todo = [(np.arange(at, to), low[at:to], high[at:to], 0, items)]
        while todo:
            rows, a, b, first, last = todo.pop()
            if (b - a).sum() <= PAIRS or last - first < 2:
                if len(rows):
                    yield rows, a, b
                continue
            middle = (first + last) // 2
            known, back = np.unique(a, return_inverse=True)  # equal places are the same seed
            end = np.zeros(len(known), np.int64)
            end[back] = b
            cut = np.array([x + np.searchsorted(owner[x:y], middle) for x, y in zip(known, end)], np.int64)[back]
            todo += [(rows[k], x[k], y[k], f, t) for x, y, f, t in ((a, cut, first, middle), (cut, b, middle, last))
                     for k in [y > x]]
        at = to


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of each item with its window: (score, equal words, columns).

    All pairs at once, one antidiagonal after the other.  A cell packs score, equal words and columns into one number,
    so the larger of two alignments is the larger number.
    """
    m, w = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), m), np.uint64), np.ones((len(items), w + 2 * m), np.uint64)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, :len(x)] = x | np.uint64(2)
        b[i, m + w - len(y):m + w] = (y | np.uint64(2))[::-1]
    equal, other = MATCH * _SCORE + _EQUAL + 1, MISS * _SCORE + 1
    before = np.zeros((len(items), m + 1), np.int64)
    last, best = before.copy(), np.zeros(len(items), np.int64)
    for d in range(m + w - 1):
        at = m + w - 1 - d
        step = np.where(a == b[:, at:at + m], equal, other)
        cell = np.maximum(before[:, :-1] + step, np.maximum(last[:, :-1], last[:, 1:]) + other)
        np.maximum(cell, 0, out=cell)
        before = last
        last = np.zeros_like(before)
        last[:, 1:] = cell
        np.maximum(best, cell.max(axis=1), out=best)
    return [(int(v) >> 40, int(v) >> 20 & 0xFFFFF, int(v) & 0xFFFFF) for v in best]


FOUND = "item_id long, seeds int, score int, equal_words int, item_words int, similarity double"


def seed_hits(docs: DataFrame, items, similarity: float) -> DataFrame:
    """Every stretch of a document that is similar to an item it shares a seed with.

    The window of a stretch takes in any copy that begins in it, with half a length to spare.  It is aligned unless too few
    of the item's words are in it at all.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in (p for b in batches for p in portions(b)):
            found, keys = words(batch.column(1)), batch.column(0)
            for part in known.stretches(found):
                near = []
                for text, item, stretch, seeds in zip(*(x.tolist() for x in part)):
                    own, size = found.of(text), len(known.words[item])
                    spare = max(int(known.spare[item]), size // 2) + 1
                    window = own[max(0, stretch * size - spare):max(0, (stretch + 2) * size + spare)]
                    if np.isin(known.words[item], window).sum() >= known.equal[item]:  # no alignment has more equal words
                        near.append((text, item, seeds, window))
                near.sort(key=lambda r: len(known.words[r[1]]))
                for at in range(0, len(near), 256):
                    some = near[at:at + 256]
                    got = align([known.words[r[1]] for r in some], [r[3] for r in some])
                    out = [(keys[t].as_py(), known.ids[i], s, g[0], g[1], len(known.words[i]),
                            g[1] / max(len(known.words[i]), g[2])) for (t, i, s, _), g in zip(some, got)]
                    out = [r for r in out if r[-1] >= similarity]
                    if out:
                        kinds = [keys.type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                            names=["doc_id", "item_id", "seeds", "score", "equal_words", "item_words", "similarity"])

    return docs.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def blocks(spark: SparkSession, benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[list]:
    """The items in blocks of at most about ``most`` bytes (a longer item alone), each small enough to broadcast."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    dealt = benchmark.select(F.col(key).cast("long").alias("item_id"), F.coalesce(text, F.lit("")).alias("text"),
                             F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    for part in range(parts):
        yield [(r[0], r[1]) for r in dealt.filter(F.col("part") == part).select("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, score, equal_words, item_words, seeds): test items that documents hold.

    Seeds are runs of words, as long as an alignment of that similarity is sure to hold wherever its edits are: at 0.8, four
    words for items from 16 words, two or three for most shorter ones.  Each stretch of text with as many of an item's
    seeds as such an alignment must hold, however common they are, is aligned with the item, unless too few of the item's
    words are near it; similarity is equal words over the longer of item and alignment.

    Items travel to the tasks in blocks of bounded size, one pass over the documents for each; the leaks that a pass
    finds are written to shared storage.  Nothing else is gathered, and no document meets an item it shares no seed with.

    Null and empty texts and items match nothing; repeated rows of a
    document or item give one row per pair; a null key is kept as it is.  Empty tables give an empty result.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _found(docs, benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")), similarity,
                   block_bytes)
    best = F.max(F.struct("similarity", "score", "equal_words", "item_words", "seeds")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows whose own text holds a test item, whatever their doc_id."""
    keyed = docs.select(text_key("text").alias("_own"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    held = _found(keyed.select(F.col("_own").alias("doc_id"), "text"), benchmark, similarity, BLOCK_BYTES)
    return keyed.join(held.select(F.col("doc_id").alias("_own")).distinct(), "_own", "left_anti").select("_row.*")


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float, block_bytes: int) -> DataFrame:
    spark, out = docs.sparkSession, None
    for rows in blocks(spark, benchmark, "item_id", "text", block_bytes):
        items = spark.sparkContext.broadcast(Items(rows, similarity))
        found = saved(seed_hits(docs, items, similarity), "leaks")
        out = found if out is None else out.union(found)
    return out


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
