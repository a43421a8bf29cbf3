"""Hard negatives by a multiway hyperplane tree whose split points store distance ranges to sibling subtrees.

A node has a few split points; a row goes to the subtree of the nearest one.  Every split point keeps, for itself and each
sibling, the least and largest distance to the rows of that subtree.  A score window around a query is an annulus of
distances (a row of squared length n scores s at squared distance |q|^2 + n - 2s), and by the triangle inequality a subtree is
skipped once, for any split point, its range does not meet the annulus moved by the query's distance to that point.
What is left is scored exactly in integers.

The tree is fitted on a bounded sample and travels to the tasks; every row is placed in it.  Leaves are cut by a hash into
chunks of about ``CHUNK`` rows.  A task holds one chunk at a time and streams the queries that reach it past the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved
from tickloom.llm.vectors import lists, longs, matrix, norms, products, squared, usable

SAMPLE = 8_192  # rows the split points are chosen from, at most
FANOUT = 8  # split points of a node
LEAF = 256  # a node with fewer rows of the sample is a leaf
CHUNK = 4_096  # rows of a leaf that a task holds at once, on average
BLOCK = 1 << 20  # scores in memory at once
LEAST, MOST = -(1 << 63), (1 << 63) - 1
POSITIVES, NEGATIVES = 5, 10
SLACK = 1e-9  # relative; covers the rounding of square roots

ROW = "key long, vec_id long, label int, v array<bigint>"


@dataclass
class Node:
    points: np.ndarray
    children: list[int]  # a node's number, or ~leaf
    low: np.ndarray | None = None  # least distance of split point i to subtree j
    high: np.ndarray | None = None
    shortest: np.ndarray | None = None  # squared lengths in subtree j
    longest: np.ndarray | None = None


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0
    first: np.ndarray | None = None  # number of a leaf's first chunk
    pieces: np.ndarray | None = None  # chunks of a leaf; 0 if it has no rows

    def grow(self, rows: np.ndarray, fanout: int, leaf: int) -> int:
        """Build the subtree of the rows of a sample; its node's number, or ~leaf."""
        points = split_points(rows, fanout) if len(rows) >= leaf else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append(Node(points, []))
        near = squared(rows, points).argmin(axis=1)
        self.nodes[at].children = [self.grow(rows[near == j], fanout, leaf) for j in range(len(points))]
        return at

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(rows), np.int32)
        work = [(0, np.arange(len(rows)))] if self.nodes else []
        while work:
            number, mine = work.pop()
            node = self.nodes[number]
            near = squared(rows[mine], node.points).argmin(axis=1)
            for j, child in enumerate(node.children):
                if child < 0:
                    out[mine[near == j]] = ~child
                elif (near == j).any():
                    work.append((child, mine[near == j]))
        return out

    def below(self, number: int) -> dict[int, int]:
        """Leaf to child of the node, for all leaves under it."""
        out: dict[int, int] = {}
        for j, child in enumerate(self.nodes[number].children):
            out.update({~child: j} if child < 0 else dict.fromkeys(self.below(child), j))
        return out

    def reached(self, rows: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """For every query and leaf, whether one of the query's score windows may have a row there."""
        out = np.zeros((len(rows), self.leaves), bool)
        if not self.nodes:
            out[:] = True
        work = [(0, np.arange(len(rows)))] if self.nodes else []
        own = norms(rows).astype(np.float64)
        while work:
            number, mine = work.pop()
            node = self.nodes[number]
            away = np.sqrt(squared(rows[mine], node.points).astype(np.float64))  # queries x points
            for j, child in enumerate(node.children):
                if node.shortest[j] > node.longest[j]:
                    continue  # no rows
                with np.errstate(invalid="ignore"):
                    outer = own[mine, None] + node.longest[j] - 2 * lows[mine]  # queries x windows
                    inner = own[mine, None] + node.shortest[j] - 2 * highs[mine]
                    outer = outer + SLACK * (np.abs(outer) + own[mine, None] + node.longest[j]) + 1
                    inner = inner - SLACK * (np.abs(inner) + own[mine, None] + node.longest[j]) - 1
                    far, close = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
                low, high = node.low[:, j] * (1 - SLACK) - 1e-6, node.high[:, j] * (1 + SLACK) + 1e-6
                d = away[:, None, :]
                meets = ((d - far[:, :, None] <= high) & (d + far[:, :, None] >= low) & (close[:, :, None] - d <= high)).all(2)
                live = mine[(meets & (outer >= 0) & (lows[mine] <= highs[mine])).any(1)]
                if child < 0:
                    out[live, ~child] = True
                elif len(live):
                    work.append((child, live))
        return out


def split_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other, among the first few times as many; fewer where rows are equal."""
    pool = rows[:3 * count]
    chosen, nearest = [0], squared(pool, pool[:1])[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(pool, pool[chosen[-1:]])[:, 0])
    if len(chosen) == 1:  # the first ones are equal; another one may differ
        apart = np.flatnonzero((rows != rows[0]).any(1))
        return rows[np.append(chosen, apart[:1])]
    return pool[chosen]


def points_of(df: DataFrame, relabel: Column | None = None) -> DataFrame:
    """(key, vec_id, label, v) of the usable rows; ``key`` tells rows with one id apart."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                     (F.col("label") if relabel is None else relabel).cast("int").alias("label"),
                     F.col("embedding")).filter("vec_id is not null and label is not null and embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, values = usable(batch.column(2))
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists(sizes, values)],
                                             names=["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label int, v array<bigint>").select(
        F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", "v")


def fitted(points: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF, chunk: int = CHUNK) -> tuple[Tree, DataFrame]:
    """The tree with its ranges, and every row with its leaf."""
    drawn = points.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow().column("v").combine_chunks()
    tree = Tree()
    tree.grow(matrix(drawn), fanout, leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(matrix(batch.column(3))))],
                                             names=[*batch.schema.names, "leaf"])

    placed = saved(points.mapInArrow(place, f"{ROW}, leaf int"), "hard-negatives-placed")
    measure(tree, placed, chunk)
    return tree, placed


def measure(tree: Tree, placed: DataFrame, chunk: int) -> None:
    """Fill in the ranges over all placed rows.  What comes back has one row per split point and sibling."""
    children = {n: tree.below(n) for n in range(len(tree.nodes))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[float]] = {}

        def note(key: tuple[int, int, int], values: np.ndarray, rows: int) -> None:
            old = found.setdefault(key, [np.inf, -np.inf, 0])
            found[key] = [min(old[0], float(values.min())), max(old[1], float(values.max())), old[2] + rows]

        for batch in batches:
            leaf, v = batch.column(0).to_numpy(), matrix(batch.column(1))
            for at, n in enumerate(np.bincount(leaf)):
                if n:
                    note((-1, at, 0), np.zeros(1), int(n))
            size = norms(v).astype(np.float64)
            for number, node in enumerate(tree.nodes):
                side = np.full(tree.leaves, -1)
                side[list(children[number])] = list(children[number].values())
                child = side[leaf]
                for j in np.unique(child[child >= 0]):
                    mine = child == j
                    away = np.sqrt(squared(v[mine], node.points).astype(np.float64))
                    note((number, -1, int(j)), size[mine], 0)
                    for i in range(len(node.points)):
                        note((number, i, int(j)), away[:, i], 0)
        if found:
            keys = np.array(list(found))
            values = list(zip(*found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2]),
                                              *[pa.array(v) for v in values[:2]], pa.array(values[2], pa.int64())],
                                             names=["node", "point", "child", "low", "high", "rows"])

    got = (placed.select("leaf", "v").mapInArrow(run, "node long, point long, child long, low double, high double, rows long")
           .groupBy("node", "point", "child").agg(F.min("low"), F.max("high"), F.sum("rows")).collect())
    for node in tree.nodes:
        n = len(node.points)
        node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        node.shortest, node.longest = np.full(n, np.inf), np.full(n, -np.inf)
    rows = np.zeros(tree.leaves, np.int64)
    for number, i, j, low, high, count in got:
        if number < 0:
            rows[i] = count
        elif i < 0:
            tree.nodes[number].shortest[j], tree.nodes[number].longest[j] = low, high
        else:
            tree.nodes[number].low[i, j], tree.nodes[number].high[i, j] = low, high
    tree.pieces = -(-rows // chunk)
    tree.first = np.concatenate([[0], np.cumsum(tree.pieces)[:-1]])


def chunk_of(tree: Tree) -> Column:
    """The chunk of a placed row."""
    first = F.array(*[F.lit(int(f)) for f in tree.first])
    pieces = F.array(*[F.lit(max(int(p), 1)) for p in tree.pieces])
    return (F.get(first, F.col("leaf")) + F.pmod(F.col("key"), F.get(pieces, F.col("leaf")))).cast("bigint")


def windows_below(scores: list[int], low: int = 30, high: int = 90) -> tuple[list[int], list[int]]:
    """The whole scores between ``low`` and ``high`` hundredths of each given score."""
    return [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]


def aimed(queries: DataFrame, tree: Tree, windows: Callable[[list[int]], tuple[list[int], list[int]]]) -> DataFrame:
    """A row per query and chunk that one of its score windows reaches; ``windows`` makes them from ``scores``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                made = [windows(s) for s in batch.column(4).to_pylist()]
                most = max((len(low) for low, _ in made), default=0)
                # A window from above to below holds nothing.
                low, high = np.full((len(made), most), np.inf), np.full((len(made), most), -np.inf)
                for i, (a, b) in enumerate(made):
                    low[i, :len(a)] = [-np.inf if x == LEAST else x for x in a]
                    high[i, :len(b)] = [np.inf if x == MOST else x for x in b]
                hit = tree.reached(matrix(batch.column(3)), low, high)
                spans = [[{"first": int(tree.first[j]), "last": int(tree.first[j] + tree.pieces[j] - 1)}
                          for j in np.flatnonzero(h) if tree.pieces[j]] for h in hit]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array([a for a, _ in made], pa.list_(pa.int64())),
                     pa.array([b for _, b in made], pa.list_(pa.int64())),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                    names=["key", "vec_id", "label", "v", "lows", "highs", "spans"])

    shape = f"{ROW}, lows array<bigint>, highs array<bigint>, spans array<struct<first:bigint,last:bigint>>"
    return (queries.select("key", "vec_id", "label", "v", "scores").mapInArrow(run, shape)
            .select("*", F.explode("spans").alias("span")).drop("spans")
            .select("*", F.explode(F.sequence("span.first", "span.last")).alias("chunk")).drop("span"))


def best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``count`` largest allowed scores of each row; the first columns win ties."""
    wide = scores.shape[1]
    if scores.dtype == object or np.abs(scores).max(initial=0) >= (1 << 62) // max(wide, 1):
        rank = scores.astype(object) * wide + (wide - 1 - np.arange(wide)).astype(object)
        picks = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: -rank[i, j])[:count]]
        return np.array([p[0] for p in picks], np.int64), np.array([p[1] for p in picks], np.int64)
    rank = np.where(allowed, scores * wide + (wide - 1 - np.arange(wide)), LEAST)
    at = np.argpartition(rank, wide - count, axis=1)[:, wide - count:] if wide > count else np.broadcast_to(np.arange(wide), rank.shape)
    row = np.repeat(np.arange(len(scores)), at.shape[1])
    use = allowed[row, at.ravel()]
    return row[use], at.ravel()[use]


def searched(placed: DataFrame, queries: DataFrame, tree: Tree, same: bool, count: int) -> DataFrame:
    """(anchor, key, window, vec_id, score): candidates that hold the ``count`` best rows of every query and window.

    Rows have the query's label if ``same``, and another one otherwise; the query's own id is never found.  Equal rows count once.
    """
    none = F.lit(None).cast("array<bigint>")
    data = placed.select(chunk_of(tree).alias("chunk"), F.lit(0).alias("kind"), "key", "vec_id", "label", "v",
                         none.alias("lows"), none.alias("highs"))
    asked = queries.select("chunk", F.lit(1).alias("kind"), "key", "vec_id", "label", "v", "lows", "highs")
    dealt = data.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None

        def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = np.concatenate([p[0] for p in parts])
            _, one = np.unique(key, return_index=True)
            ids = np.concatenate([p[1] for p in parts])[one]
            order = np.argsort(ids, kind="stable")
            label = np.concatenate([p[2] for p in parts])[one][order]
            width = max(p[3].shape[1] for p in parts)
            v = np.concatenate([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts])[one][order]
            return key[one][order], ids[order], label, v

        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
            edges = [0, *change.tolist(), len(batch)] if len(batch) else []
            for start, end in zip(edges, edges[1:]):
                part = batch.slice(start, end - start)
                if chunk[start] != at:
                    at, parts, held = chunk[start], [], None
                if kind[start] == 0:
                    parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5))))
                    if sum(len(p[0]) for p in parts) > 4 * CHUNK:
                        parts = [gathered()]  # repeated rows go early
                    continue
                if not parts:
                    continue
                held = held or gathered()
                step = max(1, BLOCK // len(held[0]))
                for i in range(0, len(part), step):
                    yield from answers(part.slice(i, step), *held[1:])

    def answers(asked: pa.RecordBatch, ids: np.ndarray, label: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, anchor, mine = (asked.column(i).to_numpy() for i in (2, 3, 4))
        scores = products(matrix(asked.column(5)), v)
        fits = ((label == mine[:, None]) == same) & (ids != anchor[:, None])
        lows, highs = asked.column(6).to_pylist(), asked.column(7).to_pylist()
        for w in range(max((len(low) for low in lows), default=0)):
            low = np.array([x[w] if w < len(x) else MOST for x in lows])[:, None]
            high = np.array([x[w] if w < len(x) else LEAST for x in highs])[:, None]
            row, column = best(scores, fits & (scores >= low) & (scores <= high), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[row]), pa.array(key[row]), pa.array(np.full(len(row), w, np.int32)), pa.array(ids[column]),
                 pa.array(longs(scores[row, column]))], names=["anchor", "key", "window", "vec_id", "score"])

    return dealt.mapInArrow(run, "anchor long, key long, window int, vec_id long, score long")


def first(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` best of each query and window, with their ``rank``."""
    order = Window.partitionBy("anchor", "key", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(df: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = 30, high: int = 90, sample: int = SAMPLE, fanout: int = FANOUT,
                   leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives of the rows of ``df`` (vec_id, embedding, label) that ``is_anchor`` marks.

    For each anchor and each of its ``positives`` best rows of its own label: the ``negatives`` best rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's.  A score is the inner product of floor(256 * x); ties go to the
    smaller vec_id.  Rows with a null id, label or vector, or a null or non-finite component, take no part.  A shorter vector counts as
    padded with zeros, an empty one scores 0 with all.  Rows equal in id, label and vector count once; rows with one id and
    different vectors are rows of their own, and none of them is found for another of its id.  Scores are exact; rows whose score
    lies beyond 64 bits are not found.  Anchors without positives and positives without negatives have no rows; an empty table gives none.
    """
    tree, placed = fitted(points_of(df, relabel), sample, fanout, leaf, chunk)
    anchors = placed.filter(is_anchor).dropDuplicates(["vec_id", "key"])
    # The best rows in the anchor's own chunk bound the score of the last positive, and so the annulus of the search.
    open_ended = [F.array(F.lit(x)).alias(n) for x, n in ((LEAST, "lows"), (MOST, "highs"))]
    near = searched(placed, anchors.select("*", chunk_of(tree).alias("chunk"), *open_ended), tree, True, positives)
    reach = near.groupBy(F.col("anchor").alias("vec_id"), "key").agg(
        F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    bounded = anchors.join(reach, ["vec_id", "key"], "left").withColumn(
        "scores", F.array(F.coalesce("least", F.lit(LEAST))))
    found = first(searched(placed, aimed(bounded, tree, lambda s: (s, [MOST])), tree, True, positives), positives)
    chosen = saved(found.groupBy("anchor", "key").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("chosen")), "hard-negatives-positives")
    windowed = anchors.join(chosen.select(F.col("anchor").alias("vec_id"), "key", F.col("chosen.score").alias("scores")),
                            ["vec_id", "key"])
    mined = first(searched(placed, aimed(windowed, tree, lambda s: windows_below(s, low, high)), tree, False, negatives), negatives)
    return mined.join(chosen, ["anchor", "key"]).select(
        F.col("anchor").alias("anchor_id"), F.get("chosen", F.col("window"))["positive_id"].alias("positive_id"), "rank",
        F.col("vec_id").alias("negative_id"), F.get("chosen", F.col("window"))["score"].alias("positive_score"),
        F.col("score").alias("negative_score"))


SQL = """
WITH kept AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(r.v)) + 1), lambda i: a.v[i] * r.v[i])), 0) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE s.label <> p.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
