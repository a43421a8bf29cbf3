"""K-means in exact integers, with heaps of bound gaps that say which vectors a round must look at.

A vector's gap is the distance to its second nearest centroid minus that to its own.  Until its next exact scan the gap
shrinks at most by what its own centroid and the fastest other one have moved since, so a vector entered with
gap + drift so far stays where it is as long as that key is above the drift of its cluster now.  Each block of
vectors keeps one heap of keys per cluster; a round pops the keys that have expired off the top, scans only those vectors
against all centroids, and pushes them where they now belong.  A heap is kept as an ascending array, so its top is a prefix.

Blocks are rows of a table that every round writes anew; sums and counts of the clusters change by what has moved, and only
they (one row of integers per cluster) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved
from tickloom.llm.vectors import lists, longs, norms, squared, usable

BLOCK = 1_024  # vectors of a block
SLACK = 1e-9  # relative; covers the rounding of square roots
STATE = ("ids array<bigint>, v array<bigint>, heap_rows array<int>, heap_keys array<double>, heap_starts array<int>, "
         "moved array<struct<cluster:int,n:bigint,total:array<bigint>>>")


def points_of(df: DataFrame, size: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``size`` components, none of them null or non-finite."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding")).filter("embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, values = usable(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), lists(sizes, values)], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v array<bigint>")


def blocks_of(points: DataFrame, size: int, block: int) -> DataFrame:
    """One row per ``block`` vectors of a partition, in no cluster yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, block) for i in range(0, len(whole), block)):
                yield state_row(batch.column(0), batch.column(1).flatten(), np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), [])

    return points.mapInArrow(run, STATE)


def state_row(ids: pa.Array, v: pa.Array, rows: np.ndarray, keys: np.ndarray, starts: np.ndarray, moved: list[dict]) -> pa.RecordBatch:
    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(
        [one(ids), one(v), one(pa.array(rows.astype(np.int32))), one(pa.array(keys.astype(np.float64))),
         one(pa.array(starts.astype(np.int32))), pa.array([moved], kind)],
        names=["ids", "v", "heap_rows", "heap_keys", "heap_starts", "moved"])


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, gap) by exact distances; the smaller number wins ties, and a gap is rounded down."""
    away = squared(v, centroids)
    own = away.argmin(axis=1)
    at = np.arange(len(v))
    mine = np.sqrt(away[at, own].astype(np.float64))
    if len(centroids) == 1:
        return own, np.full(len(v), np.inf)
    away[at, own] = away.max() + 1
    other = np.sqrt(away.min(axis=1).astype(np.float64))
    return own, other - mine - SLACK * (1 + other + mine)


def sums(v: np.ndarray, cluster: np.ndarray, sign: int, out: dict[int, tuple[int, np.ndarray]]) -> None:
    for c in np.unique(cluster):
        mine = v[cluster == c]
        n, total = out.get(int(c), (0, np.zeros(v.shape[1], np.int64)))
        out[int(c)] = n + sign * len(mine), total + sign * mine.sum(axis=0)


def advance(v: np.ndarray, rows: np.ndarray, keys: np.ndarray, starts: np.ndarray, centroids: np.ndarray,
            drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict], int]:
    """One block's heaps (rows, keys, starts) after an assignment, what has moved, and how many vectors were scanned."""
    k = len(centroids)
    changed: dict[int, tuple[int, np.ndarray]] = {}
    if len(starts) < k + 1:
        popped, old, tops = np.arange(len(v)), None, np.zeros(k, np.int64)
        starts = np.zeros(k + 1, np.int64)
    else:
        tops = np.array([np.searchsorted(keys[a:b], d + SLACK * (1 + d), "right") for a, b, d in zip(starts, starts[1:], drift)])
        popped = np.concatenate([rows[a:a + t] for a, t in zip(starts, tops)]) if tops.any() else np.zeros(0, np.int64)
        old = np.repeat(np.arange(k), tops)
    own, gap = nearest(v[popped], centroids) if len(popped) else (np.zeros(0, np.int64), np.zeros(0))
    if old is None:
        sums(v, own, 1, changed)
    else:
        left = own != old
        sums(v[popped[left]], old[left], -1, changed)
        sums(v[popped[left]], own[left], 1, changed)
    new_key = gap + drift[own]
    heaps, heap_keys = [], []
    for c in range(k):
        stay = slice(starts[c] + tops[c], starts[c + 1])
        come = np.flatnonzero(own == c)
        come = come[np.argsort(new_key[come], kind="stable")]
        at = np.searchsorted(keys[stay], new_key[come], "right")
        heaps.append(np.insert(rows[stay], at, popped[come]))
        heap_keys.append(np.insert(keys[stay], at, new_key[come]))
    ends = np.cumsum([0, *map(len, heaps)])
    moved = [{"cluster": c, "n": n, "total": total.tolist()} for c, (n, total) in changed.items()]
    return np.concatenate(heaps), np.concatenate(heap_keys), ends, moved, len(popped)


def assigned(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after one assignment; ``moved`` says by what the vectors and sums of each cluster have changed.

    ``drift`` is each cluster's drift so far.  A block that has no heaps yet is scanned whole.
    """
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, flat, rows, keys, starts = (batch.column(c).slice(i, 1).flatten() for c in range(5))
                v = flat.to_numpy().reshape(-1, width)
                yield state_row(ids, flat, *advance(v, rows.to_numpy(), keys.to_numpy(), starts.to_numpy(), centroids, drift)[:4])

    return blocks.mapInArrow(run, STATE)


def changes(blocks: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed changes of all blocks: vectors per cluster, and components per cluster."""
    moved = blocks.select(F.explode("moved").alias("m")).select("m.*")
    got = moved.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("total"))).alias("at", "value")) \
        .groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect()
    n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for cluster, at, value in got:
        if at == 0:
            n[cluster] = value
        else:
            total[cluster, at - 1] = value
    return n, total


def started(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal hashes by components."""
    rows = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v") \
        .orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a gap of each cluster may shrink: its own way plus the longest way of another."""
    way = np.sqrt(np.array([longs(norms(a[None] - b[None]))[0] for a, b in zip(new, old)], np.float64))
    others = np.array([np.delete(way, c).max(initial=0) for c in range(len(way))])
    return (way + others) * (1 + SLACK)


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector with ``size`` finite components.

    Components are floor(256 * x), centroids floor(sum / count) by component, distances squared; ties go to the smaller number.  A
    centroid without vectors stays.  Fewer than ``k`` vectors make as many centroids; repeated rows count, and are returned, as often as
    they occur, and so may repeat a centroid; a null id hashes as the empty text; an empty table gives an empty result.  Components
    summed over a cluster, and squared distances summed over all, must fit in 64 bits.
    """
    points = points_of(df, size)
    centroids = started(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    blocks = blocks_of(points, size, block)
    n, total, drift = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), np.zeros(len(centroids))
    for _ in range(rounds):
        blocks = saved(assigned(blocks, centroids, drift), "heap-kmeans-round")
        more, sums_more = changes(blocks, *centroids.shape)
        n, total = n + more, total + sums_more
        new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
        drift, centroids = drift + drifts(centroids, new), new
    return measured(assigned(blocks, centroids, drift), centroids)


def measured(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row per vector with its exact distance, and the sums over its cluster and over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, flat, rows, starts = (batch.column(c).slice(i, 1).flatten() for c in range(4))
                cluster = np.zeros(len(ids), np.int32)
                cluster[rows.to_numpy()] = np.repeat(np.arange(len(centroids)), np.diff(starts.to_numpy()))
                v = flat.to_numpy().reshape(len(ids), -1)
                away = norms(v - centroids[cluster])
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(longs(away))], names=["vec_id", "cluster", "distance"])

    rows = saved(blocks.select("ids", "v", "heap_rows", "heap_starts").mapInArrow(run, "vec_id long, cluster int, distance long"),
                 "heap-kmeans-assigned")
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    named = rows.sparkSession.createDataFrame([(c, v.tolist()) for c, v in enumerate(centroids)], "cluster int, centroid array<bigint>") \
        .select("cluster", F.sha2(text, 256).alias("centroid_sha256"))
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most one row per centroid
    facts = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))).join(F.broadcast(named), "cluster")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    parts = ["""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
c0 AS (SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS cluster, v AS c FROM kept
  WINDOW w AS (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) QUALIFY row_number() OVER w <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(cluster, struct_pack(d := d, n := cluster)) AS cluster, min(d) AS distance FROM (
  SELECT k.rowid_, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
  FROM (SELECT row_number() OVER () AS rowid_, * FROM kept) k CROSS JOIN c{r}) GROUP BY rowid_, vec_id)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT cluster, i, sum(v[i]) AS t, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) r(i) GROUP BY ALL),
m{r} AS (SELECT cluster, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query("op12_heap_kmeans", _sql())
def op12_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
