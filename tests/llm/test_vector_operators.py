"""Hard negatives, centroid clustering and language identification against brute force and held-out accuracy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tickloom.llm import hard_negatives as H, heap_kmeans as K, language_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, score string, v string, leaf string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "c") for r in rows], SCHEMA)


def whole(x):
    return [math.floor(256 * c) for c in x]


def mined(rows, positives, negatives):
    """The result by its definition, over all pairs."""
    kept = {(i, l, tuple(whole(x))) for i, x, l in rows if None not in (i, x, l) and all(c is not None and math.isfinite(c) for c in x)}
    out = []
    for a, label, v in kept:
        if a % 5:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, m) for i, m, w in kept if i != a]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)[:negatives]
            out += [(a, i, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fits)]
    return sorted(out)


def vectors(seed, count, width, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    return (middle[rng.integers(0, 6, count)] + spread * rng.normal(size=(count, width))).round(2).tolist()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_equal_brute_force(spark, spread):
    rows = [(i, x, i % 3) for i, x in enumerate(vectors(3, 240, 6, spread))]
    rows += [(500 + i, rows[7][1], i % 3) for i in range(40)]  # one vector under many ids
    rows += [(600, [], 1), (601, [0.5], 0), (602, [1e6] + [0.0] * 5, 0), (603, [-1e6] * 6, 1), (605, [2e6] * 6, 2)]  # short and large
    rows += [(700, None, 1), (705, [float("nan")] * 6, 1), (710, [None, 1.0], 1), (715, [float("inf")], 0), (None, [1.0] * 6, 1), (720, [1.0] * 6, None)]
    rows += rows[10:25] + [(15, [0.25] * 6, 2)]  # repeated rows, and one id with two vectors
    got = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, positives=3, negatives=4, sample=100, fanout=4, leaf=10, chunk=16)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 3, 4)


def test_hard_negatives_of_nothing(spark):
    assert H.hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    huge = [(i, [1e200, -1e17 * i], i % 2) for i in range(12)]  # scores beyond a long are not found
    assert H.hard_negatives(frame(spark, huge), F.col("vec_id") % 5 == 0).count() == 0
    alone = [(0, [1.0, 2.0], 1), (5, [1.0, 2.0], 2)]
    assert H.hard_negatives(frame(spark, alone), F.col("vec_id") % 5 == 0).count() == 0


def test_no_window_loses_a_row():
    rng = np.random.default_rng(5)
    rows = np.array([[math.floor(256 * c) for c in v] for v in vectors(9, 900, 5, 0.1)])
    tree = H.Tree()
    tree.grow(rows[:300], 5, 12)
    leaf = tree.place(rows)
    for number, node in enumerate(tree.nodes):
        side = tree.below(number)
        n = len(node.points)
        away = np.sqrt(((rows[:, None] - node.points[None]) ** 2).sum(2))
        child = np.array([side.get(x, -1) for x in leaf])
        size = (rows * rows).sum(1)
        node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        node.shortest, node.longest = np.full(n, np.inf), np.full(n, -np.inf)
        for j in set(child) - {-1}:
            node.low[:, j], node.high[:, j] = away[child == j].min(0), away[child == j].max(0)
            node.shortest[j], node.longest[j] = size[child == j].min(), size[child == j].max()
    asked = rows[rng.integers(0, len(rows), 60)]
    scores = asked @ rows.T
    low = np.quantile(scores, 0.9, axis=1)[:, None]
    high = np.quantile(scores, 0.93, axis=1)[:, None]
    hit = tree.reached(asked, low, high)
    fits = (scores >= low) & (scores <= high)
    assert all(hit[q, leaf[r]] for q, r in zip(*np.nonzero(fits)))
    assert not hit.all()  # the ranges do rule subtrees out


def lloyd(points, k, rounds):
    """(vec_id, cluster, distance) and centroids by their definition."""
    order = sorted(points, key=lambda p: (hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1]))
    centroids = [list(p[1]) for p in order[:k]]
    for at in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in points]
        if at < rounds:
            for n in range(len(centroids)):
                mine = [v for (_, v), (_, own) in zip(points, near) if own == n]
                if mine:
                    centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(points, near)], centroids


@pytest.mark.parametrize("k,block", [(7, 16), (12, 1000), (400, 64)])
def test_clusters_equal_brute_force(spark, k, block):
    rows = [(i, x, 0) for i, x in enumerate(vectors(8, 260, 4, 0.4))]
    rows += [(1000 + i, rows[3][1], 0) for i in range(60)] + rows[20:30]
    bad = [(2000, None, 0), (2001, [1.0] * 3, 0), (2002, [1.0, None, 1.0, 1.0], 0), (2003, [float("nan")] * 4, 0), (2004, [], 0)]
    got = K.clustered(frame(spark, rows + bad), k=k, rounds=4, size=4, block=block)
    want, centroids = lloyd([(i, whole(x)) for i, x, _ in rows], k, 4)
    per = {}
    for _, n, d in want:
        per[n] = per.get(n, 0) + d
    full = sorted((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in want)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == full


def test_clusters_of_nothing(spark):
    empty = K.clustered(frame(spark, [(1, [1.0], 0)]), size=4)
    assert empty.count() == 0 and empty.columns[0] == "vec_id"


def test_heaps_leave_most_vectors_alone():
    v = np.array([whole(x) for x in vectors(2, 1000, 8, 0.1)])
    centroids, drift = v[::150], np.zeros(7)
    rows, keys, starts, _, scanned = K.advance(v, np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), centroids, drift)
    assert scanned == 1000 and all((np.diff(keys[a:b]) >= 0).all() for a, b in zip(starts, starts[1:]))
    moved = centroids + np.arange(8) // 3
    drift = K.drifts(centroids, moved)
    rows, keys, starts, _, scanned = K.advance(v, rows, keys, starts, moved, drift)
    assert 0 < scanned < 500
    near = ((v[:, None] - moved[None]) ** 2).sum(2).argmin(1)
    assert all((near[rows[a:b]] == c).all() for c, (a, b) in enumerate(zip(starts, starts[1:])))


def test_language_held_out_accuracy(spark):
    got = queries()["op13_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    right = [r.lang == r.lang_pred for r in held]
    assert np.mean(right) > 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.03  # calibrated


def test_language_edge_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 -- 34", "en"), (103, "the and", None), (None, "und die", "de"),
           (3, "the dog", "en"), (3, "the dog", "en"), (104, "und die katze " * 40_000, "de")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    at = L.fold(F.col("doc_id"), 3)
    got = L.languages(docs, at != 1, at == 1).collect()
    assert len(got) == 68
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id > 99}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "en" and by[104].lang_pred == "de" and by[None].lang_pred == "de" and by[None].held_out is False
    nothing = L.languages(docs.withColumn("lang", F.lit(None).cast("string")), at != 1, at == 1)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert L.languages(docs.limit(0), at != 1, at == 1).count() == 0


def test_spans_give_the_n_grams_of_the_whole_text(monkeypatch):
    text = "Ä b--c  12 Straße\n\nnaïve " * 7 + "ΣΑΣ"
    monkeypatch.setattr(L, "SPAN", 10_000)
    whole_text = np.sort(np.concatenate(list(L.grams(text))))
    monkeypatch.setattr(L, "SPAN", 3)
    assert (np.sort(np.concatenate(list(L.grams(text)))) == whole_text).all()
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    assert len(whole_text) == sum(len(words) - n + 1 for n in L.SIZES) - 1  # the first boundary alone is none


def test_leader_learns_sparse_weights_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    leader = L.Leader(2)
    for _ in range(300):
        y = int(rng.integers(2))
        at = np.array([y, 5, 10 + int(rng.integers(2000))])
        leader.learn(at, np.array([1.0, 1.0, 0.02, 1.0]), y)
    w = leader.weights(slice(None))
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[10:2010].any()  # noise has no weight
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(logits)])
    assert abs(L.temperature(5 * logits, labels) - 5) < 0.5 and L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1
