"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved, text_key
from tickloom.llm.wordhash import mix, numbers, portions, shingle_hashes, words

PLACES = 1 << 20  # size of the permuted universe
BANDS, ROWS = 32, 6  # a pair at 0.85 shares no band in 3 of 10 million cases, one at 0.8 in 6 of 100,000
SMALL = 6  # a bucket of so many texts is compared pair by pair: at most 2.5 pairs for each of its texts
NEAR = 50  # percent of similarity with a hub from which on its differences are kept
WORTH = 0.1  # share of a round's comparisons with hubs that must settle a text for another round
SIGNED = "doc_id long, own binary, n_shingles long, digest binary, bands array<long>"


@functools.lru_cache(maxsize=1)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations.  The second is unrolled past its end, so each shift of it is a view of it."""
    rng = np.random.default_rng(20)
    first = rng.permutation(PLACES).astype(np.int64)
    second = rng.permutation(PLACES).astype(np.uint32)
    ring = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted k places, over the permuted set."""
    first, shifts = permutations(coordinates)
    places = first[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    out = shifts[places[:512]].min(axis=0)
    for at in range(512, len(places), 512):
        np.minimum(out, shifts[places[at:at + 512]].min(axis=0), out=out)
    return out


def signed(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", bands: int = BANDS,
           rows: int = ROWS) -> DataFrame:
    """Per row: its text's key, the size and digest of its shingle set, and one hash per band."""
    factors, tags = numbers(rows, 21), numbers(bands, 22)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            found, sizes, digests, signatures = words(batch.column(1)), [], [], []
            for i in range(len(batch)):
                own = np.unique(shingle_hashes(found.of(i), width))
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                if len(own):
                    signatures.append(signature(own, bands * rows))
            with np.errstate(over="ignore"):
                parts = np.array(signatures, np.uint64).reshape(-1, bands, rows)
                keys = mix((parts * factors).sum(axis=2, dtype=np.uint64) + tags).view(np.int64)
            has = np.array(sizes, np.int64) > 0
            offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                names=["doc_id", "own", "n_shingles", "digest", "bands"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("own"))
            .mapInArrow(sign, SIGNED))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the sorted set of each text, for (doc_id, text) of texts that have a candidate."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            found = words(batch.column(1))
            own = [np.unique(shingle_hashes(found.of(i), width)).view(np.int64) for i in range(len(batch))]
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int32)
            values = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "shingles"])

    return docs.mapInArrow(sets, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int, far: bool = False) -> DataFrame:
    """Exact similarity of ``pairs`` (a, b, ..) on full sets, as ``linked``.

    ``far`` adds, for pairs with a hub, ``diff``, the shingles that only one of the two has if they are near, and
    ``close``, whether they are so near that no text which is not near the hub can be linked with a.
    """
    common, both = F.col("common"), F.col("na") + F.col("nb") - F.col("common")
    out = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
           .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
           .withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
           .withColumn("na", F.size("sa").cast("long")).withColumn("nb", F.size("sb").cast("long"))
           .withColumn("linked", 100 * common >= similarity * both))
    columns = [*pairs.columns, "linked"]
    if far:
        near = F.col("hub") & (100 * common >= NEAR * both)
        out = out.withColumn("diff", F.when(near, F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))))
        out = out.withColumn("close", F.col("hub") & (100 * common >= (NEAR + 100 - similarity) * both))
        columns += ["diff", "close", "common", "na", "nb"]
    return out.select(*columns)


def links(classes: DataFrame, docs: DataFrame, width: int, similarity: int, name: str) -> list[DataFrame]:
    """Links between texts of different sets that decide the components, as tables of (a, b).

    A bucket holds the texts that share a band.  Small ones are compared pair by pair.  In a larger one the text that
    shares most bands with others is the hub, and the others are compared with it alone:

    * Jaccard distance obeys the triangle inequality, so a text close to the hub can be linked only with texts near it;
    * two texts that are not both linked with the hub can be linked only if they share shingles by which they differ
      from it, else neither would be closer to the other than to the hub (``third_pairs``);
    * texts close to the hub are then settled in this bucket; the rest stay for the next round, with a hub of their own.

    So no link inside a bucket is lost, and a group of copies, however large, costs one comparison for each.  Once hubs
    link few of what they are compared with, the texts left share bands by chance, and ``rare_pairs`` finds the
    links among them exactly.
    """
    spark = docs.sparkSession
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = saved(banded.join(sizes, "bucket"), f"{name}-members")
    scores = members.groupBy("rep").agg(F.sum("size").alias("score"))
    wanted = scores.join(classes, "rep").select("rep", "head.doc_id", "head.own")
    texts = (docs.withColumn("own", text_key("text")).join(wanted, ["doc_id", "own"])
             .select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id", "text"]))
    sets = saved(shingle_sets(texts, width), f"{name}-sets")
    rest = saved(members.select("bucket", "rep", "n").join(scores, "rep"), f"{name}-rest")
    found = []
    while True:
        heads = rest.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("left"),
            F.max(F.struct("score", (-F.col("rep")).alias("least"), "n")).alias("head")).filter("left > 1")
        headed = rest.join(heads, "bucket")
        few = headed.filter(F.col("left") <= SMALL)
        many = headed.filter(F.col("left") > SMALL).withColumn("to", -F.col("head.least"))
        x, y = few.select("bucket", "rep", "n"), few.select("bucket", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
        pairwise = (x.join(y, "bucket").filter("rep < rep2")
                    .filter(100 * F.least("n", "n2") >= similarity * F.greatest("n", "n2"))
                    .select(F.col("rep").alias("a"), F.col("rep2").alias("b"), F.lit(False).alias("hub")))
        to_hub = (many.filter("rep <> to")
                  .filter(100 * F.least("n", "head.n") >= NEAR * F.greatest("n", "head.n"))
                  .select(F.col("rep").alias("a"), F.col("to").alias("b"), F.lit(True).alias("hub")))
        pairs = pairwise.union(to_hub).groupBy("a", "b").agg(F.max("hub").alias("hub"))
        compared = saved(verified(pairs, sets, similarity, far=True), f"{name}-compared")
        found.append(compared.filter("linked").select("a", "b"))
        met, held = compared.filter("hub").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("close").cast("int")), F.lit(0))).first()
        last = held <= WORTH * met
        near = compared.filter("hub and diff is not null")
        if last:  # where a hub settles no text, all of them are left, and rare_pairs finds their links
            near = near.join(near.filter("close").select("b").distinct(), "b", "left_semi")
        third = saved(third_pairs(near, similarity), f"{name}-thirds")
        found.append(saved(verified(third, sets, similarity).filter("linked").select("a", "b"), f"{name}-third"))
        done = compared.filter("close").select(F.col("a").alias("rep"), F.col("b").alias("to"))
        rest = saved(many.filter("rep <> to").join(done, ["rep", "to"], "left_anti")
                     .select("rep", "bucket", "n", "score"), f"{name}-rest")
        if last:
            break
    alone = sets.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    found.append(saved(verified(rare_pairs(alone, similarity), sets, similarity).filter("linked").select("a", "b"),
                       f"{name}-left"))
    return found


def third_pairs(near: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of texts near one hub, not both linked with it, among which are all that are linked.

    Two texts share what both share with the hub, and o shingles of their differences from it, so their similarity says how
    large o must be.  If a shingle is the first that two texts share, o is at most what is left in either list of
    differences from there; pairs that cannot reach the o they need are dropped in the join, so what only sets the hub
    apart pairs nothing.
    """
    placed = saved(rarest_differences(near, similarity), "near-placed")  # read by both sides, worked out once
    x, y = placed.filter("not linked").alias("x"), placed.alias("y")
    bound = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    need = (similarity * (F.col("x.na") + F.col("y.na"))
            + (100 + similarity) * (F.col("x.nb") - F.col("x.common") - F.col("y.common")))
    one_way = (F.col("x.rep") < F.col("y.rep")) | (F.col("y.linked") & (F.col("x.rep") != F.col("y.rep")))
    return (x.join(y, (F.col("x.to") == F.col("y.to")) & (F.col("x.shingle") == F.col("y.shingle")) & one_way
                   & ((100 + similarity) * bound >= need))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def rarest_differences(near: DataFrame, similarity: int) -> DataFrame:
    """Per text and hub (rep, to), the places of its rarest differences from the hub among which any partner shares one.

    Only differences that a text not linked with the hub has, and another text too, can count; ``size`` of them are put
    in order, the rarest first.  A linked partner shares at least ``least`` of them, so one of the first size - least + 1:

    * one, and as many as the text lacks to be linked with the hub, since no partner is closer to the hub than the hub;
    * all but (100 - similarity) / similarity of its shingles, since what one of two linked texts alone differs by from
      the hub sets the two apart.

    A text with fewer than ``least`` has no partner here.
    """
    parts = near.select(F.col("a").alias("rep"), F.col("b").alias("to"), "linked", "common", "na", "nb",
                        F.explode("diff").alias("shingle"))
    held = (parts.groupBy("to", "shingle").agg(F.count(F.lit(1)).alias("held"), F.min("linked").alias("settled"))
            .filter("held > 1 and not settled").drop("settled"))
    keys = ["rep", "to", "linked", "common", "na", "nb"]
    lists = (parts.join(held, ["to", "shingle"]).groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own")))  # one text's own shingles
    lacks = F.ceil((similarity * (F.col("na") + F.col("nb")) - (100 + similarity) * F.col("common")) / (100 + similarity))
    differs = F.col("na") + F.col("nb") - 2 * F.col("common")
    lists = (lists.withColumn("size", F.size("own"))
             .withColumn("least", F.greatest(F.lit(1), lacks, differs - F.floor(
                 (100 - similarity) * F.col("na") / max(similarity, 1))).cast("int"))
             .filter("size >= least"))
    return (lists.select(*keys, "size", F.posexplode(F.slice("own", F.lit(1), F.col("size") - F.col("least") + 1))
                         .alias("place", "x"))
            .withColumn("shingle", F.col("x.shingle")).drop("x"))


def rare_pairs(sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) among which are all that reach ``similarity`` percent (prefix filter).

    Two sets that alike differ in so few members that the rarest of each, as many as may be missing and one more, have one
    in common.  Common passages are never among the rarest, so they make no pairs.
    """
    tokens = sets.select("doc_id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    held = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    ranked = (tokens.join(held, "shingle").groupBy("doc_id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("all")))  # one text's own shingles
    first = F.col("n") - F.floor((similarity * F.col("n") + 99) / 100) + 1
    rare = (ranked.select("doc_id", "n", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("x"))
            .filter("x.held > 1").select("doc_id", "n", F.col("x.shingle").alias("shingle")))
    other = rare.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), "shingle")
    return (rare.withColumnRenamed("doc_id", "a").join(other, "shingle").filter("a < b")
            .filter(100 * F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` percent or more;
    a component is named by its smallest doc_id, and that document is kept.  Texts with equal sets are one class
    before any comparison.  Candidates come from circulant MinHash bands; every link is confirmed on full sets.

    Texts with fewer words have one shingle of all of them; null, empty and blank texts have none and are linked with
    nothing.  Rows that repeat a doc_id each get the component of their own text; a row without a
    doc_id is linked with nothing and kept.  An empty table gives an empty result; other columns are not returned.
    """
    rows = _components(docs, width, similarity, key, text)
    name = F.col("first.doc_id")
    return rows.select("doc_id", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def _components(docs: DataFrame, width: int, similarity: int, key: str, text: str) -> DataFrame:
    """(doc_id, own, n_shingles, first) for every row: its text's key, and the least (doc_id, own) of its component."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    name = "near"
    rows = saved(signed(docs, width), f"{name}-signed")
    classes = saved(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "own")).alias("head"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id()), f"{name}-classes")  # a doc_id may head several classes
    found = links(classes.select("rep", "head", "n", "bands"), docs, width, similarity, name)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    named = connected_components(edges)
    groups = (classes.select("digest", "head", "rep").join(named, F.col("rep") == F.col("node"), "left")
              .select("digest", "head", F.coalesce("component", "rep").alias("component")))
    first = groups.groupBy("component").agg(F.min("head").alias("first"))
    return (rows.select("doc_id", "own", "n_shingles", "digest")
            .join(groups.join(first, "component").select("digest", "first"), "digest", "left")
            .withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", F.struct("doc_id", "own"))))
            .select("doc_id", "own", "n_shingles", "first"))


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component: the row of its smallest doc_id.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id go only where their own text is a copy; of rows
    that repeat both one stays.  Rows without a doc_id stay unless their text repeats another such row's.
    """
    rows = _components(docs, width, similarity, "doc_id", "text")
    gone = rows.filter(F.struct("doc_id", "own") != F.col("first")).select("doc_id", F.col("own").alias("_own")).distinct()
    whole = docs.select("doc_id", text_key("text").alias("_own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return (whole.join(gone, ["doc_id", "_own"], "left_anti").dropDuplicates(["doc_id", "_own"]).select("_row.*"))


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=85)
