"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.shared import saved


def _stars(links: DataFrame, keep: str) -> DataFrame:
    """Point neighbours of every node at its smallest neighbour; ``keep`` says which neighbours move.

    The smallest neighbour is an aggregate with partial sums per task, joined back on the node, so a node with very
    many neighbours is neither gathered nor windowed; its join is split where it is skewed.
    """
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select("a", "b", F.least("a", "least").alias("m")).filter(keep)
    return moved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Large-star and small-star rounds until the edges no longer change; then every node points at the smallest of
    its component.  A round costs two shuffles of the edges left and is written to shared storage, so the lineage
    stays short.  Null ends, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    links = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"),
                          F.col(b).isNotNull().alias("y")).filter("x and y and a <> b").select("a", "b").distinct())
    links = saved(links, "components")
    mark = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours of a move to the least of a's neighbourhood.
        large = _stars(both, "b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours of a, and a itself, move to the least of them.
        small = _stars(large, "b < a")
        links = saved(small.select("a", F.col("m").alias("b"))
                      .union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(),
                      "components")
        now = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    names = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
