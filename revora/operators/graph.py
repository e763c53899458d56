"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round links every vertex to the smallest vertex it knows (Kiveris et al.,
2014): neighbours above a vertex move to its minimum, then neighbours below
it.  The number of rounds grows with the logarithm of the longest path, each
round is one aggregation and one join on vertices, and no component is ever
gathered in one task: only each vertex's minimum is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import discard, materialize

MAX_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (small-star) step over distinct edges a > b."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every vertex of the edges with the smallest vertex of its component.

    Self-loops and repeated edges are allowed; null ends are left out; vertices
    of self-loops only do not appear.  An empty table gives an empty result.
    """
    now = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null and x <> y")
    now = materialize(now.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc")
    state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(MAX_ROUNDS):
        before, now = now, materialize(_star(_star(now, True), False), "cc")
        discard(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
