"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of every node on its smallest one. Minima combine before the shuffle; the join of a
    hub's neighbours with its minimum is left to the adaptive split of skewed joins."""
    n = _both(edges)
    low = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return n.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs the smaller neighbours of every node, and the node itself, on the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component), for every node with a link; edges have columns a and b."""
    now = scratch.save(edges.select("a", "b").filter("a <> b").distinct())
    state = None
    while True:
        done = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(done) == state or done[0] == 0:
            break
        state = tuple(done)
        old, now = now, scratch.save(_small_star(_large_star(now)))
        scratch.drop(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
