"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its (larger, or smaller) neighbours to the smallest node it knows."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select("a", "m"))
    return moved.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node that occurs in `links`, with the smallest node it is connected to.

    Nulls and self-links add no connection; a node that occurs only in a self-link is its own component. Minima are
    taken by partial aggregation and joined back, so a hub of any degree is never collected. Each round is written to
    the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = materialize(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        step = materialize(_star(_star(edges, True), False))
        size = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges, same, before = step, tuple(size) == before, tuple(size)
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    labelled = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = labelled.select(F.col("component").alias("node"), "component").distinct()
    known = labelled.union(roots)
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct().join(known, "node", "left_anti")
    return known.union(alone.select("node", F.col("node").alias("component")))
