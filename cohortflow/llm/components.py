"""Connected components of a link table, by hooking and pointer jumping on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a long, b long) to (node long, component long): each linked node and the smallest node it reaches.

    Every round hooks each remaining component to its smallest neighbour, follows these pointers to their
    roots by doubling, and contracts the links, so at least half of the remaining components go each
    round. Minima are aggregated before they are shuffled, and joins are between written tables, so a node with a large share
    of the links is split by adaptive execution. Links to itself, repeated links and links with a null are ignored.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("up")))
        up = scratch.keep(both.groupBy("node").agg(F.least(F.min("up"), F.col("node")).alias("up")), "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = scratch.keep(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            if up.where("moved").isEmpty():
                break
        up = up.select("node", "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            over = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
            labels = scratch.keep(labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("up_a <> up_b").select(F.greatest("up_a", "up_b").alias("a"), F.least("up_a", "up_b").alias("b"))
        edges = scratch.keep(moved.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
