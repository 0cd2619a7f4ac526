"""Merging the centres of several sites: optimal one-to-one alignment and Ward's hierarchy.

Centres are summaries, MOST_CENTRES at most (else ValueError); points never come here.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import MOST_CENTRES, gathered, mean_vectors, squared_distance


def _checked(centres: DataFrame) -> int:
    n = centres.count()
    if n > MOST_CENTRES:
        raise ValueError("too many centres to merge")
    return n


def cheapest_pairs(cost: np.ndarray) -> np.ndarray:
    """For each row of a square cost matrix its column, so that the sum of costs is least; rows enter one by one along shortest paths."""
    n = len(cost)
    of_column, row_price, column_price = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        reach, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column, length, rows_seen = start, -1, 0.0, [(start, 0.0)]
        while True:
            through = length + cost[row] - row_price[row] - column_price
            closer = ~done & (through < reach)
            reach[closer], came[closer] = through[closer], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            length, done[column] = reach[column], True
            if of_column[column] < 0:
                break
            row = of_column[column]
            rows_seen.append((row, length))
        for r, at in rows_seen:
            row_price[r] += length - at
        column_price[done] -= length - reach[done]
        while column >= 0:  # along the path each row moves to the next column
            before = came[column]
            of_column[column] = of_column[before] if before >= 0 else start
            column = before
    out = np.empty(n, int)
    out[of_column] = np.arange(n)
    return out


def aligned(centres: DataFrame) -> DataFrame:
    """site, k, n, c, place: each site's centres matched one to one with those of the smallest site at the least total distance.

    (site, k, n, c). place is the k of the partner; where a site has more centres than the first one, those over have none (null).
    One group a site, of its own centres and the first site's.
    """
    _checked(centres)
    first = centres.agg(F.min("site").alias("site"))
    others = centres.select(F.col("site").alias("to")).distinct()
    base = centres.join(F.broadcast(first), "site").select(F.col("k").alias("bk"), F.col("c").alias("bc")).crossJoin(F.broadcast(others))

    def match(own: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        own, ref = own.sort_values("k").reset_index(drop=True), ref.sort_values("bk").reset_index(drop=True)
        a, b = np.stack(own["c"].to_numpy()), np.stack(ref["bc"].to_numpy())
        size = max(len(a), len(b))
        cost = np.zeros((size, size))
        cost[: len(a), : len(b)] = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        to = cheapest_pairs(cost)[: len(a)]
        own["place"] = pd.array([int(ref["bk"][t]) if t < len(b) else None for t in to], dtype="Int64")
        return own

    return centres.select("site", "k", "n", "c").groupBy("site").cogroup(base.groupBy("to")).applyInPandas(match, "site long, k long, n long, c array<double>, place long")


def aligned_mean(centres: DataFrame) -> DataFrame:
    """k, c: the mean of aligned centres weighted by their sizes n; the plain mean where all sizes are 0."""
    rows = aligned(centres).where("place is not null")
    weighed = rows.withColumn("w", F.when(F.sum("n").over(Window.partitionBy("place")) > 0, F.col("n").cast("double")).otherwise(1.0))
    return gathered(mean_vectors(weighed, ["place"], "c", "w"), ["place"]).withColumnRenamed("place", "k")


def ward_labels(points: DataFrame, k: int) -> DataFrame:
    """id, label: k clusters of (id, c) by Ward's hierarchy; the label is the smallest id of the cluster.

    Each round merges every pair that are each other's nearest, which gives the same hierarchy as one merge at a time; then the
    n - k lowest merges are kept. Tables are cut by checkpoint(). k or fewer points: each its own.
    """
    n = left = _checked(points)
    nodes, rounds = points.select("id", F.lit(1.0).alias("n"), "c"), []
    while left > 1:
        other = nodes.select(F.col("id").alias("o"), F.col("n").alias("m"), F.col("c").alias("e"))
        height = F.col("n") * F.col("m") / (F.col("n") + F.col("m")) * squared_distance(F.col("c"), F.col("e"))
        near = nodes.join(F.broadcast(other), F.col("id") != F.col("o")).groupBy("id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.min(F.struct(height.alias("h"), "o", "m", "e")).alias("t"))
        theirs = near.select(F.col("id").alias("o"), F.col("t.o").alias("back"))
        step = near.select("id", "n", "c", "t.*").join(F.broadcast(theirs), "o").withColumn("mutual", F.col("back") == F.col("id")).checkpoint()
        merges = step.where("mutual and id < o").select(F.col("id").alias("a"), F.col("o").alias("b"), "h")
        left -= merges.count()
        joint = F.zip_with("c", "e", lambda x, y: (F.col("n") * x + F.col("m") * y) / (F.col("n") + F.col("m")))
        nodes = step.where("not mutual or id < o").select("id", F.when(F.col("mutual"), F.col("n") + F.col("m")).otherwise(F.col("n")).alias("n"), F.when(F.col("mutual"), joint).otherwise(F.col("c")).alias("c"))
        rounds.append(merges)
    labels = points.select("id", F.col("id").alias("label"))
    if not rounds or n <= k:
        return labels
    numbered = reduce(DataFrame.unionByName, [m.withColumn("step", F.lit(i)) for i, m in enumerate(rounds)])
    kept = numbered.withColumn("at", F.row_number().over(Window.orderBy("h", "step", "a"))).where(F.col("at") <= n - k).checkpoint()  # n - 1 rows, checked above
    for i in range(len(rounds)):
        step = kept.where(F.col("step") == i).select(F.col("b").alias("label"), "a")
        labels = labels.join(F.broadcast(step), "label", "left").select("id", F.coalesce("a", "label").alias("label"))
    return labels


def ward_merge(centres: DataFrame, k: int) -> DataFrame:
    """label, c: the centres (site, k, n, c) of all sites in k clusters by Ward, each the mean weighted by n; plain if all n are 0."""
    keyed = centres.withColumn("id", F.row_number().over(Window.orderBy("site", "k")).cast("long"))  # summaries, checked in ward_labels
    rows = keyed.join(F.broadcast(ward_labels(keyed.select("id", "c"), k)), "id")
    weighed = rows.withColumn("w", F.when(F.sum("n").over(Window.partitionBy("label")) > 0, F.col("n").cast("double")).otherwise(1.0))
    return gathered(mean_vectors(weighed, ["label"], "c", "w"), ["label"])
