"""An exact index for nearest neighbours: balls around pivots, and what the triangle inequality rules out.

Points are dealt to their nearest pivot and there to rings of distance from it; a ball is one ring, or a part of it, of bounded size. From a query's
distance to the pivot and a ball's inner and outer radius follow the least and the greatest distance of its points. A first pass compares each
query with the ball that may hold the nearest point, which gives a bound on its k-th distance; the second compares it with every other ball that the
bound leaves open. What is shuffled is a query for each ball that it opens, not for each part of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS = 1_024  # at most; their vectors and the balls' radii go to every task
RINGS = 16
QUERIES = 4_096  # queries that meet a ball in one task
BOUNDS = 1 << 22  # bounds that are held at once


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots**2).sum(1)[None, :]
    return np.sqrt(np.maximum(d2, 0.0))


class Balls:
    """The index over points (id, x); rows with a null id or x are left out. Vectors have one length."""

    def __init__(self, points: DataFrame, size: int = 1_024):
        self.spark, self.size = points.sparkSession, size
        points = points.select("id", "x").where("id is not null and x is not null")
        n = points.count()
        chosen = points.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, math.isqrt(n)))).collect()
        self.pivots = np.array([r["x"] for r in chosen], float) if n else np.zeros((0, 0))
        self.slack = 1e-6 * (1.0 + float(np.sqrt((self.pivots**2).sum(1)).max(initial=0.0)))  # over what rounding does to a distance
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_024):
                    part = batch.slice(at, 1_024)
                    d = _distances(_matrix(part.column("x")), pivots)
                    near = d.argmin(1)
                    yield pa.record_batch([part.column("id"), part.column("x"), pa.array(near, pa.int64()), pa.array(d[np.arange(len(d)), near])], ["id", "x", "pivot", "far"])

        placed = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).mapInArrow(place, "id long, x array<double>, pivot long, far double").checkpoint() if n else points.limit(0).selectExpr("cast(id as long) id", "cast(x as array<double>) x", "0L as pivot", "0D as far")
        edges = placed.groupBy("pivot").agg(F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1_000).alias("edges"), F.count(F.lit(1)).alias("n"))
        rings = F.when(F.col("n") > size, F.size(F.filter("edges", lambda e: e < F.col("far")))).otherwise(0)
        ringed = placed.join(F.broadcast(edges), "pivot").select("id", "x", "pivot", "far", rings.alias("ring"))  # a row a pivot
        counts = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        dealt = ringed.join(F.broadcast(counts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        radii = dealt.groupBy("pivot", "ring", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("pivot", "ring", "part").toPandas()  # a row a ball
        radii["ball"] = np.arange(len(radii))
        self.radii = radii
        numbers = self.spark.createDataFrame([(int(p), int(r), int(q), int(b)) for p, r, q, b in radii[["pivot", "ring", "part", "ball"]].to_numpy().tolist()], "pivot long, ring int, part long, ball long")
        self.points = dealt.join(F.broadcast(numbers), ["pivot", "ring", "part"]).select("ball", "id", "x").checkpoint()

    def opened(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """ball, query_id, x, bound for the balls that queries (query_id, x, bound, seen) open: the first alone, or all but the one seen.

        bound is no less than the k-th distance: what the caller knows, or what follows from the balls' radii and sizes.
        """
        pivots, slack = self.pivots, self.slack
        pivot, low, high, n, balls = (self.radii[c].to_numpy() for c in ("pivot", "low", "high", "n", "ball"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, BOUNDS // max(1, len(balls)))
            for batch in batches:
                for at in range(0, batch.num_rows if len(balls) else 0, step):
                    part = batch.slice(at, step)
                    d = _distances(_matrix(part.column("x")), pivots)[:, pivot]
                    least = np.maximum(np.maximum(d - high, low - d), 0.0) - slack
                    if first:
                        most = d + high + slack
                        order = np.argsort(most, axis=1)
                        enough = (np.cumsum(n[order], axis=1) >= k).argmax(1)
                        rows = np.arange(len(d))
                        bound = np.where(n.sum() >= k, most[rows, order[rows, enough]], np.inf)
                        which = np.lexsort((most, least), axis=1)[:, 0]
                        yield pa.record_batch([pa.array(balls[which], pa.int64()), part.column("query_id"), part.column("x"), pa.array(bound)], ["ball", "query_id", "x", "bound"])
                        continue
                    bound, seen = (part.column(c).to_numpy(zero_copy_only=False) for c in ("bound", "seen"))
                    rows, which = np.nonzero((least <= bound[:, None]) & (balls[None, :] != seen[:, None]))
                    for cut in range(0, len(rows), 10_000):
                        own = pa.array(rows[cut : cut + 10_000])
                        yield pa.record_batch([pa.array(balls[which[cut : cut + 10_000]], pa.int64()), part.column("query_id").take(own), part.column("x").take(own), pa.array(bound).take(own)], ["ball", "query_id", "x", "bound"])

        return queries.mapInArrow(run, "ball long, query_id long, x array<double>, bound double")

    def _compared(self, opened: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """query_id, id, d: the k nearest points in each ball that a query opens, none beyond its bound."""
        slack = self.slack
        parts = opened.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))  # a row a ball
        asking = opened.join(F.broadcast(parts), "ball").select("ball", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"), "query_id", "x", "bound")
        again = parts.select(F.col("ball").alias("at"), F.col("parts").alias("n"))
        asked = self.points.join(F.broadcast(again), F.col("ball") == F.col("at")).select("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1).cast("array<bigint>")).alias("of"), "id", "x")

        def reduce(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return pd.DataFrame()
            ids, x, found = p["id"].to_numpy(), np.stack(p["x"].to_numpy()), []
            for query, own, bound in zip(q["query_id"].to_numpy(), q["x"].to_numpy(), q["bound"].to_numpy(), strict=True):
                d = np.sqrt(((x - own) ** 2).sum(axis=1))
                fits = d <= bound + slack
                if skip_self:
                    fits &= ids != query
                at = np.flatnonzero(fits)
                at = at[np.lexsort((ids[at], d[at]))[:k]]
                found.append((np.full(len(at), query), ids[at], d[at]))
            a, b, c = (np.concatenate(v) for v in zip(*found, strict=True))
            return pd.DataFrame({"query_id": a, "id": b, "d": c})

        return asking.groupBy("ball", "part").cogroup(asked.groupBy("at", "of")).applyInPandas(reduce, "query_id long, id long, d double")

    def passes(self, queries: DataFrame, k: int, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """What queries (id, x) open in the first and in the second pass."""
        asked = queries.where("id is not null and x is not null").select(F.col("id").cast("long").alias("query_id"), F.col("x").cast("array<double>").alias("x")).dropDuplicates(["query_id", "x"])
        k += skip_self
        first = self.opened(asked, k, True).checkpoint()
        self.seen = self._compared(first, k, False).checkpoint()
        known = self.seen.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("kth"))
        bounded = first.join(known, "query_id", "left").select("query_id", "x", F.least("bound", F.coalesce("kth", "bound")).alias("bound"), F.col("ball").alias("seen"))
        return first, self.opened(bounded, k, False).checkpoint()

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """query_id, id, d, rank from 1: the k nearest points of each query, the smaller id of equals; itself left out if ``skip_self``."""
        first, second = self.passes(queries, k, skip_self)
        found = self.seen.unionByName(self._compared(second, k + skip_self, False))
        if skip_self:
            found = found.where("query_id <> id")
        order = Window.partitionBy("query_id").orderBy("d", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
