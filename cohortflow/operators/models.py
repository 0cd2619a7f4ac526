"""Clustering runs and choice of k, all runs in one loop; principal components and importances by Spark's own estimators."""

from __future__ import annotations

import math
import statistics

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attributions, many_means
from .clusters import nearest
from .neighbours import mean_silhouettes


def _vectors(points: DataFrame) -> DataFrame:
    return points.withColumn("_x", array_to_vector("x"))


SAMPLE = 8_000  # rows that starting centres are drawn from; the fit itself uses every row


def kmeans_searches(points: DataFrame, ks: list[int], runs: int, most: int = 10_000, seed: int = 42, sample: int = SAMPLE) -> dict[int, many_means.Run]:
    """For each k the best of ``runs`` seeded fits of (x), the first of equals: all fits step together, from k-means++ starts on a bounded sample."""
    data = points.select(F.lit(0).alias("pool"), "x").where("x is not null").persist()
    try:
        drawn = many_means.start_sample(data, sample, seed)
        if not len(drawn):
            raise ValueError("no points")
        keys = [(k, i) for k in ks for i in range(runs)]
        fits = many_means.fit(data, {n: (0, many_means.seeded_centres(drawn, k, seed + i)) for n, (k, i) in enumerate(keys)}, most, 1e-4, furthest=True)
    finally:
        data.unpersist()
    return {k: fits[many_means.best_of(fits, [n for n, key in enumerate(keys) if key[0] == k])] for k in ks}


def kmeans_restarts(points: DataFrame, k: int, runs: int = 32, most: int = 10_000, seed: int = 42) -> tuple[DataFrame, float]:
    """(k, c) and the cost of the best of ``runs`` seeded fits of (x); a step of all of them is one Spark job, and only sums come back."""
    best = kmeans_searches(points, [k], runs, most, seed)[k]
    return points.sparkSession.createDataFrame([(i, c) for i, c in enumerate(best.centres.tolist())], "k long, c array<double>"), best.cost


def few_clusters(n: int, d: int) -> int:
    """The median of the root of n / 2 and 2 d, each 1 at least, as a whole number."""
    return int(statistics.median([max(1, math.isqrt(n // 2)), max(1, 2 * d)]))


def heuristic_clusters(n: int, d: int) -> int:
    """The smaller of the root of n and twice the root of d (2 at least each), within 2 and 50."""
    return max(2, min(50, max(2, math.isqrt(n)), max(2, 2 * math.isqrt(d))))


def elbow(ks: list[int], costs: list[float]) -> int:
    """The k after the first relative fall of cost that changes by less than on average to the next; else that after the largest fall."""
    falls = [(a - b) / a if a > 0 else 0.0 for a, b in zip(costs, costs[1:])]
    turns = [b - a for a, b in zip(falls, falls[1:])]
    if not turns:
        return ks[0]
    mean = sum(turns) / len(turns)
    at = next((i for i, t in enumerate(turns) if t < mean), None)
    return ks[at + 1] if at is not None else ks[falls.index(max(falls)) + 1]


def clusters_by_elbow(points: DataFrame, n: int, d: int, runs: int = 5, least: int = 2, most: int = 50) -> int:
    """k by the elbow of the best costs about the heuristic, from 5 below to 10 above."""
    about = heuristic_clusters(n, d)
    low, high = max(least, about - 5), min(most, about + 10)
    ks = list(range(low, high + 1, max(1, (high - low) // 10)))
    found = kmeans_searches(points, ks, runs, 100)
    return elbow(ks, [found[k].cost for k in ks])


def clusters_by_silhouette(points: DataFrame, n: int, d: int, runs: int = 5, least: int = 2, most: int = 50) -> list[tuple[int, float]]:
    """[(k, score)] of the k of the best mean silhouette about the heuristic, from 3 below to 7 above in steps of 2; the smaller of equals. Every point counts."""
    about = heuristic_clusters(n, d)
    ks = list(range(max(least, about - 3), min(most, about + 7) + 1, 2))
    if not ks:
        return []
    labelled = points.select("id", "x")
    for k, run in kmeans_searches(points, ks, runs, 100).items():
        centres = points.sparkSession.createDataFrame([(i, c) for i, c in enumerate(run.centres.tolist())], "k long, c array<double>")
        labelled = nearest(labelled, centres).drop("d2").withColumnRenamed("k", f"label{k}")
    scores = mean_silhouettes(labelled.checkpoint(), [f"label{k}" for k in ks])
    return [max(((k, scores[f"label{k}"]) for k in ks), key=lambda x: (round(x[1], 9), -x[0]))]


def components(points: DataFrame, n: int = 2) -> DataFrame:
    """id, pc: centred vectors on their first principal axes; the largest loading of an axis is positive."""
    data = _vectors(points)
    model = PCA(k=n, inputCol="_x", outputCol="_pc").fit(data)
    axes = model.pc.toArray()
    signs = [1.0 if axes[:, i][abs(axes[:, i]).argmax()] >= 0 else -1.0 for i in range(n)]
    projected = model.transform(data).select("id", vector_to_array("_pc").alias("pc"))
    centre = projected.agg(*[F.avg(F.col("pc")[i]).alias(f"m{i}") for i in range(n)])
    return projected.crossJoin(F.broadcast(centre)).select("id", F.array(*[(F.col("pc")[i] - F.col(f"m{i}")) * signs[i] for i in range(n)]).alias("pc"))


def boosted(points: DataFrame, label: str = "label", seed: int = 42) -> GBTClassificationModel:
    """Boosted trees on x for a 0/1 label."""
    return GBTClassifier(featuresCol="_x", labelCol=label, maxIter=10, maxDepth=4, seed=seed).fit(_vectors(points))


def top_importances(points: DataFrame, k: int, label: str = "label", seed: int = 42) -> DataFrame:
    """dim, importance: the k dimensions of x that move a boosted model's margin most (mean |Shapley value| over all rows), the earlier of equals first."""
    values = attributions.attributions(points, boosted(points, label, seed))
    return attributions.mean_attributions(values, len(points.select("x").first()["x"])).orderBy(F.desc("importance"), "dim").limit(k)
