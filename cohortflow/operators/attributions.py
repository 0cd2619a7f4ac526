"""Shapley values of boosted trees: how much each feature moves each row's margin (path-dependent TreeSHAP over Spark's own trees).

The trees go to the tasks as flat arrays, whose size depends on the model alone; Arrow batches of rows pass through them. A subset's value at a node that splits on a
feature outside the subset is the mean of both sides, weighted by the training rows that went there. For each leaf only the features on its own path matter, so
a leaf's part in all features' values comes from the path's weights: the product of the branches' shares, with each feature in or out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2_048


@dataclass
class Leaf:
    """A leaf's value, and for each feature on its path the bounds low < x <= high that lead there and the share of training rows that kept to them."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray


def leaves(tree, weight: float) -> list[Leaf]:
    """The leaves of one Spark tree (thresholds only), their values times ``weight``."""
    found: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            names = sorted(path)
            low, high, shares = (np.array([path[f][i] for f in names]) for i in range(3))
            found.append(Leaf(weight * node.prediction(), names, low, high, shares))
            return
        split = node.split()
        f, t, n = split.featureIndex(), split.threshold(), node.impurityStats().count()
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        walk(node.leftChild(), path | {f: (low, min(high, t), share * node.leftChild().impurityStats().count() / n)})
        walk(node.rightChild(), path | {f: (max(low, t), high, share * node.rightChild().impurityStats().count() / n)})

    walk(tree._call_java("rootNode"), {})
    return found


def model_leaves(model: GBTClassificationModel) -> list[Leaf]:
    return [leaf for tree, w in zip(model.trees, model.treeWeights, strict=True) for leaf in leaves(tree, w)]


def base_value(found: list[Leaf]) -> float:
    """The margin without any feature: leaves weighted by the shares of their paths."""
    return float(sum(leaf.value * leaf.shares.prod() for leaf in found))


def shapley(x: np.ndarray, found: list[Leaf], dims: int) -> np.ndarray:
    """rows x dims: each feature's Shapley value of the sum of the leaves.

    For a leaf with path features P, a feature's gain over a subset S of the others is (in - share) * prod over S of in * prod over the rest of shares. The sums over
    subsets of one size are the coefficients of prod (share + in * t), built up feature by feature.
    """
    out = np.zeros((len(x), dims))
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        inside = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        for i, f in enumerate(leaf.features):
            sizes = np.zeros((len(x), d))  # by size of S
            sizes[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    sizes[:, 1:] = sizes[:, 1:] * leaf.shares[j] + sizes[:, :-1] * inside[:, j : j + 1]
                    sizes[:, 0] *= leaf.shares[j]
            weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            out[:, f] += leaf.value * (inside[:, i] - leaf.shares[i]) * (sizes @ weights)
    return out


def attributions(points: DataFrame, model: GBTClassificationModel, id_: str = "id") -> DataFrame:
    """id, base, parts: the margin is base plus the sum of parts (an array over the dimensions of x). Rows without x have null parts."""
    found, dims = model_leaves(model), model.numFeatures
    base = base_value(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield pa.record_batch([part.column("id"), pa.array(shapley(x, found, dims).tolist(), pa.list_(pa.float64()))], ["id", "parts"])

    kind = points.schema[id_].dataType.simpleString()
    given = points.select(F.col(id_).alias("id"), F.col("x").cast("array<double>").alias("x"))
    valued = given.where("x is not null").mapInArrow(run, f"id {kind}, parts array<double>")
    none = given.where("x is null").select("id", F.lit(None).cast("array<double>").alias("parts"))
    return valued.unionByName(none).select(F.col("id").alias(id_), F.lit(base).alias("base"), "parts")


def mean_attributions(values: DataFrame, dims: int) -> DataFrame:
    """dim, importance: the mean |part| of each dimension over all rows."""
    means = values.agg(*[F.avg(F.abs(F.col("parts")[i])).alias(f"m{i}") for i in range(dims)])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("dim"), F.col(f"m{i}").alias("importance")) for i in range(dims)])
    return means.select(F.explode(rows).alias("r")).select("r.*")
