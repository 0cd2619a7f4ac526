"""Splits and samples that follow from keys alone, so that a task that runs again, and another engine, draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.functions.ranks import running
from cohortflow.functions.scalars import digest_uniform


def fold(key: str, model: int, folds: int = 5) -> Column:
    """The fold, from 1, of a key in a model; drawn anew for each model. Fold 1 is held out."""
    return (F.floor(digest_uniform(key, seed=model) * folds) + 1).cast("long")


def sampled(key: str, model: int, share: float = 0.25) -> Column:
    """Whether a row is in a model's Bernoulli sample."""
    return digest_uniform(key, F.lit("sample"), seed=model) < share


def stratified(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with train: the first ceil(share * n) rows of each label in the order of a digest of the key (unique). Ranks come from ranges of the digest."""
    drawn = df.withColumn("_draw", digest_uniform(key, seed=seed))
    places = running(drawn.groupBy(label, "_draw").agg(F.count(F.lit(1)).alias("_n")), "_draw", "_n", [label])
    return drawn.join(places.select(label, "_draw", "before", "total"), [label, "_draw"]).withColumn("train", F.col("before") < F.ceil(share * F.col("total"))).drop("_draw", "before", "total")


def first_of_each(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key in a given order; the cap is the feature."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
