"""Correlations of wide tables from Gram matrices: each task adds one block of sums for all pairs of columns, and blocks are added up in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4_096
BRANCHES = 16  # blocks are added in so many groups, and those in one


def _adding(centre: np.ndarray):
    """A task's block: for every pair of columns, over the rows that have both, count, sum, sum of squares and sum of products, of values less ``centre``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        total = np.zeros((4, d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]) - centre
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(float)
                total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        if total[0].any():
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["block"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(rows["block"].iloc[0]).copy()
    for other in rows["block"].iloc[1:]:
        total += np.frombuffer(other)
    return pd.DataFrame({"block": [total.tobytes()]})


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns in the order given, over the rows that have both (null or NaN is missing); null where one does not vary or no two rows are left.

    Values are taken from near their means, asked first, so that large offsets cost no digits. A block has 32 bytes a pair of columns, whatever the rows.
    """
    d = len(columns)
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    real = [F.avg(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)).alias(f"m{i}") for i, v in enumerate(values)]
    centre = np.array([m or 0.0 for m in df.agg(*real).first()], float) if d else np.zeros(0)
    blocks = df.select(*values).mapInArrow(_adding(centre), "block binary").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    added = blocks.groupBy("branch").applyInPandas(_summed, "block binary")  # a block each, at most BRANCHES of them
    whole = added.groupBy(F.lit(0).alias("all")).applyInPandas(_summed, "block binary")

    def ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["block"]:
                n, s, q, p = np.frombuffer(block).reshape(4, d, d)
                with np.errstate(invalid="ignore", divide="ignore"):
                    spread = q - s * s / n
                    r = (p - s * s.T / n) / np.sqrt(spread * spread.T)
                r[(n < 2) | (spread <= 1e-12 * q) | (spread.T <= 1e-12 * q.T)] = np.nan
                i, j = np.triu_indices(d, 1)
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], j[at : at + 50_000]
                    yield pd.DataFrame({"a": [columns[x] for x in a], "b": [columns[x] for x in b], "r": r[a, b]})

    return whole.mapInPandas(ratios, "a string, b string, r double").withColumn("r", F.when(~F.isnan("r"), F.col("r")))
