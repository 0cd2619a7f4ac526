"""Nearest centres, Lloyd steps, cluster quality, and aggregation of centres over sites.

Points are (id, x array<double>); centres (k, c array<double>) are few and are broadcast as a literal size-checked table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_CENTRES = 20_000  # in one array
MOST_BYTES = 64 << 20  # of centres sent to every task
DISTANCES = 1 << 18  # distances that are held at once, few enough for a cache


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _nearest_of_any_number(points: DataFrame, centres: DataFrame) -> DataFrame:
    """nearest by column functions: centres go to each row as arrays of about MOST_CENTRES, one after the other, so no pair of a point and a centre becomes a row."""
    parts = max(1, -(-centres.count() // MOST_CENTRES))
    found = []
    rows = points
    for i in range(parts):
        own = centres if parts == 1 else centres.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i)
        held = F.broadcast(own.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_centres")))
        best = F.array_min(F.transform("_centres", lambda c: F.struct(squared_distance(F.col("x"), c["c"]).alias("d2"), c["k"].alias("k"))))
        rows = rows.crossJoin(held).withColumn(f"_best{i}", best).drop("_centres")
        found.append(f"_best{i}")
    best = F.array_min(F.array(*found))
    return rows.withColumn("_best", best).select(*points.columns, F.col("_best.k").alias("k"), F.col("_best.d2").alias("d2"))


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of c of each row of x, the first of equals, and its squared distance. Products find it; where they leave a second one open, differences decide."""
    middle = c.mean(0)
    y, z = x - middle, c - middle
    d2 = y @ (-2 * z.T) + (z**2).sum(1)
    k = d2.argmin(1)
    each, size = np.arange(len(x)), (y**2).sum(1)
    margin = 1e-12 * (size + (z**2).sum(1).max())
    open_ = np.flatnonzero(~((d2 <= (d2[each, k] + margin)[:, None]).sum(1) == 1))  # NaN is open, too
    for row in open_:
        k[row] = ((x[row] - c) ** 2).sum(1).argmin()
    return k, ((x - c[k]) ** 2).sum(1)


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with k and d2 of the nearest centre, the smaller k of equals. A null x, or one with a null or of another length than the centres, has the
    smallest k and no d2.

    Centres of MOST_BYTES go to every task, which compares a block of points with all of them at once; more go by column functions.
    """
    size = centres.agg(F.count(F.lit(1)), F.min(F.size("c")), F.max(F.size("c"))).first()
    if not size[0] or size[1] != size[2] or size[1] < 1 or size[0] * size[1] * 8 > MOST_BYTES:
        return _nearest_of_any_number(points, centres)
    dims = size[1]
    table = centres.select("k", F.col("c").cast("array<double>").alias("c")).orderBy("k").toArrow().combine_chunks()
    names, c = table.column("k").combine_chunks(), table.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    sent = points.sparkSession.sparkContext.broadcast((names, c))
    columns = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = sent.value
        step = max(1, DISTANCES // len(c))
        for batch in batches:
            column = batch.column("_x")
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False).copy()
            if column.flatten().null_count:
                fits[pc.list_parent_indices(column).filter(pc.is_null(column.flatten())).to_numpy()] = False
            x = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            k, d2 = np.zeros(len(fits), np.int64), np.zeros(len(fits))
            if len(x):
                found = [_closest(x[at : at + step], c) for at in range(0, len(x), step)]
                k[fits], d2[fits] = (np.concatenate(v) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), names.take(pa.array(k)), pa.array(d2, mask=~fits)], [*columns, "k", "d2"])

    schema = StructType([*points.schema.fields, StructField("k", centres.schema["k"].dataType), StructField("d2", DoubleType())])
    return points.withColumn("_x", F.col("x").cast("array<double>")).mapInArrow(run, schema)


def mean_vectors(df: DataFrame, by: list[str], vector: str = "x", weight: str | None = None) -> DataFrame:
    """by, i, m: the (weighted) mean of each dimension of each group."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, w.alias("w"), F.posexplode(vector).alias("i", "v"))
    return rows.groupBy(*by, "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))


def gathered(means: DataFrame, by: list[str]) -> DataFrame:
    """by, c: dimensions put together again."""
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))


def mean_centres(df: DataFrame, by: list[str], vector: str = "x", weight: str | None = None) -> DataFrame:
    """by, c: the (weighted) mean vector of each group, from one sum a dimension; all vectors have the length of the longest, which is asked first."""
    dims = df.agg(F.max(F.size(vector))).first()[0] or 0
    w = F.col(weight) if weight else F.lit(1.0)
    means = [F.sum(w * F.get(vector, F.lit(i))) / F.sum(w) for i in range(dims)]
    return df.groupBy(*by).agg(F.array(*means).cast("array<double>").alias("c"))


def lloyd(points: DataFrame, centres: DataFrame) -> DataFrame:
    """k, c after one step; an empty cluster keeps its centre."""
    moved = mean_centres(nearest(points, centres), ["k"]).withColumnRenamed("c", "m")
    return centres.join(moved, "k", "left").select("k", F.coalesce("m", "c").alias("c"))


def federated_lloyd(points: DataFrame, centres: DataFrame, site: str = "site") -> DataFrame:
    """k, c after one step at every site and the plain mean over sites; a site without points of k gives the old centre."""
    own = mean_centres(nearest(points, centres), [site, "k"]).withColumnRenamed("c", "m")
    grid = points.select(site).distinct().crossJoin(F.broadcast(centres)).join(own, [site, "k"], "left").select("k", F.coalesce("m", "c").alias("x"))
    return mean_centres(grid, ["k"])


def inertia(points: DataFrame, centres: DataFrame, by: list[str] | None = None) -> DataFrame:
    return nearest(points, centres).groupBy(*(by or [])).agg(F.sum("d2").alias("inertia"))


def calinski_harabasz(points: DataFrame, label: str = "label") -> DataFrame:
    """One row, score: between over within variance, each by its degrees of freedom."""
    values = points.select(label, F.posexplode("x").alias("i", "v"))
    own = values.groupBy(label, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = own.groupBy("i").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    both = own.join(F.broadcast(whole), "i")
    sums = both.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("s_all") / F.col("n_all")) ** 2).alias("b"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.countDistinct(label).alias("k"), F.max("n_all").alias("n"))
    return sums.select(F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("score"))


def davies_bouldin(points: DataFrame, label: str = "label") -> DataFrame:
    """One row, score: the mean over clusters of the worst (s_i + s_j) / d_ij."""
    centres = gathered(mean_vectors(points, [label]), [label])
    spread = points.join(F.broadcast(centres), label).groupBy(label).agg(F.avg(F.sqrt(squared_distance(F.col("x"), F.col("c")))).alias("s"))
    both = centres.join(spread, label)
    other = both.select(F.col(label).alias("o"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    worst = both.join(F.broadcast(other), F.col(label) != F.col("o")).groupBy(label).agg(F.max((F.col("s") + F.col("s2")) / F.sqrt(squared_distance(F.col("c"), F.col("c2")))).alias("w"))
    return worst.agg(F.avg("w").alias("score"))


def institution_weights(uploads: DataFrame, alpha: float = 0.5) -> DataFrame:
    """site, weight from (site, n, sse, variance, severity): share of rows, over share of error and variance, lifted by severity."""
    eps = 1e-10
    total = uploads.agg(F.sum("n").alias("n_all"), F.sum("sse").alias("sse_all"))
    raw = (F.col("n") / F.col("n_all")) / (F.col("sse") / F.col("sse_all") + eps) / (F.col("variance") + eps) * (1 + alpha * F.col("severity"))
    rows = uploads.crossJoin(F.broadcast(total)).withColumn("raw", raw)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("raw").alias("raw_all")))).select("site", (F.col("raw") / F.col("raw_all")).alias("weight"))


def site_similarity(centres: DataFrame) -> DataFrame:
    """a, b, similarity for each pair of sites from (site, k, c): 1 / (1 + mean distance of their centres)."""
    left = centres.select(F.col("site").alias("a"), F.col("c").alias("x"))
    right = centres.select(F.col("site").alias("b"), F.col("c").alias("y"))
    pairs = left.join(F.broadcast(right), F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg((1 / (1 + F.avg(F.sqrt(squared_distance(F.col("x"), F.col("y")))))).alias("similarity"))
