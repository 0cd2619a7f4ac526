"""Ranks and exact quantiles, so that no group meets in one task and no value is gathered.

Quantiles of up to a few hundred groups and columns come from selection. Ranks, and quantiles of more groups, come from counts of equal values. Counts are dealt into ranges of the value of about RANGE rows, whose bounds come from approximate quantiles; running counts inside a range
and a small table of range totals give each value's place. Bounds only deal rows out; results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import selection

RANGE = 50_000
MOST_RANGES = 10_000


def running(counts: DataFrame, value: str, n: str, by: list[str] | None = None) -> DataFrame:
    """counts (by, value, n; one row for each value of a group) with before: the sum of n over smaller values of the group, and total: that over all of them."""
    by, counts = by or [], counts.checkpoint()  # read four times
    ranges = min(MOST_RANGES, math.ceil(counts.count() / RANGE))
    bounds = sorted(set(counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [])) if ranges > 1 else []
    low = F.array(*map(F.lit, bounds)) if bounds else None
    placed = counts.withColumn("_range", F.size(F.filter(low, lambda b: b <= F.col(value))) if bounds else F.lit(0))
    sums = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_n"))
    whole = Window.partitionBy(*by)
    offsets = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    own = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return inside.join(offsets, [*by, "_range"]).withColumn("before", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def hazen(total: Column, q: float) -> Column:
    """Position n * q + 1/2."""
    return total * q + 0.5


def linear(total: Column, q: float) -> Column:
    """Position 1 + (n - 1) * q, that of an exact percentile with linear interpolation."""
    return 1 + (total - 1) * q


def counted_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None, position=linear) -> DataFrame:
    """by, and a column for each of qs, from ranked counts of equal values: for any number of groups."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count"))
    ranked = running(counts, value, "_count", by)
    found = []
    for name, q in qs.items():
        at = position(F.col("total"), q)
        k = F.greatest(F.lit(1), F.least(F.floor(at), F.col("total") - 1))
        has = lambda j: (F.col("before") < j) & (j <= F.col("before") + F.col("_count"))
        found += [F.max(F.when(has(k), F.col(value))).alias(f"_low_{name}"), F.max(F.when(has(F.least(k + 1, F.col("total"))), F.col(value))).alias(f"_high_{name}"), F.max(F.greatest(F.lit(0.0), F.least(at - k, F.lit(1.0)))).alias(f"_part_{name}")]
    sides = ranked.groupBy(*by).agg(*found)
    return sides.select(*by, *[(F.col(f"_low_{name}") + F.col(f"_part_{name}") * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))).alias(name) for name in qs])


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None, position=linear) -> DataFrame:
    """by, and a column for each of qs: the exact quantile of the values that are not null, between the neighbours of its position (kept within 1 and n)."""
    found = selection.quantiles(df, [value], qs, by or [], position)
    if found is None:
        return counted_quantiles(df, value, qs, by, position)
    return found.select(*(by or []), *[F.col(f"{name}_{value}").alias(name) for name in qs])


def column_quantiles(df: DataFrame, columns: list[str], qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by, and for each column and name of qs a column ``name_column``: all columns' quantiles from the same passes over their values; NaN is missing."""
    by = by or []
    if (selected := selection.quantiles(df, columns, qs, by, linear)) is not None:
        return selected
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])).alias("_x")
    rows = df.select(*by, each).select(*by, "_x.*").where(~F.isnan("_value"))
    found = counted_quantiles(rows, "_value", qs, [*by, "_column"])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col(name))).alias(f"{name}_{c}") for c in columns for name in qs])
