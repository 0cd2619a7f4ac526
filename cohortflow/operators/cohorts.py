"""Severity scores, rule labels, and splits of a cohort into sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing_zero(c: str) -> Column:
    """The value, with null, NaN and 0 all as null."""
    return F.when(~F.isnan(c) & (F.col(c) != 0), F.col(c))


# Points by thresholds, tried from the first; the last item is the points otherwise.
THRESHOLDS = {
    "sofa": ((">=", 10, 3), (">=", 5, 2), 1),
    "lactate": ((">", 4, 3), (">=", 2, 2), 1),
    "pao2_fio2": (("<", 100, 3), ("<", 200, 2), 1),
    "gcs": (("<=", 8, 3), ("<=", 13, 2), 1),
}


def points(kind: str, c: str) -> Column:
    """Points of one measurement; null where it is missing."""
    *steps, rest = THRESHOLDS[kind]
    value, out = missing_zero(c), None
    for op, limit, n in steps:
        test = {">=": value >= limit, ">": value > limit, "<": value < limit, "<=": value <= limit}[op]
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.when(value.isNotNull(), rest)


def mean_of_present(*columns: Column) -> Column:
    """Row-wise mean over the columns that are not null."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0].cast("double"), F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return F.try_divide(total, n)


def severity_band(score: Column) -> Column:
    return F.when(score.isNull(), "Unknown").when(score < 1.5, "1").when(score < 2.5, "2").otherwise("3")


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


# The tests of the rule label.
RULES = {"sirs": ((">=", 2),), "qsofa": ((">=", 2),), "lactate": ((">=", 2),), "wbc": ((">", 12000), ("<", 4000)), "temp": ((">", 38), ("<", 36)), "hr": ((">", 90),), "rr": ((">", 20),), "sbp": (("<", 90),), "map": (("<", 65),)}


def rule_label(df: DataFrame) -> Column:
    """1 if any rule on a column that df has holds, else 0; rules on other columns are left out."""
    tests = [f"coalesce({c} {op} {limit}, false)" for c, rules in RULES.items() if c in df.columns for op, limit in rules]
    if "sepsis" in df.columns:
        tests.append(r"coalesce(cast(sepsis as string) rlike '(?i)yes|positive|true|1', false)")
    return F.when(F.expr(" or ".join(tests) or "false"), 1).otherwise(0)


def apportion(total: int, weights: list[float]) -> list[int]:
    """Whole counts by largest remainder; of equal remainders the later goes first. Zero weights share equally."""
    whole = sum(weights)
    exact = [total * (w / whole) if whole > 0 else total / len(weights) for w in weights]
    counts = [math.floor(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (exact[i] - counts[i], i), reverse=True)
    for i in order[: total - sum(counts)]:
        counts[i] += 1
    return counts


def allocate_within(total: int, weights: list[float], room: list[int]) -> list[int]:
    """apportion, but no more than ``room`` each; what is left goes round by weight, then by room still free."""
    counts = [min(c, r) for c, r in zip(apportion(total, weights), room)]
    while (left := total - sum(counts)) > 0:
        free = sorted((i for i in range(len(room)) if counts[i] < room[i]), key=lambda i: (weights[i], room[i] - counts[i]), reverse=True)
        if not free:
            break
        for i in free[:left]:
            counts[i] += 1
    return counts


def assign_sites(cohort: DataFrame, sizes: dict[str, list[int]], seed: int = 42) -> DataFrame:
    """cohort (id, severity) with ``site`` from 1: in each severity a seeded order is cut into runs of the given sizes.

    Ranks come from digest buckets, so a severity never meets in one task; ids beyond the sizes and other severities are left out.
    """
    key = F.xxhash64("id", F.lit(seed))
    keyed = cohort.withColumns({"_key": key, "_bucket": F.pmod(F.shiftrightunsigned(key, 52), F.lit(4096))})
    counts = keyed.groupBy("severity", "_bucket").count()
    before = counts.select("severity", "_bucket", F.coalesce(F.sum("count").over(Window.partitionBy("severity").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("severity", "_bucket").orderBy("_key", "id")
    ranked = keyed.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(before), ["severity", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    site = None
    for severity, each in sizes.items():
        edge = 0
        for i, n in enumerate(each, 1):
            edge += n
            test = (F.col("severity") == severity) & (F.col("_rank") <= edge)
            site = F.when(test, i) if site is None else site.when(test, i)
    return ranked.withColumn("site", site).where("site is not null").select(*cohort.columns, "site")


def set_operations(lists: DataFrame, owner: str, item: str, owners: int) -> DataFrame:
    """kind, owner, item of lists (owner, item) given as rows: "common" to all ``owners``, in "any", or held by one owner "alone"; one grouped sum for all three."""
    held = lists.distinct().groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.min(owner).alias("_one"))
    none = F.lit(None).cast(lists.schema[owner].dataType)
    kinds = F.array(
        F.when(F.col("_n") == owners, F.struct(F.lit("common").alias("kind"), none.alias(owner))), F.struct(F.lit("any").alias("kind"), none.alias(owner)),
        F.when(F.col("_n") == 1, F.struct(F.lit("alone").alias("kind"), F.col("_one").alias(owner))),
    )
    return held.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"), item).select("k.kind", f"k.{owner}", item)
