"""Windows over series of any length: rows are numbered by ranges, cut into blocks of positions, and each block gets the neighbours that its frames reach.

A series is never one task: numbering shuffles by ranges of (series, order), and a block holds BLOCK rows, or twice the reach of its frame where that is more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8_192


def numbered(df: DataFrame, by: str, order: str, ties: list[str] | None = None) -> DataFrame:
    """df's rows, stored, with _at (long, unique), _series (the same long for all rows of a series), _i (place in it, from 1) and _n (rows of the series).

    Places follow order, then ``ties``, then nothing that is fixed; nulls of order come first, null is a series too. Rows are dealt by ranges of these columns, so that a
    long series lies in many partitions; the rest are counts by partition and by series.
    """
    keys = [by, order, *(ties or [])]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()
    parts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("_part", (F.coalesce(F.sum("_rows").over(over), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = stored.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_at") + F.col("_shift")).drop("_part", "_shift")
    whole = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_series"), F.count(F.lit(1)).alias("_n"))
    found = placed.join(whole, placed[by].eqNullSafe(whole["_by"])).drop("_by")
    return found.withColumn("_i", F.col("_at") - F.col("_series") + 1)


def spread(rows: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Numbered rows with _block and _own: each in its own block (_own), and again in those blocks that it lies ``before`` rows before or ``after`` rows behind at most.

    A frame of that reach over (_series, _block) ordered by _i is whole for every own row. A row is in three blocks at most.
    """
    size = max(block, before, after)
    at = F.col("_i") - 1
    low = F.floor(F.greatest(at - after, F.lit(0)) / size)
    high = F.floor(F.least(at + before, F.col("_n") - 1) / size)
    return rows.withColumn("_block", F.explode(F.sequence(low, high))).withColumn("_own", F.col("_block") == F.floor(at / size))


def moving_mean(rows: DataFrame, value: str, span: int, name: str = "moving", block: int = BLOCK) -> DataFrame:
    """Numbered rows with the mean of the last ``span`` values of the series up to a row, nulls left out (null where all are)."""
    frame = Window.partitionBy("_series", "_block").orderBy("_i").rowsBetween(1 - span, 0)
    return spread(rows, span - 1, 0, block).withColumn(name, F.avg(value).over(frame)).where("_own").drop("_own", "_block")


def running_sum(rows: DataFrame, value: str, name: str = "total", block: int = BLOCK) -> DataFrame:
    """Numbered rows with the sum of the series' values up to a row, nulls left out (null before the first): sums within a block and of the blocks before it."""
    placed = rows.withColumn("_block", F.floor((F.col("_i") - 1) / block))
    sums = placed.groupBy("_series", "_block").agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy("_series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = sums.select("_series", "_block", F.sum("_sum").over(above).alias("_above"))
    inside = F.sum(value).over(Window.partitionBy("_series", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn(name, inside).join(offsets, ["_series", "_block"])
    return found.withColumn(name, F.coalesce(F.col(name) + F.col("_above"), F.col(name), F.col("_above"))).drop("_block", "_above")


def settled(rows: DataFrame, value: str, span: int, every: int, limit: float, keep: list[str], block: int = BLOCK) -> DataFrame:
    """For each series of numbered rows the columns ``keep`` of its first row, with stopped, moving, change: where it may stop.

    The moving mean of the last ``span`` values is looked at every ``every`` rows. change is relative to the look before; there is none at the first look and after a mean of 0.
    stopped is the place of the first look that changes by under ``limit``, moving and change are those of that look; all are null for a series that does not settle or has no look.
    """
    means = moving_mean(rows, value, span, "_mean", block)
    looks = means.where(F.col("_i") % every == 0).select("_series", (F.col("_i") / every).cast("long").alias("_look"), "_i", "_mean").checkpoint()  # read twice
    old = looks.select("_series", (F.col("_look") + 1).alias("_look"), F.col("_mean").alias("_old"))  # by equal keys, as the looks of a series have no bound
    change = F.abs(F.try_divide(F.col("_mean") - F.col("_old"), F.col("_old")))
    stops = looks.join(old, ["_series", "_look"]).withColumn("_change", change).where(F.col("_change") < limit)
    first = stops.groupBy("_series").agg(F.min(F.struct("_i", "_mean", "_change")).alias("_stop"))
    found = rows.where("_i = 1").select("_series", *keep).join(first, "_series", "left")
    return found.select(*keep, F.col("_stop._i").alias("stopped"), F.col("_stop._mean").alias("moving"), F.col("_stop._change").alias("change"))
