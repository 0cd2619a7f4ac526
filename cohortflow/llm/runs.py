"""Whole groups of sorted rows inside Arrow batches, so that many small groups share one vectorised step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .words import expand

ROWS = 20_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups and the groups' bounds, of rows sorted by whole-number keys; memory follows rows and the largest group."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(waiting).combine_chunks()
            bounds = group_bounds(table, keys)
            if len(bounds) > 2:
                yield table.slice(0, int(bounds[-2])), bounds[:-1]
                table = table.slice(int(bounds[-2])).combine_chunks()
            waiting, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield table, group_bounds(table, keys)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        values = table.column(key).to_numpy()
        fresh |= values[1:] != values[:-1]
    return np.concatenate(([0], np.flatnonzero(fresh) + 1, [table.num_rows])).astype(np.int64)


def pairs_of(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in one group, the lower first, in blocks of about ``most`` pairs."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    others = ends - np.arange(len(ends)) - 1
    before = np.concatenate(([0], np.cumsum(others)))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), others[at:stop])
        yield left, expand(np.arange(at + 1, stop + 1), others[at:stop])
        at = stop


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[offsets[i] : offsets[i + 1]] for i in range(len(column))]


def matrix_of(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Binary values of one width as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


GROUP = ["bucket", "low", "high"]


def apart(labelled: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """Where members of different components still share a bucket: doc, bucket, component, chunk, low, high, to be compared in groups of GROUP.

    labelled: bucket, doc, component. Buckets of the same members are one. A bucket of more than ``size`` members is dealt into chunks of about that
    many, which meet pairwise, save that those of its largest component do not meet each other; so it costs its size times the number of chunks of others.
    """
    mark = F.xxhash64("doc")
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("m1"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("m2"))
    whole = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.bit_xor("m1").alias("m1"), F.sum("m2").alias("m2")).where("kinds > 1")
    alike = whole.groupBy("n", "m1", "m2").agg(F.min(F.struct("bucket", "top")).alias("at"))
    chunks = {"ours": F.ceil(F.col("top.n") / size), "theirs": F.when(F.col("n") > size, F.ceil((F.col("n") - F.col("top.n")) / size)).otherwise(F.lit(0))}
    dealt = scratch.keep(alike.select("n", "at.bucket", "at.top").withColumns(chunks).select("bucket", F.col("top.component").alias("largest"), "ours", "theirs"), "open")
    turn, mine = F.xxhash64("doc", F.lit(5)), F.col("component") == F.col("largest")
    chunk = F.when(F.col("theirs") == 0, F.lit(0)).when(mine, F.pmod(turn, F.col("ours"))).otherwise(F.col("ours") + F.pmod(turn, F.col("theirs"))).cast("long")
    first = F.when((F.col("theirs") > 0) & mine, F.col("ours")).otherwise(F.lit(0)).cast("long")
    last = F.when(F.col("theirs") == 0, F.lit(0)).otherwise(F.col("ours") + F.col("theirs") - 1).cast("long")
    rest = labelled.join(dealt, "bucket").withColumn("chunk", chunk).withColumn("with", F.explode(F.sequence(first, last)))
    return rest.select("doc", "bucket", "component", "chunk", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"))


def in_groups(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)
