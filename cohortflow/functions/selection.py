"""Exact quantiles of many columns and groups by radix selection: no value is sorted or shuffled.

A double maps to 64 bits whose unsigned order is that of the values. A pass over the rows counts the next bits of every value that still shares a sought value's
leading bits, for all groups and columns at once, in arrays of fixed size; the counts, added up over tasks, say in which slice each sought rank lies,
so 12, 25, 38, 51 and all 64 bits of it are known after five passes at most. Once the slices left open hold few values, those are read instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_BITS, BITS = 12, 13
MOST_OPEN = 2_048  # open slices that a task keeps counts of (64 KB each)
FEW = 100_000  # values that are read rather than counted


def keys_of(values: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the values; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, groups, keys) of the values that are neither null nor NaN."""
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for j in range(1, batch.num_columns):
            values = batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls as NaN
            real = ~np.isnan(values)
            yield j - 1, groups[real], keys_of(values[real])


def _first_counts(groups: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << FIRST_BITS
        counts = np.zeros((columns, groups * size), np.int64)
        for j, g, keys in _columns(batches):
            counts[j] += np.bincount(g * size + (keys >> np.uint64(64 - FIRST_BITS)).astype(np.int64), minlength=groups * size)
        column, at = counts.nonzero()
        yield _rows((at // size) * columns + column, at % size, counts[column, at])

    return run


def _rows(cell: np.ndarray, part: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(cell, pa.int64()), pa.array(part, pa.int64()), pa.array(n, pa.int64())], ["cell", "part", "n"])


def _matched(batches: Iterator[pa.RecordBatch], codes: list[tuple[np.ndarray, np.ndarray]], known: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(open slice, key) of the values whose first ``known`` bits are those of an open slice; codes: by column, sorted group and bits with the slice's number."""
    for j, g, keys in _columns(batches):
        own, number = codes[j]
        if len(own):
            code = (g.astype(np.uint64) << np.uint64(known)) | (keys >> np.uint64(64 - known))
            at = np.minimum(np.searchsorted(own, code), len(own) - 1)
            hit = own[at] == code
            yield number[at[hit]], keys[hit]


def _next_counts(codes: list, known: int, opened: int):
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(opened * size, np.int64)
        for number, keys in _matched(batches, codes, known):
            counts += np.bincount(number * size + ((keys >> np.uint64(64 - known - BITS)) & np.uint64(size - 1)).astype(np.int64), minlength=len(counts))
        at = counts.nonzero()[0]
        yield _rows(at // size, at % size, counts[at])

    return run


def _values(codes: list, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys in _matched(batches, codes, known):
            yield _rows(number, keys.view(np.int64), np.ones(len(keys), np.int64))

    return run


def _places(found: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(cell, rank) to (part, values of smaller parts, values of that part), from added counts (cell, part, n)."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sought = F.broadcast(found.sparkSession.createDataFrame(wanted, "cell long, rank long"))  # two a quantile, column and group
    at = found.withColumn("before", before).join(sought, "cell").where("before < rank and rank <= before + n")
    return {(r["cell"], r["rank"]): (r["part"], r["before"], r["n"]) for r in at.collect()}


def cells(groups: int, columns: int, qs: int) -> int:
    """Slices that may be open at once."""
    return 2 * groups * columns * qs


def select(df: DataFrame, groups: int, columns: int, ranks_of) -> tuple[dict[tuple[int, int], float], dict[int, int]]:
    """(cell, rank) to the value of that rank (from 1), for df (group, and ``columns`` columns of doubles), and the values of each cell that has any; cell = group * columns + column.

    ranks_of(n) gives the ranks that are sought among a cell's n values. Groups are numbered from 0, groups * columns * ranks at most MOST_OPEN.
    """
    counts = df.mapInArrow(_first_counts(groups, columns), "cell long, part long, n long").groupBy("cell", "part").agg(F.sum("n").alias("n")).persist()
    totals = {r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    wanted = [(cell, rank) for cell, n in totals.items() for rank in sorted(set(ranks_of(n)))]
    if not wanted:
        counts.unpersist()
        return {}, {}
    found = _places(counts, wanted)
    counts.unpersist()
    state = {key: (part, key[1] - before, n) for key, (part, before, n) in found.items()}  # leading bits, rank among those that share them, how many do
    known = FIRST_BITS
    while known < 64:
        slices = sorted({(cell, bits) for (cell, _), (bits, _, _) in state.items()})
        number = {s: i for i, s in enumerate(slices)}
        codes = []
        for j in range(columns):
            own = sorted(((cell // columns) << known | bits, i) for (cell, bits), i in number.items() if cell % columns == j)
            codes.append((np.array([c for c, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))
        few = sum({(cell, bits): n for (cell, _), (bits, _, n) in state.items()}.values()) <= FEW
        asked = {key: (number[key[0], bits], rank) for key, (bits, rank, _) in state.items()}
        if few:
            rows = df.mapInArrow(_values(codes, known), "cell long, part long, n long").select("cell", "part").toPandas()
            held = {int(i): np.sort(keys_.to_numpy().view(np.uint64)) for i, keys_ in rows.groupby("cell")["part"]}
            return {key: value_of(int(held[i][rank - 1])) for key, (i, rank) in asked.items()}, totals
        step = df.mapInArrow(_next_counts(codes, known, len(slices)), "cell long, part long, n long").groupBy("cell", "part").agg(F.sum("n").alias("n"))
        found = _places(step, sorted(set(asked.values())))
        state = {key: ((state[key][0] << BITS) | part, asked[key][1] - before, n) for key in state for part, before, n in [found[asked[key]]]}
        known += BITS
    return {key: value_of(bits) for key, (bits, _, _) in state.items()}, totals


def quantiles(df: DataFrame, columns: list[str], qs: dict[str, float], by: list[str], position) -> DataFrame | None:
    """by, and ``name_column`` for each column and name of qs: the exact quantile of values that are neither null nor NaN, between the neighbours of its position.

    None where groups are too many to count side by side. A group without values has nulls. The rows are read in a few passes, held between them.
    """
    spark, most = df.sparkSession, MOST_OPEN // max(1, 2 * len(columns) * len(qs))
    kinds = [df.schema[c] for c in by]
    if most < 1:
        return None
    if by:
        groups = [tuple(r) for r in df.select(*by).distinct().limit(most + 1).collect()]
        if len(groups) > most:
            return None
        held = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "_group long, " + ", ".join(f"_by{i} {k.dataType.simpleString()}" for i, k in enumerate(kinds)))
        matches = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
        rows = df.join(F.broadcast(held), matches)
    else:
        groups, rows = [()], df.withColumn("_group", F.lit(0).cast("long"))
    rows = rows.select("_group", *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(columns)]).persist(StorageLevel.MEMORY_AND_DISK)

    def sides(n: int, q: float) -> tuple[int, int, float]:
        at = position(n, q)
        k = max(1, min(math.floor(at), n - 1))
        return k, min(k + 1, n), max(0.0, min(at - k, 1.0))

    def ranks_of(n: int) -> list[int]:
        return [k for q in qs.values() for k in sides(n, q)[:2]]

    found, totals = select(rows, len(groups), len(columns), ranks_of) if groups else ({}, {})
    rows.unpersist()

    def one(cell: int, q: float) -> float | None:
        n = totals.get(cell, 0)
        if not n:
            return None
        k, after, part = sides(n, q)
        low, high = found[cell, k], found[cell, after]
        return low + part * (high - low) if part else low

    names = [(name, c) for c in columns for name in qs]
    out = [(*g, *[one(i * len(columns) + columns.index(c), qs[name]) for name, c in names]) for i, g in enumerate(groups)]
    return spark.createDataFrame(out, ", ".join([*[f"`{c}` {k.dataType.simpleString()}" for c, k in zip(by, kinds)], *[f"`{name}_{c}` double" for name, c in names]]))
