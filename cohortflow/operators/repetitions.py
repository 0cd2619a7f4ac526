"""Sums over many samples of stays from one pass: a stay carries its repetitions as a mask, and no row is copied for them.

A repetition keeps a stay if digest_uniform(stay, repetition, ...) is below the share, so the draw follows from the keys alone, in any task and any engine. Tasks
draw a stay's mask once a batch and add its rows to all its repetitions at once, by matrix products; a task passes on one row a key and repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import digest_uniform

HELD = 64 << 20  # bytes of sums that a task gathers before it hands them on
STAYS = 512  # whose masks are held at once


def masks(stays: list, times: int, share: float, tag: str = "", seed: int = 0) -> np.ndarray:
    """stays x times: whether a repetition keeps a stay. The same numbers as digest_uniform(stay, repetition[, tag], seed=seed)."""
    out = np.empty((len(stays), times), bool)
    ends = [f"{i}|{tag}|{seed}".encode() if tag else f"{i}|{seed}".encode() for i in range(times)]
    limit = share * (1 << 32)
    for row, stay in zip(out, stays, strict=True):
        start = hashlib.md5(f"{stay}|".encode() if stay is not None else b"")
        for i, end in enumerate(ends):
            one = start.copy()
            one.update(end)
            row[i] = int.from_bytes(one.digest()[:4], "big") < limit
    return out


def drawn(key: str, times: int, share: float, tag: str = "", seed: int = 0) -> Column:
    """The repetitions that keep a stay, as an array."""
    keys = lambda i: [key, i, *([F.lit(tag)] if tag else [])]
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")), lambda i: digest_uniform(*keys(i), seed=seed) < share)


def summed(df: DataFrame, keys: list[str], values: list[str], times: int, share: float, tag: str = "", seed: int = 0, stay: str = "icustayid") -> DataFrame:
    """rep, keys, n and sum_v for each of values: rows and sums (of what is not null) over the stays of each repetition; groups that none of its stays reach are left out.

    keys are longs. Work is rows times repetitions inside a task; what is shuffled are sums.
    """
    names = [f"k{i}" for i in range(len(keys))]
    sums = [f"v{i}" for i in range(len(values))]
    schema = ", ".join(["rep long", *[f"{k} long" for k in names], "n long", *[f"{v} double" for v in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # n and sums by repetition

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for at in range(0, len(rows), max(1, 50_000 // times)):
                part = rows[at : at + max(1, 50_000 // times)]
                block = np.stack([x for _, x in part])  # key, 1 + values, repetition
                who, rep = np.nonzero(block[:, 0])
                columns = [pa.array(rep, pa.int64()), *[pa.array([part[i][0][j] for i in who], pa.int64()) for j in range(len(keys))], pa.array(block[who, 0, rep].astype(np.int64))]
                yield pa.record_batch([*columns, *[pa.array(block[who, 1 + j, rep]) for j in range(len(values))]], ["rep", *names, "n", *sums])
            held.clear()

        for batch in batches:
            stays = batch.column(0).to_pylist()
            places: dict = {}
            of = np.array([places.setdefault(s, len(places)) for s in stays])
            listed = list(places)
            groups = [tuple(row) for row in zip(*[batch.column(1 + j).to_pylist() for j in range(len(keys))], strict=True)] if keys else [()] * len(stays)
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault(g, len(numbers)) for g in groups])
            v = np.column_stack([np.ones(len(stays)), *[np.nan_to_num(batch.column(1 + len(keys) + j).to_numpy(zero_copy_only=False).astype(float)) for j in range(len(values))]])
            total = np.zeros((len(numbers), 1 + len(values), times))
            for at in range(0, len(listed), STAYS):
                mask = masks(listed[at : at + STAYS], times, share, tag, seed).astype(float)
                own = np.flatnonzero((of >= at) & (of < at + STAYS))
                for g in np.unique(group[own]):
                    mine = own[group[own] == g]
                    weight = np.zeros((len(mask), 1 + len(values)))
                    np.add.at(weight, of[mine] - at, v[mine])
                    used = np.flatnonzero(weight[:, 0])
                    total[g] += weight[used].T @ mask[used]
            for key, i in numbers.items():
                held[key] = held[key] + total[i] if key in held else total[i]
            if len(held) * (1 + len(values)) * times * 8 > HELD:
                yield from out()
        yield from out()

    parts = df.select(stay, *[F.col(k).cast("long").alias(n) for k, n in zip(keys, names)], *[F.col(v).cast("double").alias(n) for v, n in zip(values, sums)]).mapInArrow(run, schema)
    added = parts.groupBy("rep", *names).agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in sums])
    return added.select("rep", *[F.col(n).alias(k) for k, n in zip(keys, names)], "n", *[F.col(n).alias(f"sum_{v}") for v, n in zip(values, sums)])
