"""k-means of many keys in one loop: restarts, numbers of clusters, sites and models step together.

A key is one run: the pool of points that it clusters (such as a site) and its centres. In a step the centres of all keys still moving go to the tasks, each task
adds up k rows of sums for each key with matrix products, one grouped sum puts the tasks' rows together, and keys leave as they settle. So a
step is one Spark job for all keys, and what is shuffled are sums of fixed size, not points.

Fits of many steps over points of HELD_BYTES at most, equal points counted once, are one job instead: every task gets the points and fits whole keys, where bounds on the
distances (Hamerly's, and balls around a point's centre where centres are many) spare most of them. The steps are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20  # of centres sent to every task at once; more keys step in turns
HELD_BYTES = 128 << 20  # of points, and of what a fit keeps beside each, that a task holds
MANY_STEPS = 10  # fits of fewer are not worth sending the points
FEW_CENTRES = 64  # up to so many, a point is compared with all
DISTANCES = 1 << 18  # distances that are held at once, few enough for a cache


@dataclass
class Run:
    """One key: its pool, its centres (k x d), and after a fit its clusters' sizes and inertia and the change of each step."""

    pool: object
    centres: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    inertia: np.ndarray = field(default_factory=lambda: np.zeros(0))
    changes: list[float] = field(default_factory=list)

    @property
    def cost(self) -> float:
        return float(self.inertia.sum())


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def closest(x: np.ndarray, doubled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals; doubled: the centres times -2 as columns, lengths: their squared norms."""
    d2 = x @ doubled
    d2 += lengths
    return d2.argmin(1)


def _adding(runs: dict[int, Run], dims: int):
    """Sums of a task's points by key and nearest centre."""
    held = {key: (run.pool, run.centres) for key, run in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros((dims + 2, len(c))) for key, (_, c) in held.items()}
        ready = {key: (-2 * np.ascontiguousarray(c.T), (c**2).sum(1)) for key, (_, c) in held.items()}
        for batch in batches:
            pools = np.array(batch.column("pool").to_pylist(), object)
            points = matrix(batch.column("x"), dims)
            rows_of = {p: np.flatnonzero(pools == p) for p in set(pools.tolist())}
            for key, (pool, centres) in held.items():
                own = rows_of.get(pool, ())
                rows = max(1, DISTANCES // len(centres))
                for at in range(0, len(own), rows):
                    x = points[own[at : at + rows]]
                    k, n = closest(x, *ready[key]), len(centres)
                    d2 = ((x - centres[k]) ** 2).sum(1)
                    for i, weights in enumerate((None, d2, *x.T)):
                        sums[key][i] += np.bincount(k, weights, n)
        for key, total in sums.items():
            used = np.flatnonzero(total[0])
            if len(used):
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (dims + 2), pa.int32()), pa.array(np.ascontiguousarray(total[:, used].T).ravel()))
                yield pa.record_batch([pa.array(np.full(len(used), key)), pa.array(used), rows], ["key", "k", "s"])

    return run


def _step(points: DataFrame, runs: dict[int, Run], dims: int) -> dict[int, np.ndarray]:
    """key to rows (n, inertia, sums) of its centres after one pass over the points."""
    added = points.mapInArrow(_adding(runs, dims), "key long, k long, s array<double>").groupBy("key", "k").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(dims + 2)]).alias("s")).toPandas()
    out = {key: np.zeros((len(run.centres), dims + 2)) for key, run in runs.items()}
    if len(added):
        keys, places, rows = added["key"].to_numpy(), added["k"].to_numpy(), np.array(added["s"].tolist())
        for key in np.unique(keys):
            own = keys == key
            out[key][places[own]] = rows[own]
    return out


def _turns(runs: dict[int, Run]) -> list[dict[int, Run]]:
    """The runs in groups of at most MOST_BYTES of centres."""
    turns, size = [{}], 0
    for key, run in runs.items():
        if size and size + run.centres.nbytes > MOST_BYTES:
            turns.append({})
            size = 0
        turns[-1][key] = run
        size += run.centres.nbytes
    return turns


def fit(points: DataFrame, starts: dict[int, tuple[object, np.ndarray]], rounds: int = 300, threshold: float = 1e-4, furthest: bool = False) -> dict[int, Run]:
    """Lloyd's steps from each key's start (pool, centres) until its change is at most ``threshold``, ``rounds`` at most.

    points: (pool, x), vectors of one length. A change is the mean absolute change of a coordinate, or the largest distance a centre moves if ``furthest``. A
    centre without points stays. Sizes and inertia are those of the last centres. One set of centres over MOST_BYTES: ValueError; clusters.lloyd has no such bound
    on keys but takes one at a time.
    """
    runs = {key: Run(pool, np.asarray(c, float)) for key, (pool, c) in starts.items()}
    if not runs:
        return {}
    dims = next(iter(runs.values())).centres.shape[1]
    if max(run.centres.nbytes for run in runs.values()) > MOST_BYTES:
        raise ValueError("too many centres to send to every task")
    points = points.select("pool", F.col("x").cast("array<double>").alias("x"))
    if rounds >= MANY_STEPS and sum(run.centres.nbytes for run in runs.values()) <= MOST_BYTES and (held := _held(points, dims)) is not None:
        return _fit_held(points, held, runs, rounds, threshold, furthest)
    moving = dict(runs)
    for done in range(rounds + 1):
        for turn in _turns(moving):
            for key, rows in _step(points, turn, dims).items():
                run, n = runs[key], rows[:, 0]
                run.sizes, run.inertia = n.astype(np.int64), rows[:, 1]
                settled = bool(run.changes) and run.changes[-1] <= threshold
                if settled or done == rounds:
                    del moving[key]
                    continue
                new = np.where(n[:, None] > 0, rows[:, 2:] / np.maximum(n, 1)[:, None], run.centres)
                gap = new - run.centres
                run.changes.append(float(np.sqrt((gap**2).sum(1)).max() if furthest else np.abs(gap).mean()))
                run.centres = new
        if not moving:
            break
    return runs


class _Bounded:
    """The nearest centre of each of the points x under centres that move: ``at``; by upper bounds on its distance and lower bounds on the second's."""

    def __init__(self, x: np.ndarray, centres: np.ndarray):
        self.x, self.slack = x, 1e-7 * (1.0 + float(np.abs(x).max(initial=0.0)))  # over what rounding does to a distance
        self.at, self.upper, self.lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
        self._compare(np.arange(len(x)), centres)

    def _compare(self, rows: np.ndarray, centres: np.ndarray) -> None:
        """Rows against all centres."""
        step, middle = max(1, DISTANCES // len(centres)), centres.mean(0)
        moved = centres - middle
        doubled, lengths = -2 * np.ascontiguousarray(moved.T), (moved**2).sum(1)
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            x = self.x[own] - middle
            self._settle(own, x @ doubled + lengths, (x**2).sum(1), None, np.inf)

    def _settle(self, own: np.ndarray, d2: np.ndarray, length: np.ndarray, names: np.ndarray | None, beyond) -> None:
        each = np.arange(len(own))
        k = d2.argmin(1)
        best = d2[each, k]
        d2[each, k] = np.inf
        second = d2.min(1) if d2.shape[1] > 1 else np.full(len(own), np.inf)
        self.at[own] = k if names is None else names[k]
        self.upper[own] = np.sqrt(np.maximum(best + length, 0.0))
        self.lower[own] = np.minimum(np.sqrt(np.maximum(second + length, 0.0)), beyond)

    def move(self, old: np.ndarray, new: np.ndarray) -> None:
        gaps = np.sqrt(((new - old) ** 2).sum(1))
        far = int(gaps.argmax())
        rest = float(np.delete(gaps, far).max(initial=0.0))
        self.upper += gaps[self.at]
        self.lower -= np.where(self.at == far, rest, gaps[far])
        z = new - new.mean(0)
        lengths = (z**2).sum(1)
        apart = np.sqrt(np.maximum(lengths[:, None] - 2 * z @ z.T + lengths[None, :], 0.0))
        np.fill_diagonal(apart, np.inf)
        half = apart.min(1) / 2 - self.slack * 10  # centres lie apart by more than their products' rounding, or are compared
        rows = np.flatnonzero(self.upper + self.slack >= np.maximum(self.lower, half[self.at]))
        if not len(rows):
            return
        self.upper[rows] = np.sqrt(((self.x[rows] - new[self.at[rows]]) ** 2).sum(1))
        rows = rows[self.upper[rows] + self.slack >= np.maximum(self.lower[rows], half[self.at[rows]])]
        if len(new) <= FEW_CENTRES:
            self._compare(rows, new)
            return
        np.fill_diagonal(apart, 0.0)
        rows = rows[np.argsort(self.at[rows], kind="stable")]
        now = self.at[rows]
        edges = np.flatnonzero(np.diff(now, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            centre, group = int(now[a]), rows[a:b]
            radius = 2.2 * float(self.upper[group].max()) + self.slack * 10
            names = np.flatnonzero(apart[centre] <= radius)
            z = new[names] - new[centre]
            doubled, lengths = -2 * np.ascontiguousarray(z.T), (z**2).sum(1)
            step = max(1, DISTANCES // len(names))
            for i in range(0, len(group), step):
                own = group[i : i + step]
                y = self.x[own] - new[centre]
                self._settle(own, y @ doubled + lengths, (y**2).sum(1), names, radius - self.slack * 10 - self.upper[own])


def _sums(x: np.ndarray, weight: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Rows (weight, sums) of the centres."""
    return np.stack([np.bincount(at, weight, k), *(np.bincount(at, weight * v, k) for v in x.T)], axis=1)


def _fitted(x: np.ndarray, weight: np.ndarray, centres: np.ndarray, rounds: int, threshold: float, furthest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Centres, sizes, inertia and changes of one key's fit, all in this task."""
    changes: list[float] = []
    near, k = _Bounded(x, centres), len(centres)
    before, sums = near.at.copy(), _sums(x, weight, near.at, k)
    for done in range(rounds):
        if changes and changes[-1] <= threshold:
            break
        moved = np.flatnonzero(before != near.at)
        if len(moved) * 4 > len(x) or not done % 32:  # anew now and then, so that rounding does not add up
            sums = _sums(x, weight, near.at, k)
        elif len(moved):
            sums = sums + _sums(x[moved], weight[moved], near.at[moved], k) - _sums(x[moved], weight[moved], before[moved], k)
        before[moved] = near.at[moved]
        n = np.rint(sums[:, :1])
        new = np.where(n > 0, sums[:, 1:] / np.maximum(n, 1), centres)
        gap = new - centres
        changes.append(float(np.sqrt((gap**2).sum(1)).max() if furthest else np.abs(gap).mean()))
        near.move(centres, new)
        centres = new
    return centres, np.bincount(near.at, weight, k), np.bincount(near.at, weight * ((x - centres[near.at]) ** 2).sum(1), k), changes


def _held(points: DataFrame, dims: int) -> dict | None:
    """pool to its different points and their numbers, if a task can hold them; else None."""
    most = HELD_BYTES // ((dims + 4) * 8)
    if points.limit(most + 1).count() > most:
        points = points.groupBy("pool", "x").agg(F.count(F.lit(1)).alias("n"))
        if points.count() > most:
            return None
    else:
        points = points.withColumn("n", F.lit(1).cast("long"))
    table = points.toArrow().combine_chunks()
    if not len(table):
        return {}
    pool, x, n = table.column("pool"), matrix(table.column("x").combine_chunks(), dims), table.column("n").to_numpy().astype(np.float64)
    codes = pool.combine_chunks().dictionary_encode()
    names, codes, found = codes.dictionary.to_pylist(), codes.indices.to_numpy(), {}
    for i, name in enumerate(names):
        rows = np.flatnonzero(codes == i) if len(names) > 1 else slice(None)
        own, weight = x[rows], n[rows]
        order = np.lexsort(own.T)  # equal points beside each other, and the same order for any partitioning
        own, weight = own[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
        found[name] = (np.ascontiguousarray(own[first]), np.add.reduceat(weight, first))
    return found


def _fit_held(points: DataFrame, held: dict, runs: dict[int, Run], rounds: int, threshold: float, furthest: bool) -> dict[int, Run]:
    """All keys fitted in one job, a key in a task."""
    spark, keys = points.sparkSession, list(runs)
    sent = spark.sparkContext.broadcast((held, [(runs[key].pool, runs[key].centres) for key in keys]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, starts = sent.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                pool, centres = starts[i]
                none = (np.zeros((0, centres.shape[1])), np.zeros(0))
                centres, sizes, inertia, changes = _fitted(*points.get(pool, none), centres, rounds, threshold, furthest)
                yield pa.record_batch([pa.array([i]), *(pa.array([np.asarray(v, float)]) for v in (centres.ravel(), sizes, inertia, changes))], ["i", "c", "n", "d", "changes"])

    found = spark.range(0, len(keys), 1, len(keys)).mapInArrow(run, "i long, c array<double>, n array<double>, d array<double>, changes array<double>").collect()
    sent.destroy()
    for r in found:
        out = runs[keys[r["i"]]]
        out.centres, out.sizes, out.inertia, out.changes = np.array(r["c"], float).reshape(out.centres.shape), np.array(r["n"]).astype(np.int64), np.array(r["d"], float), list(r["changes"])
    return runs


def seeded_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample by k-means++: each next one drawn in proportion to its squared distance from those chosen; with fewer different rows some repeat."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    d2 = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = d2.sum()
        chosen.append(int(np.searchsorted(np.cumsum(d2), rng.random() * total, side="right").clip(0, len(sample) - 1)) if total > 0 else int(rng.integers(len(sample))))
        d2 = np.minimum(d2, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def start_sample(points: DataFrame, rows: int, seed: int = 0) -> np.ndarray:
    """The vectors x of the ``rows`` least digests: what starts are drawn from, the same for any partitioning. Only starts come from it, steps use all points."""
    drawn = points.select("x").orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(rows)
    return np.array([r["x"] for r in drawn.collect()], float)


def best_of(runs: dict[int, Run], keys: list[int]) -> int:
    """The key of the least cost, to 9 digits; the smaller of equals."""
    return min(keys, key=lambda key: (float(f"{runs[key].cost:.9g}"), key))
