"""Sweeps over a decision process of up to millions of states: transitions stay in the tasks as compressed rows, only values travel.

Transitions are dealt by state to blocks of bounded size and kept once, each block as arrays of compressed rows. A sweep sends the vector of values to the
tasks, each block multiplies its rows, and one value a state comes back. A policy is evaluated as the fixed point of its sweep, with Anderson's
acceleration and a test of the residual, so neither a dense matrix nor a solution of one is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSITIONS = 200_000  # of a block, about
MEMORY = 8  # earlier steps that the acceleration combines
TOLERANCE = 1e-12  # of the residual, relative to the largest value
MOST_SWEEPS = 100_000
TIE = 1e-9  # actions whose q differ by less are equal, so that the order of sums does not choose among them
ARRAYS = {"states": np.int64, "starts": np.int64, "actions": np.int64, "rewards": np.float64, "row": np.int64, "to": np.int64, "p": np.float64}


def _block(rows: pd.DataFrame, names: np.ndarray) -> dict[str, np.ndarray]:
    """A block's arrays: its states with the first of their rows, rows (state, action) with actions and rewards, and transitions with their row."""
    acts = rows[rows["r"].notna()].sort_values(["s", "a"], kind="stable")
    states, starts = np.unique(acts["s"].to_numpy(), return_index=True)
    moves = rows[rows["r"].isna()]
    own = pd.MultiIndex.from_frame(acts[["s", "a"]])
    row = own.get_indexer(pd.MultiIndex.from_frame(moves[["s", "a"]]))
    moves, row = moves[row >= 0], row[row >= 0]  # a step without a reward row can't be chosen
    return {"states": np.searchsorted(names, states), "starts": starts, "actions": acts["a"].to_numpy(), "rewards": acts["r"].to_numpy(), "row": row, "to": np.searchsorted(names, moves["s2"].to_numpy()), "p": moves["p"].to_numpy()}


class Process:
    """probs (s, a, s2, p) and rewards (s, a, r) in blocks; ``names`` are the states' ids in ascending order, ``known`` marks those with an action."""

    def __init__(self, probs: DataFrame, rewards: DataFrame):
        self.spark = probs.sparkSession
        none = F.lit(None)
        both = probs.select(F.col("s").cast("long"), F.col("a").cast("long"), F.col("s2").cast("long"), F.col("p").cast("double"), none.cast("double").alias("r"))
        both = both.unionByName(rewards.select(F.col("s").cast("long"), F.col("a").cast("long"), none.cast("long").alias("s2"), none.cast("double").alias("p"), F.col("r").cast("double"))).checkpoint()
        self.names = np.sort(both.select("s").union(both.where("s2 is not null").select("s2")).distinct().toPandas()["s"].to_numpy().astype(np.int64))
        names, blocks = self.names, max(1, -(-both.count() // TRANSITIONS))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({k: [v.astype(ARRAYS[k]).tobytes()] for k, v in _block(rows, names).items()})

        schema = ", ".join(f"{k} binary" for k in ARRAYS)
        self.blocks = both.groupBy(F.pmod(F.xxhash64("s"), F.lit(blocks)).alias("block")).applyInPandas(pack, schema).checkpoint()
        self.rewards = rewards
        self.known = np.isin(names, rewards.select(F.col("s").cast("long").alias("s")).distinct().toPandas()["s"].to_numpy().astype(np.int64))

    def _run(self, one: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out = one({k: np.frombuffer(row[k], kind) for k, kind in ARRAYS.items()})
                    yield pa.record_batch([pa.array(v) for v in out.values()], list(out))

        return self.blocks.mapInArrow(run, schema)

    def _collected(self, one, columns: dict[str, float]) -> list[np.ndarray]:
        """Vectors over all states from one of the block's (state, ...) results; states without an action keep the default."""
        found = self._run(one, ", ".join(["state long", *[f"{c} {'long' if isinstance(d, int) else 'double'}" for c, d in columns.items()]])).toArrow()
        at, out = found["state"].to_numpy(), []
        for c, default in columns.items():
            v = np.full(len(self.names), default)
            v[at] = found[c].to_numpy()
            out.append(v)
        return out

    def greedy(self, v: np.ndarray, gamma: float, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the largest q, its action) of each state; the first of equal actions, or that of ``keep`` where it is as good."""

        def one(b):
            q = _q(b, v, gamma)
            top = np.maximum.reduceat(q, b["starts"])
            rows = np.repeat(np.arange(len(top)), np.diff([*b["starts"], len(q)]))
            best = np.minimum.reduceat(np.where(q >= top[rows] - TIE, np.arange(len(q)), len(q)), b["starts"])
            if keep is not None:
                same = (b["actions"] == keep[b["states"]][rows]) & np.isclose(q, top[rows], rtol=1e-12, atol=1e-12)
                held = np.maximum.reduceat(np.where(same, np.arange(len(q)), -1), b["starts"])
                best = np.where(held >= 0, held, best)
            return {"state": b["states"], "v": top, "best": b["actions"][best]}

        top, best = self._collected(one, {"v": 0.0, "best": -1})
        return top, best

    def under(self, best: np.ndarray, v: np.ndarray, gamma: float) -> np.ndarray:
        """r + gamma * P v under a policy (an action a state)."""

        def one(b):
            rows = np.repeat(np.arange(len(b["states"])), np.diff([*b["starts"], len(b["actions"])]))
            chosen = np.flatnonzero(b["actions"] == best[b["states"]][rows])
            return {"state": b["states"][rows[chosen]], "v": _q(b, v, gamma)[chosen]}

        return self._collected(one, {"v": 0.0})[0]

    def table(self, best: np.ndarray, v: np.ndarray, gamma: float, rounds: int, gain: float) -> DataFrame:
        """s, a, q, best, v, rounds, gain."""
        names = self.names

        def one(b):
            rows = np.repeat(np.arange(len(b["states"])), np.diff([*b["starts"], len(b["actions"])]))
            at = b["states"][rows]
            return {"s": names[at], "a": b["actions"], "q": _q(b, v, gamma), "best": best[at], "v": v[at], "rounds": np.full(len(at), rounds), "gain": np.full(len(at), float(gain))}

        return self._run(one, "s long, a long, q double, best long, v double, rounds long, gain double")


def _q(b: dict[str, np.ndarray], v: np.ndarray, gamma: float) -> np.ndarray:
    return b["rewards"] + gamma * np.bincount(b["row"], weights=b["p"] * v[b["to"]], minlength=len(b["rewards"]))


def fixed_point(step: Callable[[np.ndarray], np.ndarray], v: np.ndarray, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> tuple[np.ndarray, int]:
    """(v, steps) with |step(v) - v| within tolerance * max(1, |v|), by Anderson's acceleration: each step combines the last MEMORY so that their residuals cancel best."""
    values, residuals, least = [], [], np.inf
    for n in range(1, most + 1):
        new = step(v)
        gap = new - v
        size = np.abs(gap).max(initial=0.0)
        if size <= tolerance * max(1.0, np.abs(v).max(initial=0.0)):
            return new, n
        if size > 10 * least:  # the combination was none: begin again from the plain step
            values, residuals = [], []
        least = min(least, size)
        values, residuals = [*values, new][-MEMORY:], [*residuals, gap][-MEMORY:]
        v = new
        if len(values) > 1:
            moves, turns = (np.stack([x[i + 1] - x[i] for i in range(len(x) - 1)], 1) for x in (values, residuals))
            weights = np.linalg.lstsq(turns, gap, rcond=1e-10)[0]
            mixed = new - moves @ weights
            v = mixed if np.isfinite(mixed).all() else new
    return v, most


def _span(change: np.ndarray) -> float:
    return float(change.max(initial=-np.inf) - change.min(initial=np.inf)) if len(change) else 0.0


def _by_values(p: Process, gamma, epsilon, most, sweeps):
    limit, v, best, n = (epsilon * (1 - gamma) / gamma if gamma < 1 else epsilon), np.zeros(len(p.names)), None, 0
    for n in range(1, most + 1):
        new, best = p.greedy(v, gamma)
        change, v = new - v, new
        if _span(change) < limit:
            break
    return best, v, n, 0.0


def _by_relative_values(p: Process, gamma, epsilon, most, sweeps):
    v, gain = np.zeros(len(p.names)), 0.0
    for n in range(1, most + 1):
        top, best = p.greedy(v, 1.0)
        new = top - gain
        change = new - v
        if _span(change) < epsilon or n == most:
            return best, new, n, gain + change.min(initial=np.inf)
        v, gain = new, new[-1]


def _by_policies(p: Process, gamma, epsilon, most, sweeps):
    """Stops when no action changes, as well after 20 rounds when 5 or fewer do."""
    v, best = p.greedy(np.zeros(len(p.names)), gamma)
    n = 0
    for n in range(1, most + 1):
        v, _ = fixed_point(lambda x: p.under(best, x, gamma), v)  # noqa: B023
        _, new = p.greedy(v, gamma, best)
        moved, best = int((new != best).sum()), new
        if moved == 0 or n > 20 and moved <= 5:
            break
    return best, v, n, 0.0


def _by_partial_policies(p: Process, gamma, epsilon, most, sweeps):
    limit = epsilon * (1 - gamma) / gamma if gamma < 1 else epsilon
    low = p.rewards.agg(F.min("r")).first()[0] or 0.0
    low = low if p.known.all() else min(low, 0.0)
    v, best = np.full(len(p.names), low / (1 - gamma) if gamma < 1 else 0.0), None
    for n in range(1, most + 1):
        new, best = p.greedy(v, gamma)
        change, v = new - v, new
        if _span(change) < limit:
            return best, v, n, 0.0
        for _ in range(sweeps):
            new = p.under(best, v, gamma)
            change, v = np.abs(new - v).max(initial=0.0), new
            if change < limit:
                break
    return best, v, most, 0.0


METHODS = {"values": _by_values, "relative": _by_relative_values, "policies": _by_policies, "partial": _by_partial_policies}


def solved(probs: DataFrame, rewards: DataFrame, method: str, gamma: float, epsilon: float, most: int, sweeps: int) -> DataFrame:
    """s, a, q, best, v, rounds, gain; see solvers.solved. Empty processes give no rows."""
    process = Process(probs, rewards)
    if not len(process.names):
        return process.table(np.zeros(0, np.int64), np.zeros(0), gamma, 0, 0.0)
    best, v, rounds, gain = METHODS[method](process, gamma, epsilon, most, sweeps)
    return process.table(best, v, 1.0 if method == "relative" else gamma, rounds, gain)
