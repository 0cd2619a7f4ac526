"""Solutions of a decision process given as rows (s, a, s2, p) and (s, a, r): sweeps are joins and grouped sums.

The driver sees one number a round, the span or largest change; values stay in tables. Lineage is cut by checkpoint() every round,
below spark.checkpoint.dir, which must be set. States without a row count 0. Empty processes give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparse_sweeps
from .trajectories import greedy, q_values

MOST_STATES = 4_000_000  # whose values (8 bytes each) go to every task


def _held(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def _change(new: DataFrame, old: DataFrame) -> tuple[float, float]:
    """The largest and smallest of new v - old v."""
    both = new.select("s", "v").join(old.select("s", F.col("v").alias("w")), "s", "left")
    step = F.col("v") - F.coalesce("w", F.lit(0.0))
    top, low = both.agg(F.max(step), F.min(step)).first()
    return top or 0.0, low or 0.0


def solve_by_values(probs: DataFrame, rewards: DataFrame, gamma: float, epsilon: float = 0.01, most: int = 1000) -> tuple[DataFrame, int]:
    """(s, best, v) and the number of sweeps: until the span of a sweep's change is under epsilon * (1 - gamma) / gamma."""
    limit = epsilon * (1 - gamma) / gamma if gamma < 1 else epsilon
    found, n = None, 0
    while n < most:
        n += 1
        new = _held(greedy(q_values(probs, rewards, found, gamma)))
        top, low = _change(new, found if found is not None else new.withColumn("v", F.lit(0.0)))
        found = new
        if top - low < limit:
            break
    return found, n


def relative_values(probs: DataFrame, rewards: DataFrame, epsilon: float = 0.01, most: int = 1000) -> tuple[DataFrame, float, int]:
    """(s, best, v), the mean reward a step and the number of sweeps, without discount: each sweep takes off the last state's value."""
    now, gain, n = rewards.select("s").distinct().withColumn("v", F.lit(0.0)), 0.0, 0
    while True:
        n += 1
        swept = _held(greedy(q_values(probs, rewards, now, 1.0)).withColumn("v", F.col("v") - F.lit(gain)))
        top, low = _change(swept, now)
        if top - low < epsilon or n >= most:
            return swept, gain + low, n
        now, gain = swept, swept.agg(F.max_by("v", "s")).first()[0] or 0.0


def policy_values(probs: DataFrame, rewards: DataFrame, policy: DataFrame, gamma: float, tolerance: float = 1e-9, most: int = 100_000) -> DataFrame:
    """s, v of a policy (s, best) by plain sweeps until the largest change is under ``tolerance``; for processes of any number of states."""
    chosen = policy.select("s", F.col("best").alias("a"))
    values = _held(rewards.join(chosen, ["s", "a"]).select("s", F.col("r").alias("v")))
    rewards, steps = rewards.join(chosen, ["s", "a"]), probs.join(chosen, ["s", "a"])
    for _ in range(most):
        before = values
        for _ in range(5):  # sweeps between two looks at the change
            before, values = values, q_values(steps, rewards, values, gamma).select("s", F.col("q").alias("v"))
        new = _held(values)
        top, low = _change(new, before)
        values = new
        if max(top, -low) < tolerance:
            break
    return values


def solved(probs: DataFrame, rewards: DataFrame, method: str, gamma: float = 1.0, epsilon: float = 0.01, most: int = 1000, sweeps: int = 10) -> DataFrame:
    """s, a, q, best, v, rounds, gain of a process of any number of states; method: "values", "relative", "policies" or "partial".

    probs (s, a, s2, p) and rewards (s, a, r). Up to MOST_STATES states their values pass through the driver, which sparse_sweeps sends to blocks of transitions;
    beyond that values stay in tables and every sweep is a join. q is of the returned v. The first of equal actions is best, save that a policy
    keeps an action that is as good.
    """
    states = probs.select("s").union(probs.select(F.col("s2"))).union(rewards.select("s")).distinct()
    if states.limit(MOST_STATES + 1).count() <= MOST_STATES:
        return sparse_sweeps.solved(probs, rewards, method, gamma, epsilon, most, sweeps)
    gain = 0.0
    if method == "relative":
        found, gain, rounds = relative_values(probs, rewards, epsilon, most)
    elif method == "values":
        found, rounds = solve_by_values(probs, rewards, gamma, epsilon, most)
    elif method == "policies":
        found, rounds = solve_by_policies(probs, rewards, gamma, most)
    else:
        found, rounds = solve_by_partial_policies(probs, rewards, gamma, epsilon, sweeps, most)
    q = q_values(probs, rewards, found.select("s", "v"), gamma if method != "relative" else 1.0)
    return q.join(found.select("s", "best", "v"), "s").select("s", "a", "q", "best", "v", F.lit(rounds).cast("long").alias("rounds"), F.lit(gain).alias("gain"))


def solve_by_policies(probs: DataFrame, rewards: DataFrame, gamma: float, most: int = 1000, tolerance: float = 1e-9) -> tuple[DataFrame, int]:
    """(s, best, v) and the number of rounds: greedy on rewards first, then evaluated and made greedy until no action changes."""
    policy = _held(greedy(rewards.select("s", "a", F.col("r").alias("q"))).select("s", "best"))
    n = 0
    while True:
        n += 1
        values = policy_values(probs, rewards, policy, gamma, tolerance)
        new = _held(greedy(q_values(probs, rewards, values, gamma)).select("s", "best"))
        moved = new.join(policy.withColumnRenamed("best", "old"), "s").where("best <> old").count()
        if not moved or n >= most:
            return policy.join(values, "s"), n
        policy = new


def solve_by_partial_policies(probs: DataFrame, rewards: DataFrame, gamma: float, epsilon: float = 0.01, sweeps: int = 10, most: int = 1000) -> tuple[DataFrame, int]:
    """(s, best, v) and the number of rounds: a greedy sweep, then up to ``sweeps`` under its policy, from min r / (1 - gamma)."""
    limit = epsilon * (1 - gamma) / gamma if gamma < 1 else epsilon
    low = rewards.agg(F.min("r")).first()[0] or 0.0
    now = rewards.select("s").distinct().withColumn("v", F.lit(low / (1 - gamma) if gamma < 1 else 0.0))
    n = 0
    while True:
        n += 1
        best = _held(greedy(q_values(probs, rewards, now, gamma)))
        top, bottom = _change(best, now)
        if top - bottom < limit or n >= most:
            return best, n
        chosen = best.select("s", F.col("best").alias("a"))
        mine, r, now = probs.join(chosen, ["s", "a"]), rewards.join(chosen, ["s", "a"]), best.select("s", "v")
        for _ in range(sweeps):
            new = _held(q_values(mine, r, now, gamma).select("s", F.col("q").alias("v")))
            top, bottom = _change(new, now)
            now = new
            if max(top, -bottom) < limit:
                break
