"""Decision processes as tables: checks with typed errors, reward forms, and example processes. (s, a, s2, p) and (s, a, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.scalars import digest_uniform


class ProcessError(ValueError):
    """A process that cannot be solved."""


class InvalidProcess(ProcessError):
    """Discount, rewards or tables do not fit each other."""


class NegativeProbability(ProcessError):
    """A probability is below 0."""


class NotSquare(ProcessError):
    """A state that is reached has no row of its own."""


class NotStochastic(ProcessError):
    """The probabilities of a state and action do not add up to 1."""


def check(probs: DataFrame, rewards: DataFrame, gamma: float, closed: bool = True, tolerance: float = 1e-9) -> None:
    """Raise the error of the first test that fails; one aggregation for each table. closed: every state that is reached has an action."""
    if not 0 < gamma <= 1:
        raise InvalidProcess(f"a discount of {gamma} is not within (0, 1]")
    sums = probs.groupBy("s", "a").agg(F.sum("p").alias("t"), F.min("p").alias("low"))
    low, off, n = sums.agg(F.min("low"), F.max(F.abs(F.col("t") - 1)), F.count(F.lit(1))).first()
    if not n:
        raise InvalidProcess("there are no transitions")
    if low < 0:
        raise NegativeProbability(f"the smallest probability is {low}")
    if off > tolerance:
        raise NotStochastic(f"probabilities add up to 1 only within {off}")
    if closed and not probs.select(F.col("s2").alias("s")).join(probs.select("s"), "s", "left_anti").isEmpty():
        raise NotSquare("a state that is reached has no transitions")
    if not probs.select("s", "a").join(rewards.select("s", "a"), ["s", "a"], "left_anti").isEmpty():
        raise InvalidProcess("a state and action have no reward")


def rewards_of(probs: DataFrame, rewards: DataFrame) -> DataFrame:
    """s, a, r from rewards of states (s, r), of states and actions (s, a, r), or of steps (s, a, s2, r), which are averaged by their probabilities."""
    names = set(rewards.columns)
    if {"s", "a", "s2", "r"} <= names:
        return probs.join(rewards.select("s", "a", "s2", "r"), ["s", "a", "s2"], "left").groupBy("s", "a").agg(F.sum(F.col("p") * F.coalesce("r", F.lit(0.0))).alias("r"))
    if {"s", "a", "r"} <= names:
        return rewards.select("s", "a", "r")
    if {"s", "r"} <= names:
        return probs.select("s", "a").distinct().join(rewards.select("s", "r"), "s")
    raise InvalidProcess(f"rewards have the columns {sorted(names)}")


def span(values: DataFrame) -> float:
    """The largest less the smallest v."""
    top, low = values.agg(F.max("v"), F.min("v")).first()
    return (top or 0.0) - (low or 0.0)


def forest(spark: SparkSession, states: int = 3, wait: float = 4.0, cut: float = 2.0, fire: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """A wood that ages by a state a year when it is left alone (action 0) unless it burns, or is cut (action 1) and begins anew."""
    if states < 2 or wait <= 0 or cut <= 0 or not 0 <= fire <= 1:
        raise InvalidProcess("a forest has two states or more, positive rewards and a probability of fire")
    s = spark.range(states).withColumnRenamed("id", "s")
    older = F.least(F.col("s") + 1, F.lit(states - 1))
    moves = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("s2"), F.lit(fire).alias("p")), F.struct(F.lit(0).cast("long").alias("a"), older.alias("s2"), F.lit(1.0 - fire).alias("p")), F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("s2"), F.lit(1.0).alias("p")))
    probs = s.select("s", F.explode(moves).alias("m")).select("s", "m.*").where("p > 0")
    cutting = F.when(F.col("s") == 0, 0.0).when(F.col("s") == states - 1, cut).otherwise(1.0)
    gain = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.when(F.col("s") == states - 1, wait).otherwise(0.0).alias("r")), F.struct(F.lit(1).cast("long").alias("a"), cutting.alias("r")))
    return probs, s.select("s", F.explode(gain).alias("m")).select("s", "m.*")


def small(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The two-state process of the literature."""
    probs = [(0, 0, 0, 0.5), (0, 0, 1, 0.5), (1, 0, 0, 0.8), (1, 0, 1, 0.2), (0, 1, 1, 1.0), (1, 1, 0, 0.1), (1, 1, 1, 0.9)]
    return spark.createDataFrame(probs, "s long, a long, s2 long, p double"), spark.createDataFrame([(0, 0, 5.0), (0, 1, 10.0), (1, 0, -1.0), (1, 1, 2.0)], "s long, a long, r double")


def random_process(spark: SparkSession, states: int, actions: int, share: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A process drawn by digests: each step is possible with probability ``share``, that to the next state always; rewards lie within -1 and 1."""
    if states < 1 or actions < 1 or not 0 < share <= 1:
        raise InvalidProcess("a process has states, actions and possible steps")
    pairs = spark.range(states * actions).select((F.col("id") % states).alias("s"), F.floor(F.col("id") / states).alias("a"))
    each = pairs.withColumn("s2", F.explode(F.sequence(F.lit(0), F.lit(states - 1)).cast("array<bigint>")))
    kept = each.where((digest_uniform("s", "a", "s2", F.lit("mask"), seed=seed) < share) | (F.col("s2") == (F.col("s") + 1) % states))
    weighed = kept.withColumn("w", digest_uniform("s", "a", "s2", seed=seed) + 1e-6)
    total = weighed.groupBy("s", "a").agg(F.sum("w").alias("t"))
    probs = weighed.join(total, ["s", "a"]).select("s", "a", "s2", (F.col("w") / F.col("t")).alias("p"))
    return probs, pairs.select("s", "a", (2 * digest_uniform("s", "a", F.lit("reward"), seed=seed) - 1).alias("r"))
