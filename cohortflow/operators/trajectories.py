"""Actions, trajectories, and the empirical decision process, by windows and grouped sums.

A panel has icustayid, bloc, state, y90 and doses. Order is always that of bloc within a stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.functions.ranks import running

from . import repetitions

SURVIVED, DIED = 751, 750


def dose_bins(df: DataFrame, dose: str, bin_name: str, positive_only: bool) -> DataFrame:
    """df with bin_name: 1 for no dose, else 1 + the quartile bin of the dose's average rank among doses (``> 0`` or ``<> 0``).

    Average ranks come from the counts of equal doses, so only distinct doses are ordered, not all rows, and those in ranges.
    """
    used = df.where(F.col(dose) > 0 if positive_only else F.col(dose) != 0)
    counts = running(used.groupBy(dose).agg(F.count(F.lit(1)).alias("_n")), dose, "_n")
    rank = (F.col("before") + (F.col("_n") + 1) / 2) / F.col("total")
    bins = counts.select(F.col(dose).alias("_dose"), (F.floor((rank + 0.2499999999) * 4) + 1).cast("long").alias("_bin"))
    return df.join(bins, F.col(dose) == F.col("_dose"), "left").withColumn(bin_name, F.coalesce("_bin", F.lit(1).cast("long"))).drop("_dose", "_bin")


def with_actions(df: DataFrame) -> DataFrame:
    """df (iv, vaso) with io, vc and action: the place of (io, vc) among the pairs that occur, from 0."""
    binned = dose_bins(dose_bins(df, "iv", "io", True), "vaso", "vc", False)
    ids = binned.select("io", "vc").distinct().withColumn("action", (F.dense_rank().over(Window.orderBy("io", "vc")) - 1).cast("long"))  # 25 pairs at most
    return binned.join(F.broadcast(ids), ["io", "vc"])


def trajectory_log(df: DataFrame) -> DataFrame:
    """icustayid, bloc, state, action, reward, with a last row for each stay: action -1, an absorbing state and +-100."""
    last = df.groupBy("icustayid").agg((F.max("bloc") + 1).alias("bloc"), F.max("y90").alias("y90"))
    died = F.col("y90") == 1
    ends = last.select("icustayid", "bloc", F.when(died, DIED).otherwise(SURVIVED).cast("long").alias("state"), F.lit(-1).cast("long").alias("action"), F.when(died, -100.0).otherwise(100.0).alias("reward"))
    steps = df.select("icustayid", "bloc", "state", "action", F.lit(0.0).alias("reward"))
    return steps.unionByName(ends)


def transition_counts(log: DataFrame, least: int = 0) -> DataFrame:
    """s, a, s2, n: steps of the log, those seen ``least`` times or fewer left out."""
    step = Window.partitionBy("icustayid").orderBy("bloc")
    pairs = log.select(F.col("state").alias("s"), F.col("action").alias("a"), F.lead("state").over(step).alias("s2"))
    return pairs.where("a >= 0 and s2 is not null").groupBy("s", "a", "s2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def transition_probs(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("s", "a")))


def behaviour_policy(counts: DataFrame) -> DataFrame:
    """s, a, p: the share of each action among a state's supported steps."""
    both = counts.groupBy("s", "a").agg(F.sum("n").alias("n"))
    return both.select("s", "a", (F.col("n") / F.sum("n").over(Window.partitionBy("s"))).alias("p"))


def reward_matrix(probs: DataFrame) -> DataFrame:
    gain = F.when(F.col("s2") == SURVIVED, 100.0).when(F.col("s2") == DIED, -100.0).otherwise(0.0)
    return probs.groupBy("s", "a").agg(F.sum(F.col("p") * gain).alias("r"))


def softened(policy: DataFrame, actions: int, keep: float = 0.01) -> DataFrame:
    """s, a, p over all actions: unused ones share ``keep``, used ones give it up in equal parts."""
    spark = policy.sparkSession
    states = policy.groupBy("s").agg(F.count(F.when(F.col("p") > 0, 1)).alias("used"))
    grid = states.crossJoin(F.broadcast(spark.range(actions).withColumnRenamed("id", "a"))).join(policy, ["s", "a"], "left")
    some = F.coalesce("p", F.lit(0.0)) > 0
    return grid.select("s", "a", F.when(some, F.col("p") - keep / F.col("used")).otherwise(F.try_divide(F.lit(keep), F.lit(actions) - F.col("used"))).alias("p"))


def greedy_softened(policy: DataFrame, actions: int, keep: float = 0.01) -> DataFrame:
    """s, a, p from (s, best): 1 - keep at the best action, the rest in equal parts."""
    grid = policy.crossJoin(F.broadcast(policy.sparkSession.range(actions).withColumnRenamed("id", "a")))
    return grid.select("s", "a", F.when(F.col("a") == F.col("best"), 1 - keep).otherwise(keep / (actions - 1)).alias("p"))


def q_values(probs: DataFrame, rewards: DataFrame, values: DataFrame | None, gamma: float) -> DataFrame:
    """s, a, q = r + gamma * sum p * v; states without a value count 0. One join and one grouped sum."""
    if values is None:
        return rewards.select("s", "a", F.col("r").alias("q"))
    ahead = probs.join(values.select(F.col("s").alias("s2"), "v"), "s2", "left").groupBy("s", "a").agg(F.sum(F.col("p") * F.coalesce("v", F.lit(0.0))).alias("ahead"))
    return rewards.join(ahead, ["s", "a"], "left").select("s", "a", (F.col("r") + gamma * F.coalesce("ahead", F.lit(0.0))).alias("q"))


def greedy(q: DataFrame) -> DataFrame:
    """s, best, v: the first action of the largest q, and that q."""
    top = F.min(F.struct((-F.col("q")).alias("m"), F.col("a").alias("a"))).alias("t")
    return q.groupBy("s").agg(top).select("s", F.col("t.a").alias("best"), (-F.col("t.m")).alias("v"))


def value_iteration(probs: DataFrame, rewards: DataFrame, gamma: float, sweeps: int, checkpoint_every: int = 5) -> DataFrame:
    """s, best, v after a number of sweeps from zero; lineage is cut through spark.checkpoint.dir every few sweeps."""
    spark, found = probs.sparkSession, None
    for i in range(sweeps):
        found = greedy(q_values(probs, rewards, found, gamma))
        if (i + 1) % checkpoint_every == 0 and spark.sparkContext.getConf().get("spark.checkpoint.dir"):
            found = found.checkpoint()
    return found


def returns(log: DataFrame, pi_b: DataFrame, pi_e: DataFrame, gamma: float) -> DataFrame:
    """icustayid, rho, g: product of pi_e / pi_b over a stay's actions, and its discounted return."""
    step = Window.partitionBy("icustayid").orderBy("bloc")
    rows = log.withColumn("t", F.row_number().over(step) - 1)
    b, e = (x.select(F.col("s").alias("state"), F.col("a").alias("action"), F.col("p").alias(n)) for x, n in ((pi_b, "pb"), (pi_e, "pe")))
    rows = rows.join(b, ["state", "action"], "left").join(e, ["state", "action"], "left")
    ratio = F.when(F.col("action") >= 0, F.ln(F.col("pe") / F.when(F.col("pb") > 0, F.col("pb"))))
    lost = F.sum(F.when((F.col("action") >= 0) & ratio.isNull(), 1).otherwise(0))
    discounted = F.sum(F.when(F.col("t") > 0, F.pow(F.lit(gamma), F.col("t") - 1) * F.col("reward")))
    return rows.groupBy("icustayid").agg(F.when(lost == 0, F.exp(F.sum(ratio))).alias("rho"), discounted.alias("g"))


def weighted_importance(rows: DataFrame, weight: Column | None = None) -> Column:
    """sum(rho * g) / sum(rho) over stays with a finite rho."""
    w = F.col("rho") if weight is None else F.col("rho") * weight
    return F.try_divide(F.sum(w * F.col("g")), F.sum(w))


def bootstrap_wis(rows: DataFrame, times: int, share: float, seed: int = 0) -> DataFrame:
    """boot, wis: weighted importance sampling over Bernoulli samples of stays, drawn by digests of (id, boot); stays are read once, and none is copied."""
    known = rows.where(F.abs("rho") < float("inf")).select("icustayid", "rho", (F.col("rho") * F.col("g")).alias("gain"))
    sums = repetitions.summed(known, [], ["rho", "gain"], times, share, seed=seed)
    found = sums.select(F.col("rep").alias("boot"), F.try_divide("sum_gain", "sum_rho").alias("wis"))
    return F.broadcast(rows.sparkSession.range(times).withColumnRenamed("id", "boot")).join(found, "boot", "left")


def monte_carlo_q(log: DataFrame, gamma: float) -> DataFrame:
    """s, a, q: the mean discounted final reward over all visits of (s, a), each stay's first step left out."""
    step = Window.partitionBy("icustayid").orderBy("bloc")
    ends = log.groupBy("icustayid").agg(F.max("bloc").alias("last"), F.sum("reward").alias("final"))
    rows = log.withColumn("t", F.row_number().over(step)).join(ends, "icustayid").where("action >= 0 and t > 1")
    return rows.groupBy(F.col("state").alias("s"), F.col("action").alias("a")).agg(F.avg(F.pow(F.lit(gamma), F.col("last") - F.col("bloc") - 1) * F.col("final")).alias("q"))


def value_of_policy(q: DataFrame, policy: DataFrame, log: DataFrame) -> DataFrame:
    """One row, td_value: states' sums of p * q, weighted by how many stays start in each."""
    v = policy.join(q, ["s", "a"]).groupBy("s").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
    first = log.where("bloc = 1").groupBy(F.col("state").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return first.join(v, "s", "left").agg(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n")).alias("td_value"))


def histogram(df: DataFrame, value: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """by, bin, low, n, share: counts between equally spaced edges, bins open above but for the last, and their share of all rows of the group; empty bins have 0, and
    values outside the edges are in no bin."""
    width = (high - low) / bins
    at = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width)).cast("long")
    placed = df.select(*by, F.when((F.col(value) >= low) & (F.col(value) <= high), at).alias("bin"))
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("all_n")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    n = F.coalesce("n", F.lit(0))
    return whole.join(counts, [*by, "bin"], "left").select(*by, "bin", (low + width * F.col("bin")).alias("low"), n.alias("n"), (n / F.col("all_n")).alias("share"))
