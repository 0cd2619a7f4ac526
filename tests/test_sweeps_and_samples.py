"""Solvers without dense matrices, and bootstraps by masks, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.scalars import digest_uniform
from cohortflow.operators import repetitions, search, solvers, sparse_sweeps
from cohortflow.operators import trajectories as T


def dense(probs, rewards, n, actions):
    p, r = np.zeros((actions, n, n)), np.full((n, actions), -np.inf)
    for s, a, s2, x in probs:
        p[a, s, s2] += x
    for s, a, x in rewards:
        r[s, a] = x
    return p, r


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    n, actions = 60, 4
    probs, rewards = [], []
    for s in range(n - 2):  # the last two have no action
        for a in range(actions):
            if a and rng.random() < 0.3:
                continue
            to = rng.choice(n, 5, replace=False)
            probs += [(s, a, int(t), float(x)) for t, x in zip(to, rng.dirichlet(np.ones(5)))]
            rewards.append((s, a, float(rng.standard_normal())))
    return probs, rewards, n, actions, spark.createDataFrame(probs, "s long, a long, s2 long, p double"), spark.createDataFrame(rewards, "s long, a long, r double")


def best_values(p, r, gamma):
    v, known = np.zeros(len(r)), np.isfinite(r).any(1)
    for _ in range(5000):
        q = np.where(known[:, None], r + gamma * np.stack([x @ v for x in p], 1), 0.0)
        v = q.max(1)
    return v, q


@pytest.mark.parametrize("blocks", [500, 10**6])
def test_policies_reach_the_best_values(small, monkeypatch, blocks):
    probs, rewards, n, actions, pf, rf = small
    monkeypatch.setattr(sparse_sweeps, "TRANSITIONS", blocks)
    v, q = best_values(*dense(probs, rewards, n, actions), 0.95)
    found = solvers.solved(pf, rf, "policies", 0.95).collect()
    assert {r["s"] for r in found} == set(range(n - 2)) and len(found) == len(rewards)
    assert all(r["v"] == pytest.approx(v[r["s"]], abs=1e-8) and r["q"] == pytest.approx(q[r["s"], r["a"]], abs=1e-8) and r["best"] == q[r["s"]].argmax() for r in found)


@pytest.mark.parametrize("method, most", [("values", 4), ("partial", 2)])
def test_values_in_blocks_are_those_of_joins(small, monkeypatch, method, most):
    *_, pf, rf = small
    here = {(r["s"], r["a"]): r for r in solvers.solved(pf, rf, method, 0.9, 1e-4, most, 2).collect()}
    monkeypatch.setattr(solvers, "MOST_STATES", 5)
    joined = solvers.solved(pf, rf, method, 0.9, 1e-4, most, 2).collect()
    assert len(joined) == len(here) and (method == "partial" or all(r["v"] == pytest.approx(here[r["s"], r["a"]]["v"]) for r in joined))


def test_relative_values_of_a_small_process(spark):
    probs = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 0, 0.5), (1, 0, 1, 0.5)], "s long, a long, s2 long, p double")
    rewards = spark.createDataFrame([(0, 0, 3.0), (1, 0, 0.0)], "s long, a long, r double")
    found = solvers.solved(probs, rewards, "relative", 1.0, 1e-9).collect()
    assert all(r["gain"] == pytest.approx(1.0, abs=1e-6) for r in found)  # a third of all steps start in state 0


def test_a_hundred_thousand_states(spark):
    n = 100_000
    steps = spark.range(n).select(F.col("id").alias("s"), F.explode(F.expr("array(0L, 1L)")).alias("a")).withColumn("to", F.explode(F.expr("array(0L, 1L, 2L)")))
    probs = steps.select("s", "a", F.pmod(F.col("s") * 7 + F.col("a") * 3 + F.col("to") * 11 + 1, F.lit(n)).alias("s2"), F.when(F.col("to") == 0, 0.5).otherwise(0.25).alias("p"))
    rewards = spark.range(n).select(F.col("id").alias("s"), F.explode(F.expr("array(0L, 1L)")).alias("a")).withColumn("r", F.pmod(F.col("s") * (F.col("a") + 1), F.lit(17)).cast("double"))
    found = solvers.solved(probs, rewards, "policies", 0.9)
    top = found.groupBy("s").agg(F.max("q").alias("q"), F.max("v").alias("v"))
    assert top.count() == n and top.agg(F.max(F.abs(F.col("q") - F.col("v")))).first()[0] < 1e-8  # Bellman's equation holds everywhere


def test_an_empty_process(spark):
    probs, rewards = spark.createDataFrame([], "s long, a long, s2 long, p double"), spark.createDataFrame([], "s long, a long, r double")
    assert [solvers.solved(probs, rewards, m, 0.9).count() for m in sparse_sweeps.METHODS] == [0, 0, 0, 0]


def test_acceleration_takes_fewer_steps():
    rng = np.random.default_rng(2)
    m = rng.random((80, 80))
    m = 0.99 * m / m.sum(1, keepdims=True)
    b = rng.standard_normal(80)
    v, n = sparse_sweeps.fixed_point(lambda x: b + m @ x, np.zeros(80))
    assert np.allclose(v, np.linalg.solve(np.eye(80) - m, b)) and n < 60


STAYS = [3, 5, None, 8, 13, 21, 34, 55]


def test_masks_are_the_draws_of_the_digest(spark):
    df = spark.createDataFrame([(s,) for s in STAYS], "icustayid long")
    for tag in ("", "td"):
        mine = repetitions.masks(STAYS, 30, 0.6, tag, 4)
        keys = lambda i: ["icustayid", F.lit(i), *([F.lit(tag)] if tag else [])]
        theirs = df.select(*[(digest_uniform(*keys(i), seed=4) < 0.6).alias(f"d{i}") for i in range(30)]).collect()
        assert [list(r) for r in theirs] == mine.tolist()
        arrays = df.select(repetitions.drawn("icustayid", 30, 0.6, tag, 4).alias("d")).collect()
        assert [r["d"] for r in arrays] == [np.flatnonzero(row).tolist() for row in mine]


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_sums_over_all_repetitions(spark, monkeypatch, held):
    monkeypatch.setattr(repetitions, "HELD", held)
    monkeypatch.setattr(repetitions, "STAYS", 3)
    rng = np.random.default_rng(1)
    rows = [(STAYS[int(rng.integers(8))], int(rng.integers(3)), float(rng.standard_normal()) if rng.random() < 0.8 else None) for _ in range(300)]
    df = spark.createDataFrame(rows, "icustayid long, k long, v double").repartition(3)
    mask = dict(zip(STAYS, repetitions.masks(STAYS, 12, 0.5)))
    want = {}
    for s, k, v in rows:
        for rep in np.flatnonzero(mask[s]):
            n, total = want.get((int(rep), k), (0, 0.0))
            want[int(rep), k] = n + 1, total + (v or 0.0)
    found = {(r["rep"], r["k"]): (r["n"], r["sum_v"]) for r in repetitions.summed(df, ["k"], ["v"], 12, 0.5).collect()}
    assert found.keys() == want.keys() and all(found[k][0] == n and found[k][1] == pytest.approx(total) for k, (n, total) in want.items())


def test_means_of_records_are_those_of_the_rows(spark):
    rng = np.random.default_rng(7)
    log = [(s, b, int(rng.integers(4)), int(rng.integers(2)), 0.0) for s in range(12) for b in range(1, 6)] + [(s, 6, 750 + s % 2, -1, 100.0 if s % 2 else -100.0) for s in range(12)]
    log = spark.createDataFrame(log, "icustayid long, bloc long, state long, action long, reward double")
    outcomes = spark.createDataFrame([(s, s % 2) for s in range(12)], "icustayid long, y90 int")
    policy = T.behaviour_policy(T.transition_counts(log))
    rows = search.record_values(log, outcomes, policy, 0.9, 7).groupBy("rep", "y90").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("q")).collect()
    means = {(r["rep"], r["y90"]): (r["n"], r["q"]) for r in search.record_means(log, outcomes, policy, 0.9, 7).collect()}
    assert len(rows) == len(means) and all(means[r["rep"], r["y90"]] == (r["n"], pytest.approx(r["q"])) for r in rows)
    values = search.behaviour_values(log, policy, 0.9, 7).collect()
    assert [r["boot"] for r in sorted(values, key=lambda r: r["boot"])] == list(range(7))


def test_the_best_of_several_models_is_kept(spark, monkeypatch):
    bounds = {1: -3.0, 2: 7.5, 3: None, 4: 7.5, 5: 2.0}
    monkeypatch.setattr(search, "one_model", lambda panel, features, model, **options: ({"model": model, "test_wis_5": bounds[model]}, {"policy": model}))
    panel = spark.createDataFrame([(1,)], "x long")
    table, kept = search.model_search(panel, ["x"], 5)
    assert {r["model"]: r["test_wis_5"] for r in table.collect()} == bounds and kept == {"policy": 2}
    assert search.model_search(panel, ["x"], 1)[1] is None  # none is above 0
