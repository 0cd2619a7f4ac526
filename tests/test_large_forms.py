"""Operators that count, step and search for many keys at once, against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import ranks, selection
from cohortflow.operators import clusters, federated, many_means, metric_index, models, neighbours, search


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else "ab"[i % 2], float(rng.standard_normal() * 10.0 ** rng.integers(-5, 5)) if i % 5 else None, float(rng.integers(-2, 3)) if i % 3 else math.nan, 7.5) for i in range(4_000)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5).cache()


@pytest.mark.parametrize("few", [100_000, 3])
def test_selected_quantiles(mixed, few, monkeypatch):
    rows, df = mixed
    monkeypatch.setattr(selection, "FEW", few)  # the values are read, or all 64 bits are counted
    found = {r["g"]: r for r in ranks.column_quantiles(df, ["x", "y", "z"], {"low": 0.01, "mid": 0.5, "high": 0.99}, ["g"]).collect()}
    for g in (None, "a", "b"):
        for j, c in enumerate("xyz"):
            values = [r[j + 1] for r in rows if r[0] == g and r[j + 1] is not None and not math.isnan(r[j + 1])]
            for name, q in (("low", 0.01), ("mid", 0.5), ("high", 0.99)):
                assert found[g][f"{name}_{c}"] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300)


def test_quantiles_of_many_groups_and_of_none(spark, mixed, monkeypatch):
    _, df = mixed
    few = ranks.column_quantiles(df, ["x"], {"q": 0.3}, ["g"]).collect()
    monkeypatch.setattr(selection, "MOST_OPEN", 3)  # three groups are too many then
    many = ranks.column_quantiles(df, ["x"], {"q": 0.3}, ["g"]).where("g is not null").collect()
    assert {(r["g"], round(r["q_x"], 9)) for r in many} == {(r["g"], round(r["q_x"], 9)) for r in few if r["g"]}
    empty = spark.createDataFrame([], "g string, x double")
    assert ranks.quantiles(empty, "x", {"q": 0.5}, ["g"]).count() == 0
    assert ranks.quantiles(spark.createDataFrame([("a", None)], "g string, x double"), "x", {"q": 0.5}, ["g"]).collect() == [("a", None)]


def test_keys_keep_the_order_of_values():
    values = np.array([-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 2.5, math.inf])
    keys = selection.keys_of(values)
    assert all(a <= b for a, b in zip(keys, keys[1:])) and keys[4] == keys[5]
    assert [selection.value_of(int(k)) for k in keys] == values.tolist()


def plain_lloyd(x, c, rounds, threshold):
    for _ in range(rounds):
        k = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[k == j].mean(0) if (k == j).any() else c[j] for j in range(len(c))])
        change, c = np.abs(new - c).mean(), new
        if change <= threshold:
            break
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    return c, np.bincount(d2.argmin(1), minlength=len(c)), d2.min(1).sum()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 6)) * 20
    x = middles[rng.integers(0, 40, 4_000)] + rng.standard_normal((4_000, 6)) * 0.3
    df = spark.createDataFrame([(i, i % 3, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "id long, site long, x array<double>, label long").repartition(6).cache()
    return x, df


def test_many_keys_step_as_each_would(blobs, monkeypatch):
    x, df = blobs
    monkeypatch.setattr(many_means, "MOST_BYTES", 700)  # several turns
    starts = {i: (i % 3, x[i % 3 :: 3][5 * i : 5 * i + 2 + i]) for i in range(7)}
    runs = many_means.fit(df.withColumnRenamed("site", "pool"), starts, 40, 1e-6)
    for i, (pool, c) in starts.items():
        centres, sizes, cost = plain_lloyd(x[pool::3], c, 40, 1e-6)
        assert np.allclose(runs[i].centres, centres) and runs[i].sizes.tolist() == sizes.tolist() and runs[i].cost == pytest.approx(cost)


def test_sites_upload_the_best_of_their_starts(spark, blobs):
    x, df = blobs
    rows = [(s, t, k, x[s::3][10 * t + k].tolist()) for s in range(3) for t in range(4) for k in range(3)]
    found = federated.site_lloyd(df, spark.createDataFrame(rows, "site long, start long, k long, c array<double>"), threshold=1e-9).collect()
    for s in range(3):
        costs = [plain_lloyd(x[s::3], x[s::3][10 * t : 10 * t + 3], 300, 1e-9)[2] for t in range(4)]
        assert sum(r["inertia"] for r in found if r["site"] == s) == pytest.approx(min(costs)) and sum(r["n"] for r in found if r["site"] == s) == len(x[s::3])


def test_restarts_find_the_blobs(blobs):
    x, df = blobs
    _, cost = models.kmeans_restarts(df, 40, 8)
    assert cost < 2 * 6 * 0.09 * len(x)


def test_nearest_centre_of_more_than_one_array(spark, blobs, monkeypatch):
    x, df = blobs
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:23])], "k long, c array<double>")
    monkeypatch.setattr(clusters, "MOST_CENTRES", 5)
    found = {r["id"]: (r["k"], r["d2"]) for r in clusters.nearest(df, centres).collect()}
    d2 = ((x[:, None] - x[None, :23]) ** 2).sum(2)
    assert all(k == d2[i].argmin() and d == pytest.approx(d2[i].min()) for i, (k, d) in found.items()) and len(found) == len(x)


def test_metric_index_compares_a_tenth_of_all_pairs_at_most(blobs):
    x, df = blobs
    balls = metric_index.Balls(df, 64)
    queries = df.where("id % 4 = 0")
    found = {}
    for r in balls.nearest(queries, 5, skip_self=True).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q in range(0, len(x), 4):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [i for _, i in sorted(found[q])] == sorted(range(len(x)), key=lambda i: (d[i], i))[:5]
    sizes = dict(zip(balls.radii["ball"], balls.radii["n"]))
    pairs = sum(sizes[r["ball"]] for opened in balls.passes(queries, 5, True) for r in opened.select("ball").collect())
    assert pairs < 0.1 * (len(x) // 4) * len(x)


def test_metric_index_with_ties_copies_and_few_points(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(100, [9.0, 9.0]), (101, None), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    near = neighbours.nearest_points(df.where("id in (7, 100)"), df, 4, block=8).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in near) == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (7, 4, 3), (100, 1, 100), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert neighbours.nearest_points(df, df.where("id = 100"), 4).count() == 51  # fewer points than k
    assert neighbours.nearest_points(df.limit(0), df.limit(0), 4).count() == 0


def test_fitness_of_a_population_is_that_of_each(spark, blobs):
    _, df = blobs
    small = df.where("id < 300").withColumn("label", F.col("id") % 3)
    train, held = small.where("id % 5 <> 0"), small.where("id % 5 = 0")
    masks = [[0, 1, 2, 3, 4, 5], [2], [], [1, 4]]
    together = neighbours.population_fitness(train, held, masks, 6)
    assert together == pytest.approx([neighbours.subset_fitness(train, held, m, 6).first()[0] for m in masks])


def test_foraging_asks_once_a_round():
    asked = []

    def fitness(masks):
        asked.append(len(masks))
        return [1.0 + len(set(m) ^ {1, 3}) for m in masks]

    chosen, curve = search.foraging(fitness, 5, 12, 3, 20, 4)
    assert chosen.tolist() == [1, 3] and curve[-1] == 1.0 and all(b <= a for a, b in zip(curve, curve[1:])) and len(asked) <= 20


def test_silhouettes_of_several_labels_in_one_pass(spark, blobs):
    _, df = blobs
    small = df.where("id < 200").select("id", "x", (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"))
    both = neighbours.mean_silhouettes(small, ["a", "b"])
    for name in ("a", "b"):
        one = neighbours.silhouettes(small.withColumn("label", F.col(name))).agg(F.avg("s")).first()[0]
        assert both[name] == pytest.approx(one)
