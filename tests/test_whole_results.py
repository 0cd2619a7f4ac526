"""Results that hold for any order, numbering and partitioning of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import scalars


def test_exact_mean_for_any_order(spark):
    rng = np.random.default_rng(3)
    values = [0.1, 0.2, 0.3, 0.4, 1e7, 49.5, 50.5] * 9
    want = math.fsum(round(100 * v) for v in values) / 100 / len(values)
    rows = [(g, float(v)) for g in range(60) for v in rng.permutation(values)] + [(99, None), (100, math.inf), (100, 1.0), (101, 1e300), (101, 0.5), (102, 1 / 3)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(7)
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(scalars.exact_mean(F.col("v")).alias("m")).collect()}
    assert {got.pop(g) for g in range(60)} == {want}
    assert got == {99: None, 100: math.inf, 101: pytest.approx(5e299), 102: 1 / 3}


def test_outcome_hist_keeps_means_on_an_edge(spark, tmp_path):
    from cohortflow.plans import process

    values = [0.1, 0.2, 0.3, 99.4, 49.3, 50.7, 100.0, 20.0]  # their mean is 40, so a stay's value lies on the edge -20
    rng, rows = np.random.default_rng(4), []
    for user in range(40):
        for v in rng.permutation(values):
            rows.append((len(rows), user, float(v)))
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumns({"ts": F.timestamp_seconds("event_id"), "event_type": F.lit("view")})
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["y90"], r["bin"]): r["n"] for r in process.outcome_hist(spark, str(tmp_path)).collect() if r["n"]}
    assert got == {(0, 16): 32, (1, 16): 8}


def test_uploads_do_not_hang_on_the_numbering_of_rows(spark, tmp_path):
    from cohortflow.plans import flow

    x = np.random.default_rng(5).standard_normal((360, 4)).tolist()
    found = []
    for name, step in (("dense", 1), ("sparse", 1_000)):  # 1,000 % 3 is 1: sites and order stay
        spark.createDataFrame([(i * step, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found.append(sorted(tuple(r) for r in flow.fed_uploads(spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1] and len(found[0]) == 30


@pytest.mark.parametrize("most", [None, 0])
def test_judged_subsets_are_those_of_plain_loops(spark, most, monkeypatch):
    from cohortflow.operators import neighbours

    if most is not None:
        monkeypatch.setattr(neighbours, "MOST_BYTES", most)  # blocks meet
    monkeypatch.setattr(neighbours, "STRETCH", 32)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (300, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v, int(i * 7 % 3)) for i, v in enumerate(x.tolist())], "id long, x array<double>, label long")
    train, held = df.where("id % 6 <> 0"), df.where("id % 6 = 0")
    masks = [[0, 1, 2, 3, 4], [2], [], [1, 4]]
    labels, ids = np.arange(300) * 7 % 3, np.arange(300)
    want = []
    for m in masks:
        predicted, odd = {}, 0
        for q in range(0, 300, 6):
            d2 = ((x[:, m] - x[q, m]) ** 2).sum(1)
            order = [i for i in np.lexsort((ids, d2)) if i != q]
            votes = np.bincount([labels[i] for i in order if i % 6][:5], minlength=3)
            predicted[q] = int(votes.argmax())
            odd += sum(labels[i] != labels[q] for i in [i for i in order if i % 6 == 0][:4]) > 2
        f = [2 * t / (n + t) for c in range(3) for t, n in [(sum(labels[q] == p == c for q, p in predicted.items()), sum(c in (labels[q], p) for q, p in predicted.items()))] if n]
        want.append(0.98 * (1 - sum(f) / len(f)) + 0.01 * len(m) / 5 + 0.01 * odd / 50 if m else 1.0)
    judge = neighbours.population_judge(train, held, 5)
    assert judge(masks) == pytest.approx(want, abs=1e-12) and judge([[2], [1, 4]]) == pytest.approx([want[1], want[3]], abs=1e-12)


def _plain_fit(x, c, rounds, threshold):
    changes = []
    for done in range(rounds + 1):
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        k = d2.argmin(1)
        n = np.bincount(k, minlength=len(c))
        if (changes and changes[-1] <= threshold) or done == rounds:
            return c, n, np.bincount(k, d2[np.arange(len(x)), k], len(c)), changes
        new = np.where(n[:, None] > 0, np.stack([np.bincount(k, v, len(c)) for v in x.T], 1) / np.maximum(n, 1)[:, None], c)
        changes.append(float(np.sqrt(((new - c) ** 2).sum(1)).max()))
        c = new


def test_held_fits_are_lloyds_steps(spark, monkeypatch):
    from cohortflow.operators import many_means

    rng = np.random.default_rng(8)
    pools = {0: rng.standard_normal((600, 3)) + 1e3, 1: rng.integers(0, 3, (400, 3)).astype(float)}  # far from 0, and many copies and ties
    df = spark.createDataFrame([(p, v) for p, x in pools.items() for v in x.tolist()], "pool long, x array<double>").repartition(3)
    starts = {n: (p, pools[p][rng.choice(len(pools[p]), k, replace=False)]) for n, (p, k) in enumerate([(0, 4), (0, 90), (1, 4), (0, 1)])}
    starts[9] = (7, np.zeros((2, 3)))  # a pool without points
    jobs = []
    monkeypatch.setattr(many_means, "_step", lambda *a, **b: jobs.append(1))
    runs = many_means.fit(df, starts, 200, 1e-4, furthest=True)
    assert not jobs  # no job a step
    for n, (p, c) in starts.items():
        if n != 9:
            centres, sizes, inertia, changes = _plain_fit(pools[p], c, 200, 1e-4)
            assert runs[n].sizes.tolist() == sizes.tolist() and len(runs[n].changes) == len(changes)
            assert np.allclose(runs[n].centres, centres, atol=1e-9) and np.allclose(runs[n].inertia, inertia, atol=1e-8)
    assert runs[9].sizes.tolist() == [0, 0] and runs[9].centres.tolist() == [[0.0] * 3] * 2


def test_nearest_in_tasks_is_that_of_column_functions(spark):
    from cohortflow.operators import clusters

    rng = np.random.default_rng(9)
    x = [*rng.integers(0, 5, (300, 3)).astype(float).tolist(), None, [1.0], [1.0, None, 2.0]]
    points = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x)], "id long, x array<double>, site string")
    centres = spark.createDataFrame([(k, v) for k, v in zip([9, 3, 7, 5], [[1.0, 1.0, 1.0], [3.0, 1.0, 2.0], [3.0, 1.0, 2.0], [0.0, 4.0, 4.0]])], "k int, c array<double>")
    got, want = (sorted(tuple(r)[0:1] + tuple(r)[2:] for r in f(points, centres).collect()) for f in (clusters.nearest, clusters._nearest_of_any_number))
    assert got == want and clusters.nearest(points, centres).schema["k"].dataType.simpleString() == "int"


@pytest.mark.parametrize("block", [None, 13])
def test_silhouettes_shuffle_no_pairs(spark, block, monkeypatch):
    from cohortflow.operators import neighbours

    monkeypatch.setattr(neighbours, "against_blocks", None)  # rows are not dealt to blocks of others
    monkeypatch.setattr(neighbours, "STRETCH", 16)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, (90, 3)) + 100.0 + 0.1 * (np.arange(90)[:, None] > 60)  # copies, far from 0, not in single precision
    labels = [int(v) for v in np.where(np.arange(90) == 5, 9, np.arange(90) * 5 % 4)]  # one alone
    df = spark.createDataFrame([(i * 10, v, k, 1) for i, (v, k) in enumerate(zip(x.tolist(), labels))], "id long, x array<double>, label int, same long")
    d, k = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.array(labels)
    want = []
    for i in range(90):
        a = d[i][k == k[i]].sum() / max(1, (k == k[i]).sum() - 1)
        b = min(d[i][k == c].mean() for c in set(labels) - {labels[i]})
        want.append(0.0 if (k == k[i]).sum() == 1 else (b - a) / max(a, b))
    got = sorted((r["id"], r["label"], r["s"]) for r in neighbours.silhouettes(df, block=block).collect())
    assert [g[:2] for g in got] == [(10 * i, c) for i, c in enumerate(labels)] and [g[2] for g in got] == pytest.approx(want, abs=1e-10)
    means = neighbours.mean_silhouettes(df, ["label", "same"], **({"block": block} if block else {}))
    assert means["label"] == pytest.approx(sum(want) / 90, abs=1e-10) and means["same"] == 0.0


def test_choice_of_k_shuffles_no_pairs(spark, monkeypatch):
    from cohortflow.operators import models, neighbours

    monkeypatch.setattr(neighbours, "against_blocks", None)
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.standard_normal((40, 4)) * 0.1 + c for c in (0.0, 5.0, 10.0, 15.0)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    [(k, score)] = models.clusters_by_silhouette(df, 160, 4)
    assert k == 4 and score > 0.9
