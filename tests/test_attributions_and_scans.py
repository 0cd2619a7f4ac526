"""Shapley values, wide correlations, the restartable loop, and scans of databases and untyped files."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import attributions, federated, gram, models
from cohortflow.sources import tables


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((200, 5)), 1)  # values meet thresholds
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label double").cache()
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=3, maxDepth=3, seed=1).fit(models._vectors(df))
    return x, df, model


def expected(node, x, kept):
    """The value of a tree where only the features in ``kept`` are known, by walking its nodes."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in kept:
        return expected(left if x[split.featureIndex()] <= split.threshold() else right, x, kept)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * expected(left, x, kept) + m * expected(right, x, kept)) / (n + m)


def test_attributions_are_shapley_sums_and_add_up(spark, boosted):
    x, df, model = boosted
    found = {r["id"]: r for r in attributions.attributions(df, model).collect()}
    raw = {r["id"]: r["rawPrediction"][1] for r in model.transform(models._vectors(df)).select("id", "rawPrediction").collect()}
    assert all(found[i]["base"] + sum(found[i]["parts"]) == pytest.approx(raw[i], abs=1e-9) for i in raw)
    roots = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights)]
    for i in (0, 7, 42):
        value = {s: sum(w * expected(root, x[i], set(s)) for root, w in roots) for k in range(6) for s in combinations(range(5), k)}
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = sum(factorial(k) * factorial(4 - k) / factorial(5) * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(5) for s in combinations(others, k))
            assert found[i]["parts"][f] == pytest.approx(want, abs=1e-9)


def test_attributions_of_missing_vectors_and_their_means(spark, boosted):
    x, df, model = boosted
    values = attributions.attributions(df.unionByName(spark.createDataFrame([(900, None, 0.0)], df.schema)), model).cache()
    assert values.where("parts is null").select("id").collect() == [(900,)]
    means = {r["dim"]: r["importance"] for r in attributions.mean_attributions(values, 5).collect()}
    parts = np.abs([r["parts"] for r in values.where("parts is not null").collect()]).mean(0)
    assert [means[i] for i in range(5)] == pytest.approx(parts.tolist()) and max(means, key=means.get) == 0


def test_correlations_of_five_hundred_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 500)) + 1e6
    x[:, 7] = 3.0
    x[:, 9] = x[:, 8] * 2 + 1
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(*[F.col("v")[i].alias(f"c{i}") for i in range(500)])
    r = {(a, b): v for a, b, v in gram.correlations(df, [f"c{i}" for i in range(500)]).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    assert len(r) == 500 * 499 // 2 and r["c8", "c9"] == pytest.approx(1.0) and r["c7", "c100"] is None
    assert all(abs(r[f"c{i}", f"c{j}"] - want[i, j]) < 1e-6 for i in range(0, 500, 17) for j in range(i + 1, 500, 13) if i != 7 and j != 7)


def test_correlations_leave_gaps_out(spark):
    rows = [(1.0, 2.0, None), (2.0, float("nan"), 1.0), (3.0, 6.5, 2.0), (4.0, 7.0, 2.5), (None, 1.0, 9.0)]
    r = {(a, b): v for a, b, v in gram.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 6.5, 7])[0, 1]) and r["a", "c"] == pytest.approx(np.corrcoef([2, 3, 4], [1, 2, 2.5])[0, 1])
    assert gram.correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]).count() == 0


@pytest.fixture(scope="module")
def spots(spark):
    rng = np.random.default_rng(6)
    x = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])[rng.integers(0, 3, 300)] + rng.standard_normal((300, 2))
    points = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, site long, x array<double>").cache()
    return points, spark.createDataFrame([(0, [0.1, 0.0]), (1, [0.3, 0.1]), (2, [0.2, 0.4])], "k long, c array<double>")


def test_a_stopped_loop_goes_on_from_its_last_round(spots, tmp_path):
    points, centres = spots
    whole = federated.matched_loop(points, centres, f"file://{tmp_path}/whole", 20, 1e-9).orderBy("round", "k").collect()
    federated.matched_loop(points, centres, f"file://{tmp_path}/parts", 2, 1e-9)
    assert federated.stored_rounds(points.sparkSession, f"file://{tmp_path}/parts") == [1, 2]
    (tmp_path / "parts" / "round-3").mkdir()  # a round that was not stored whole does not count
    again = federated.matched_loop(points, centres, f"file://{tmp_path}/parts", 20, 1e-9).orderBy("round", "k").collect()
    assert [(r["round"], r["k"]) for r in again] == [(r["round"], r["k"]) for r in whole] and len(whole) >= 9
    assert all(a["norm"] == pytest.approx(b["norm"], abs=1e-9) and a["c"] == pytest.approx(b["c"]) for a, b in zip(again, whole))
    assert whole[-1]["norm"] < 1e-9
    settled = federated.matched_loop(points, centres, f"file://{tmp_path}/whole", 99, 1e-9)
    assert settled.count() == len(whole)  # nothing is left to do


def test_centres_that_change_places_have_not_moved(spots, tmp_path):
    points, centres = spots
    turn = lambda _, now: np.roll(now, 1, axis=0)  # noqa: E731  # the same centres under other numbers
    rows = federated.matched_loop(points, centres, f"file://{tmp_path}/turned", 5, 1e-6, step=turn).collect()
    assert {r["round"] for r in rows} == {1} and all(r["norm"] == 0 for r in rows)


def test_a_database_is_read_by_ranges_with_pushed_filters(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i, f"n{i}", i * 0.5) for i in range(1, 101)]
    tables.to_database(spark.createDataFrame(rows, "id long, name string, v double"), url, "admissions", driver=driver)
    df = tables.database_table(spark, url, "admissions", "id", 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == rows
    few = df.where("id > 90 and v < 48").select("id")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(ID,90)" in plan.replace("id", "ID") and "ReadSchema: struct<id" in plan.replace("ID", "id") and "name" not in plan.lower().split("readschema")[1]
    assert sorted(r[0] for r in few.collect()) == [91, 92, 93, 94, 95]
    assert tables.database_table(spark, url, "admissions", driver=driver).count() == 100


def test_types_of_a_file_follow_from_all_its_rows(spark, tmp_path):
    lines = ["a,b,c,d,e", *[f"{i},{i}.5,{i},x{i}," for i in range(500)], "3000000000,7,oops,,"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = tables.inferred_csv(spark, f"file://{tmp_path}/t.csv")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string"), ("e", "string")]
    assert df.count() == 501 and df.where("a = 3000000000").first()["c"] == "oops"
