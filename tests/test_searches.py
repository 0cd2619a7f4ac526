"""Neighbours, alignment, solvers, smoothing and models against brute force and published values."""

import itertools

import numpy as np
import pytest

from cohortflow import catalogue
from cohortflow.operators import alignment, models, neighbours, smoothing, solvers

SF = "/root/testdata/sf0.001"


def process(spark, moves, rewards):
    """Rows of a process from moves[a][s][s2] and rewards[s][a]."""
    p = [(s, a, t, float(x)) for a, m in enumerate(moves) for s, r in enumerate(m) for t, x in enumerate(r) if x]
    r = [(s, a, float(x)) for s, row in enumerate(rewards) for a, x in enumerate(row)]
    return spark.createDataFrame(p, "s long, a long, s2 long, p double").coalesce(1), spark.createDataFrame(r, "s long, a long, r double").coalesce(1)


# Two published processes.
FOREST = [[[0.1, 0.9, 0], [0.1, 0, 0.9], [0.1, 0, 0.9]], [[1, 0, 0]] * 3], [[0, 0], [0, 1], [4, 2]]
SMALL = [[[0.5, 0.5], [0.8, 0.2]], [[0, 1], [0.1, 0.9]]], [[5, 10], [-1, 2]]


def values(found):
    rows = sorted(found.collect())
    return [r["best"] for r in rows], [r["v"] for r in rows]


def test_value_sweeps(spark):
    found, n = solvers.solve_by_values(*process(spark, *FOREST), 0.96)
    assert n == 4 and values(found)[0] == [0, 0, 0] and values(found)[1] == pytest.approx([5.93215488, 9.38815488, 13.38815488])


def test_published_solutions(spark):
    """Published solutions of the two small processes."""

    def of(process, *options, **more):
        rows = sorted({(r["s"], r["best"], r["v"], r["rounds"], r["gain"]) for r in solvers.solved(*process, *options, **more).collect()})
        return [r[1] for r in rows], [r[2] for r in rows], rows[0][3], rows[0][4]

    forest, small = process(spark, *FOREST), process(spark, *SMALL)
    assert of(forest, "values", 0.96)[::2] == ([0, 0, 0], 4) and of(forest, "values", 0.96)[1] == pytest.approx([5.93215488, 9.38815488, 13.38815488])
    assert of(small, "values", 0.9)[::2] == ([1, 0], 26) and of(small, "values", 0.9)[1] == pytest.approx([40.04862539, 33.65371176])
    assert of(forest, "policies", 0.9)[1] == pytest.approx([26.244, 29.484, 33.484])
    assert of(small, "policies", 0.9)[1] == pytest.approx([42.44186047, 36.04651163]) and of(small, "policies", 0.9)[0] == [1, 0]
    assert of(forest, "partial", 0.9)[1] == pytest.approx([21.81408652, 25.05408652, 29.05408652])
    assert of(forest, "relative")[0::2] == ([0, 0, 0], 4) and of(forest, "relative")[3] == pytest.approx(3.24)
    assert of(small, "relative")[0::2] == ([1, 0], 29) and of(small, "relative")[3] == pytest.approx(3.885235246411831)
    wide = spark.range(2000).selectExpr("id as s", "0L as a", "id as s2", "1.0D as p")  # more states than one task once held
    assert solvers.solved(wide, wide.selectExpr("s", "a", "p as r"), "policies", 0.9).where("abs(v - 10) < 1e-6").count() == 2000


def test_policy_rounds(spark):
    """The loop of joins, to a coarse tolerance; exact solutions are in test_published_solutions."""
    best, v = values(solvers.solve_by_policies(*process(spark, *SMALL), 0.9, tolerance=0.05)[0])
    assert best == [1, 0] and v == pytest.approx([42.44186047, 36.04651163], abs=0.6)


def test_partial_policies(spark):
    assert values(solvers.solve_by_partial_policies(*process(spark, *FOREST), 0.9)[0])[1] == pytest.approx([21.81408652, 25.05408652, 29.05408652])


def test_relative_values(spark):
    found, gain, n = solvers.relative_values(*process(spark, *FOREST))
    assert n == 4 and gain == pytest.approx(3.24) and values(found)[0] == [0, 0, 0]
    found, gain, n = solvers.relative_values(*process(spark, *SMALL))
    assert n == 29 and gain == pytest.approx(3.885235246411831) and values(found)[0] == [1, 0]


def test_pairs_are_the_cheapest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        for cost in (rng.random((n, n)), rng.integers(0, 3, (n, n)).astype(float)):
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sum(cost[np.arange(n), alignment.cheapest_pairs(cost)]) == pytest.approx(best)


def test_alignment_finds_permuted_centres(spark):
    c = [[0.0, 0.0], [5.0, 1.0], [2.0, 9.0]]
    rows = [(1, k, 1, c[k]) for k in range(3)] + [(2, (k + 1) % 3, 3, [v + 1.0 for v in c[k]]) for k in range(3)] + [(3, 7, 0, [100.0, 100.0])]
    sites = spark.createDataFrame(rows, "site long, k long, n long, c array<double>")
    found = {r["k"]: list(r["c"]) for r in alignment.aligned_mean(sites).collect()}
    assert {k: pytest.approx([v + 0.75 for v in c[k]]) for k in range(3)} == found


def test_ward_equals_one_merge_at_a_time(spark):
    rng = np.random.default_rng(3)
    x = [[float(v) for v in r] for r in rng.normal(size=(14, 3))] + [[0.5, 0.5, 0.5]] * 3
    groups = [[i] for i in range(len(x))]
    mean = lambda g: np.mean([x[i] for i in g], axis=0)
    while len(groups) > 5:
        _, i, j = min((len(a) * len(b) / (len(a) + len(b)) * ((mean(a) - mean(b)) ** 2).sum(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        groups[i] += groups.pop(j)
    points = spark.createDataFrame(list(enumerate(x)), "id long, c array<double>").coalesce(1)
    got = {}
    for r in alignment.ward_labels(points, 5).collect():
        got.setdefault(r["label"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)) and all(k == min(v) for k, v in got.items())
    assert {r["label"] for r in alignment.ward_labels(points.where("id < 2"), 5).collect()} == {0, 1}


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = [(i, [float(v) for v in rng.integers(0, 4, 3)], int(i % 3)) for i in range(60)]
    points = spark.createDataFrame([*x, (None, [1.0, 1.0, 1.0], 0), (99, None, 0)], "id long, x array<double>, label long")
    d = lambda a, b: float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    want = {(i, r, j) for i, a, _ in x for r, (_, j) in enumerate(sorted((d(a, b), j) for j, b, _ in x if j != i)[:4], 1)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in neighbours.nearest_points(points, points, 4, True, block=16).collect()} == want
    assert neighbours.nearest_points(points.where("id < 0"), points, 4).count() == 0
    got = {r["id"]: r["s"] for r in neighbours.silhouettes(points, block=16).collect()}
    for i, a, la in x:
        mean = {m: [d(a, b) for j, b, lb in x if lb == m and j != i] for m in range(3)}
        near, other = np.mean(mean[la]), min(np.mean(mean[m]) for m in range(3) if m != la)
        assert got[i] == pytest.approx((other - near) / max(near, other))


def test_gaps_from_columns(spark):
    rows = [(1, 1.0, 1.1, 9.0), (2, 2.0, 2.1, 1.0), (3, None, 3.0, 7.0), (4, None, None, 5.0), (5, None, None, None)]
    got = {r["id"]: r["a"] for r in neighbours.impute_from_columns(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: pytest.approx(3.0), 4: pytest.approx(5.0), 5: None}


def test_smoothing_keeps_a_quadratic_and_resists_an_outlier(spark):
    y = [0.5 * i * i - 3 * i + 1 for i in range(40)]
    rows = [(0, i, v) for i, v in enumerate(y)] + [(1, i, v + (500.0 if i == 20 else 0.0)) for i, v in enumerate(y)] + [(2, 0, None), (2, 1, 4.0)]
    got = {(r["s"], r["i"]): r["smooth"] for r in smoothing.smooth(spark.createDataFrame(rows, "s long, i long, y double"), "s", "i", "y", 11).collect()}
    assert all(got[s, i] == pytest.approx(v, abs=1e-6) for s in (0, 1) for i, v in enumerate(y))
    assert got[2, 0] is None and got[2, 1] == pytest.approx(4.0)


def test_choice_of_k():
    assert models.elbow([2, 3, 4, 5], [100.0, 50.0, 45.0, 44.0]) == 3
    assert models.elbow([2, 3], [100.0, 50.0]) == 2 and models.few_clusters(800, 5) == 15 and models.heuristic_clusters(10_000, 40) == 12


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
