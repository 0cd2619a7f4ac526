"""Each registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cohortflow import catalogue
from cohortflow.operators import cohorts
from cohortflow.operators.trajectories import value_iteration

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    of = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 4) if not isinstance(v, str) else v
    return sorted((tuple(of(v) for v in r) for r in rows), key=lambda r: tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = plain(df.select(columns).collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    assert sorted(c[0] for c in found.description) == columns
    theirs = plain(duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 for x, y in zip(a, b)), (a, b)


def test_bootstrap_is_repeatable(spark):
    q = catalogue.queries()["wis_boot"]
    assert sorted(q(spark, SF).collect()) == sorted(q(spark, SF).collect())


def test_apportionment_goldens():
    strata = {"1": 6750, "2": 13332, "3": 838}
    assert {k: cohorts.apportion(n, [5.5, 3.5, 1]) for k, n in strata.items()} == {"1": [3713, 2362, 675], "2": [7333, 4666, 1333], "3": [461, 293, 84]}
    room = [8368, 6276, 6276]
    for severity, weights, want in (("3", [6, 3, 1], [503, 251, 84]), ("1", [1, 3, 6], [675, 2025, 4050]), ("2", [4, 3, 3], [7190, 4000, 2142])):
        got = cohorts.allocate_within(strata[severity], weights, room)
        assert got == want
        room = [r - g for r, g in zip(room, got)]


def test_value_iteration_of_the_forest(spark):
    probs = spark.createDataFrame([(s, a, t, p) for s in range(3) for a, moves in ((0, {0: 0.1, min(s + 1, 2): 0.9}), (1, {0: 1.0})) for t, p in moves.items()], "s long, a long, s2 long, p double")
    rewards = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (2, 0, 4.0), (0, 1, 0.0), (1, 1, 1.0), (2, 1, 2.0)], "s long, a long, r double")
    found = {r["s"]: (r["best"], round(r["v"], 4)) for r in value_iteration(probs, rewards, 0.9, 3).collect()}
    assert found == {0: (0, 2.6973), 1: (0, 5.9373), 2: (0, 9.9373)}
