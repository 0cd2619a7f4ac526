"""Splits, federated loops, process checks, searches, sources and sinks against plain Python."""

import hashlib
import math
from datetime import datetime

import numpy as np
import pytest

from cohortflow.functions import ranks
from cohortflow.operators import alignment, comorbidity, federated, neighbours, normalise, processes, search, solvers, splits
from cohortflow.sources import tables


def test_comorbidity_goldens(spark):
    """Published edge codes and what they mean."""
    rows = [(1, 2, "40301"), (2, 2, "40403"), (3, 2, "428"), (4, 2, None), (5, 1, "428"), (6, None, "428"), (7, 2, "4280"), (7, 3, "25040"), (7, 4, "25000"), (8, 2, "173"), (9, 2, "195")]
    dx = spark.createDataFrame(rows, "hadm_id long, seq_num int, icd9_code string")
    flags = {r["hadm_id"]: {k for k, v in r.asDict().items() if k != "hadm_id" and v} for r in comorbidity.secondary_flags(dx).collect()}
    assert flags == {1: {"htncx", "renlfail"}, 2: {"chf", "renlfail", "htncx"}, 3: {"chf"}, 4: set(), 7: {"chf", "dm", "dmcx"}, 8: set(), 9: {"tumor"}}
    admissions = spark.createDataFrame([(i,) for i in range(1, 11)], "hadm_id long")
    view = {r["hadm_id"]: r for r in comorbidity.comorbidity_view(admissions, dx).collect()}
    assert view[7]["diabetes_complicated"] == 1 and view[7]["diabetes_uncomplicated"] == 0 and view[1]["hypertension"] == 1
    for i in (5, 6, 10):  # no secondary code
        assert view[i]["congestive_heart_failure"] is None and view[i]["hypertension"] == view[i]["solid_tumor"] == view[i]["diabetes_uncomplicated"] == 0


def test_quantiles_and_ranks_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE", 7)
    rng = np.random.default_rng(2)
    values = np.concatenate((rng.integers(0, 40, 300).astype(float), rng.normal(20, 9, 200)))
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None), (2, 5.0)], "g long, v double")
    found = {r["g"]: r for r in ranks.quantiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.99}, ["g"]).collect()}
    for g in (0, 1):
        assert [found[g][c] for c in "abc"] == pytest.approx(np.percentile(values[g::2], [1, 50, 99]).tolist())
    assert found[2]["b"] == 5.0
    counts = df.where("v is not null").groupBy("v").count()
    before = {r["v"]: (r["before"], r["total"]) for r in ranks.running(counts, "v", "count").collect()}
    whole = np.append(values, 5.0)
    assert before == {v: (int((whole < v).sum()), len(whole)) for v in set(whole.tolist())}
    hazen = ranks.quantiles(df, "v", {"q": 0.05}, ["g"], ranks.hazen).where("g = 0").first()["q"]
    s, n = np.sort(values[0::2]), 250
    k = int(n * 0.05 + 0.5)
    assert hazen == pytest.approx(s[k - 1] + (n * 0.05 + 0.5 - k) * (s[k] - s[k - 1]))


def test_folds_are_drawn_by_digest(spark):
    rows = spark.range(200).withColumn("f", splits.fold("id", 3)).collect()
    assert all(r["f"] == int(int(hashlib.md5(f"{r['id']}|3".encode()).hexdigest()[:8], 16) / 2**32 * 5) + 1 for r in rows)
    assert {r["f"] for r in rows} == {1, 2, 3, 4, 5}


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4)) + 3 * rng.integers(0, 3, 90)[:, None]
    site = np.arange(90) % 3 + 1
    points = spark.createDataFrame([(i, int(s), [float(v) for v in p]) for i, (s, p) in enumerate(zip(site, x))], "id long, site long, x array<double>")
    centres = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(3)], "k long, c array<double>")
    return points, centres, x, site


def plain_step(x, c):
    label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    return np.stack([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))]), label


def centres_of(found):
    return np.array([r["c"] for r in sorted(found.collect(), key=lambda r: r["k"])])


def test_federated_rounds_stop_when_still(sites):
    points, centres, x, site = sites
    found, changes = federated.federated_lloyd(points, centres)
    c, gaps = x[:3], []
    for _ in range(20):
        new = np.mean([plain_step(x[site == s], c)[0] for s in (1, 2, 3)], axis=0)
        gaps.append(np.abs(new - c).mean())
        c = new
        if gaps[-1] < 1e-4:
            break
    assert np.allclose(centres_of(found), c) and changes == pytest.approx(gaps)


def test_warm_start_and_uploads(spark, sites):
    points, centres, x, site = sites
    found, changes = federated.warm_lloyd(points, centres)
    c = x[:3]
    for _ in changes:
        c, _ = plain_step(x, c)
    assert np.allclose(centres_of(found), c) and changes[-1] < 1e-4
    starts = centres.crossJoin(points.select("site").distinct())
    uploads = federated.site_lloyd(points, starts).checkpoint()
    summary = {r["site"]: (r["n_samples"], r["n_features"], r["n_clusters"]) for r in federated.upload_summary(uploads).collect()}
    assert summary == {s: (30, 4, 3) for s in (1, 2, 3)}
    for s in (1, 2, 3):
        own, before = x[site == s], x[:3]
        for _ in range(300):
            after, label = plain_step(own, before)
            if np.abs(after - before).mean() < 1e-4:
                break
            before = after
        rows = sorted(uploads.where(f"site = {s}").collect(), key=lambda r: r["k"])
        assert np.allclose([r["c"] for r in rows], after) and sum(r["inertia"] for r in rows) == pytest.approx(((own[:, None] - after[None]) ** 2).sum(2).min(1).sum())
    weighted = centres_of(federated.size_weighted(uploads))
    got = uploads.collect()
    for k in range(3):
        mine = [(r["n"], np.array(r["c"])) for r in got if r["k"] == k]
        assert np.allclose(weighted[k], sum(n * c for n, c in mine) / sum(n for n, _ in mine))
    ratios = {(r["method"], r["site"]): r["ratio"] for r in federated.method_ratios(points, {"start": centres, "sizes": federated.size_weighted(uploads)}, uploads).collect()}
    assert len(ratios) == 8 and all(v >= 1 - 1e-9 for (m, s), v in ratios.items() if m == "sizes")
    assert federated.best_method(spark.createDataFrame([("b", "1", 2.0), ("a", "1", 3.0), ("a", "Total", 1.0), ("b", "Total", 2.0)], "method string, site string, ratio double")).first()["method"] == "a"


def test_unequal_centres_groups_and_swarm(spark):
    base = np.array([[0.0, 0], [10, 0], [0, 10]])
    rows = [(1, k, 5, base[k].tolist()) for k in range(3)] + [(2, k, 5, (base[[2, 0]][k] + 1).tolist()) for k in range(2)] + [(3, 0, 5, [50.0, 50.0])]
    uploads = spark.createDataFrame(rows, "site long, k long, n long, c array<double>")
    weights = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1e-12)], "site long, weight double")
    found = {r["k"]: r["c"] for r in federated.unequal_mean(uploads, weights, 3).collect()}
    assert found[0] == pytest.approx([0.25, 0.25]) and found[2] == pytest.approx([0.25, 10.25]) and found[1] == pytest.approx([10, 0], abs=1e-6)
    groups = {r["site"]: r["label"] for r in federated.site_groups(uploads, 2).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        federated.unequal_mean(uploads, weights, 9)
    equal = uploads.where("k < 1")
    best, curve = federated.swarm(equal, weights)
    assert all(a >= b for a, b in zip(curve, curve[1:]))
    assert best.first()["c"] == pytest.approx((np.array([3 * base[0], base[2] + 1]).sum(0) / 4).tolist(), abs=1e-2)


def test_process_checks_and_examples(spark):
    probs, rewards = processes.forest(spark)
    processes.check(probs, rewards, 0.9)
    found = {r["s"]: r["v"] for r in solvers.solved(probs, rewards, "policies", 0.9).collect()}
    assert [found[s] for s in range(3)] == pytest.approx([26.244, 29.484, 33.484])
    probs, rewards = processes.small(spark)
    processes.check(probs, rewards, 0.9)
    bad = probs.selectExpr("s", "a", "s2", "case when s = 0 and a = 1 then 0.9D else p end as p")
    with pytest.raises(processes.NotStochastic):
        processes.check(bad, rewards, 0.9)
    with pytest.raises(processes.NegativeProbability):
        processes.check(probs.selectExpr("s", "a", "s2", "-p as p"), rewards, 0.9)
    with pytest.raises(processes.NotSquare):
        processes.check(probs.where("s = 0"), rewards, 0.9)
    for gamma in (0, 1.5):
        with pytest.raises(processes.InvalidProcess):
            processes.check(probs, rewards, gamma)
    with pytest.raises(processes.InvalidProcess):
        processes.check(probs, rewards.where("a = 0"), 0.9)
    probs, rewards = processes.random_process(spark, 12, 3, 0.5, 4)
    processes.check(probs, rewards, 0.9)
    assert rewards.count() == 36 and probs.count() < 12 * 12 * 3
    by_state = processes.rewards_of(probs, spark.range(12).selectExpr("id as s", "cast(id as double) as r"))
    by_step = processes.rewards_of(probs, probs.selectExpr("s", "a", "s2", "cast(s as double) as r"))
    assert sorted(by_state.collect()) == [pytest.approx(r) for r in sorted(by_step.collect())]
    assert processes.span(spark.createDataFrame([(1.0,), (4.5,)], "v double")) == 3.5


def test_foraging_improves_and_asks_once(spark):
    asked = []

    def fitness(masks):
        asked.extend(map(tuple, masks))
        return [len(set(m) ^ {1, 3, 5}) / 10 for m in masks]

    chosen, curve = search.foraging(fitness, 8, 8, 2, 12, 3)
    assert len(set(asked)) == len(asked) and all(a >= b for a, b in zip(curve, curve[1:])) and curve[-1] <= 0.2 and curve[-1] == pytest.approx(fitness([chosen.tolist()])[0])
    assert search.penalised_threshold(0.0, 0.2, 0.8, 0.0) == 0.2 and search.penalised_threshold(1.0, 0.0, 1.0, 0.0) == pytest.approx(2 * math.atan(1) / math.pi)
    assert (search.penalised_threshold(0.5, 0, 1, 0.8), search.penalised_threshold(0.5, 0, 1, 0.4)) == (0.7, 0.3)


def test_silhouettes_of_all_points(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(k)) for i, (p, k) in enumerate(zip(x, label))], "id long, x array<double>, label long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(40):
        mine = label == label[i]
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, label == k].mean() for k in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    assert [r["s"] for r in sorted(neighbours.silhouettes(df, block=7).collect())] == pytest.approx(want)


def test_moments_are_used_again(spark):
    train = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "a double, b double")
    _, stats = normalise.normalised(train, [], ["a"], ["b"])
    out, _ = normalise.normalised(spark.createDataFrame([(5.0, 1.0)], "a double, b double"), [], ["a"], ["b"], stats=stats)
    logs = np.log([1.1, 3.1])
    assert out.first()["a"] == pytest.approx(4 / math.sqrt(2)) and out.first()["b"] == pytest.approx((logs[0] - logs.mean()) / logs.std(ddof=1))
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert normalise.chosen_columns(df, ["b", "z", "a"]) == (["b", "a"], ["z"]) and normalise.numeric_columns(df, ["a"]) == ["b"]


def test_sources_and_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "é", 0.5), (2, None, None)], "id long, name string, v double")
    tables.write_tables({"one": df, "two": df.limit(1)}, f"{at}/sheets")
    again = tables.read_tables(spark, f"{at}/sheets", ["one", "two"])
    assert sorted(again["one"].collect()) == sorted(df.collect()) and again["two"].count() == 1
    assert tables.exists(spark, f"{at}/sheets/one") and tables.read_if_there(spark, f"{at}/none") is None and tables.read_if_there(spark, f"{at}/sheets/one").count() == 2
    tables.write_tables({"csv": df}, at, "csv")
    assert sorted(tables.csv(spark, f"{at}/csv", df.schema).collect()) == sorted(df.collect())
    tables.write_csv(df, f"{at}/by_id", "id")
    assert spark.read.option("header", True).csv(f"{at}/by_id").count() == 2
    tables.write_csv_for_spreadsheets(df.coalesce(1), f"{at}/bom")
    assert next((tmp_path / "bom").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid,name,v")
    tables.write_json(df, f"{at}/json")
    assert spark.read.json(f"{at}/json").count() == 2
    tables.write_lines(df.select("name").na.drop(), f"{at}/lines")
    assert [r["name"] for r in tables.text_list(spark, f"{at}/lines").collect()] == ["é"]
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert tables.json(spark, f"{at}/one.json").first()["a"] == 1
    both = tables.sites(spark, {"s1": f"{at}/sheets/one", "s2": f"{at}/sheets/two"})
    assert sorted(r["site_id"] for r in both.collect()) == ["s1", "s1", "s2"]
    with pytest.raises(ValueError):
        tables.sites(spark, {})
    tables.replace_view(df, "flow_view")
    tables.replace_view(df.limit(1), "flow_view")
    assert spark.table("flow_view").count() == 1
    assert tables.run_folder("/x/", "run", datetime(2020, 1, 2, 3, 4, 5)) == "/x/run_20200102_030405"


def test_aligned_sites_keep_their_places(spark):
    rows = [(1, 0, 1, [0.0]), (1, 1, 1, [9.0]), (2, 0, 3, [8.0]), (2, 1, 1, [1.0])]
    found = {r["k"]: r["c"][0] for r in alignment.aligned_mean(spark.createDataFrame(rows, "site long, k long, n long, c array<double>")).collect()}
    assert found == {0: 0.5, 1: pytest.approx(8.25)}
