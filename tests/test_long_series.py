"""Series longer than a block: numbering, moving means, stops and the robust smoother against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import halo, smoothing


def plain_smoother(y, span, rounds=5):
    n = len(y)
    held, r, out = min(2 * (span // 2) + 1, n), np.ones(n), None
    for k in range(rounds + 1):
        out = np.array(y, float)
        for i in range(n):
            low = min(max(0, i - held // 2), n - held)
            near = np.arange(low, low + held)
            sound = np.flatnonzero(r > 0)
            if (r[near] <= 0).any() and len(sound):
                d = np.abs(sound - i)
                near = sound[d <= np.sort(d)[min(held, len(sound)) - 1]]
            x = (near - i).astype(float)
            reach = max(np.abs(x).max(), 1.0)
            fall = (1 - (np.abs(x) / reach) ** 3) ** 3
            w = (np.ones(len(x)) if (fall < 2.0**-52).all() else fall) * r[near]
            if (w > 1e-12).sum() >= 3:
                root = np.sqrt(w)
                basis = np.stack([np.ones(len(x)), x / reach, (x / reach) ** 2], 1)
                out[i] = np.linalg.lstsq(basis * root[:, None], y[near] * root, rcond=None)[0][0]
            elif w.sum() > 0:
                out[i] = (w * y[near]).sum() / w.sum()
        if k < rounds:
            off = np.abs(y - out)
            scale = 6 * max(np.median(off), 1e8 * 2.0**-52 * np.abs(y).max())
            u = off / scale if scale else np.zeros(n)
            r = np.where(u < 1, (1 - u * u) ** 2, 0.0)
    return out


def wave(n, seed=3):
    rng = np.random.default_rng(seed)
    y = np.sin(np.arange(n) / 9) * 5 + rng.normal(0, 0.3, n)
    y[n // 3 : n // 3 + 25] += 400  # a stretch of outliers longer than the span and than a block
    y[::37] -= 60
    return y


def test_smoother_in_blocks_equals_a_plain_one(spark):
    series = {1: wave(240), 2: wave(90, 5), 3: np.array([1.0, 7.0]), None: wave(61, 7)}
    rows = [(s, i, float(v)) for s, y in series.items() for i, v in enumerate(y)] + [(1, 5000, None), (2, -1, float("nan"))]
    df = spark.createDataFrame(rows, "s long, i long, y double").repartition(5)
    got = {(r["s"], r["i"]): r["smooth"] for r in smoothing.smooth(df, "s", "i", "y", 11, block=16).collect()}
    assert len(got) == len(rows) and got[1, 5000] is None and got[2, -1] is None
    for s, y in series.items():
        assert [got[s, i] for i in range(len(y))] == pytest.approx(list(plain_smoother(y, 11)), abs=1e-6)
    assert smoothing.smooth(df.where("s = 9"), "s", "i", "y", 11).count() == 0


def test_long_series_is_cut(spark):
    n = 60_000  # more than SHORT, so that medians come from selection
    y = wave(n)
    df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("i")).join(spark.createDataFrame(list(enumerate(map(float, y))), "i long, y double"), "i")
    got = np.array([r["smooth"] for r in smoothing.smooth(df, "s", "i", "y", 15, rounds=2).orderBy("i").collect()])
    i, r = np.arange(1, n + 1), np.ones(n)
    for k in range(3):
        want = smoothing.fitted(i, y, r, np.ones(n, bool), n, 15)
        u = np.abs(y - want) / (6 * max(np.median(np.abs(y - want)), 1e8 * 2.0**-52 * np.abs(y).max()))
        r = np.where(u < 1, (1 - u * u) ** 2, 0.0)
    assert np.abs(got - want).max() < 1e-6
    blocks = [r["count"] for r in halo.spread(halo.numbered(df, "s", "i"), 15, 15).groupBy("_series", "_block").count().collect()]
    assert len(blocks) == 8 and max(blocks) == halo.BLOCK + 30


def test_nearest_places_keep_ties():
    near, used = smoothing.nearest_places(np.array([1, 3, 5, 20]), np.array([3, 4, 30]), 2)
    assert [sorted(set(n[u])) for n, u in zip(near, used)] == [[0, 1, 2], [1, 2], [2, 3]]
    near, used = smoothing.nearest_places(np.array([4]), np.array([9]), 5)
    assert used.sum() == 1


def test_moving_means_and_stops(spark):
    rng = np.random.default_rng(1)
    series = {1: rng.normal(5, 1, 300), 2: rng.normal(0, 1, 23) + np.arange(23) ** 2, 3: np.zeros(40), None: np.full(8, 2.0)}
    rows = [(s, 0 if s == 3 else i, float(v)) for s, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "s long, i long, y double").repartition(3)
    numbered = halo.numbered(df, "s", "i", ["y"])
    series[3] = np.sort(series[3])
    both = halo.running_sum(halo.moving_mean(numbered, "y", 20, block=7), "y", block=7).collect()
    assert {(r["s"], r["_i"]): r["moving"] for r in both} == {(s, i + 1): pytest.approx(np.mean(y[max(0, i - 19) : i + 1])) for s, y in series.items() for i in range(len(y))}
    assert {(r["s"], r["_i"]): r["total"] for r in both} == {(s, i + 1): pytest.approx(t) for s, y in series.items() for i, t in enumerate(np.cumsum(y))}
    stops = {r["s"]: (r["stopped"], r["change"]) for r in halo.settled(numbered, "y", 20, 5, 0.05, ["s"], block=7).collect()}
    for s, y in series.items():
        looks = [(i, np.mean(y[max(0, i - 20) : i])) for i in range(5, len(y) + 1, 5)]
        want = next(((i, abs((b - a) / a)) for (_, a), (i, b) in zip(looks, looks[1:]) if a and abs((b - a) / a) < 0.05), (None, None))
        assert stops[s] == (want[0], want[1] if want[0] is None else pytest.approx(want[1]))
    assert halo.settled(halo.numbered(df.where("s = 9"), "s", "i"), "y", 20, 5, 0.05, ["s"]).count() == 0


def test_masked_neighbours(spark):
    rng = np.random.default_rng(2)
    marks = {1: rng.random(200) < 0.3, 2: np.zeros(9, bool), 3: np.ones(4, bool)}
    marks[1][40:120] = False  # longer than blocks
    df = spark.createDataFrame([(s, i, float(m)) for s, ms in marks.items() for i, m in enumerate(ms)], "s long, i long, r double").repartition(3)
    numbered = halo.numbered(df, "s", "i").withColumn("_r", F.col("r"))
    names = {r["_series"]: r["s"] for r in numbered.select("_series", "s").distinct().collect()}
    got = {(names[r["_series"]], r["_i"], r["near"]) for r in smoothing.masked_neighbours(numbered, 6, block=16).collect()}
    want = set()
    for s, ms in marks.items():
        sound = np.flatnonzero(ms)
        for i in range(len(ms)) if len(sound) else []:
            d = np.abs(sound - i)
            want |= {(s, i + 1, int(j) + 1) for j in sound[d <= np.sort(d)[min(6, len(d)) - 1]]}
    assert got == want
