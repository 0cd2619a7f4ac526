"""Federated clustering over sites: upload records, loops to convergence, aggregates of unequal numbers of centres, comparison of methods.

Points are (id, site, x); centres (k, c) are few. Each round of a loop is one Spark job over the points; centres are cut from their lineage by checkpoint().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, clusters, many_means


def _moved(new: DataFrame, old: DataFrame) -> float:
    """The mean absolute change of a coordinate."""
    both = new.join(old.select("k", F.col("c").alias("o")), "k")
    gap = F.aggregate(F.zip_with("c", "o", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d)
    return both.agg(F.sum(gap) / F.sum(F.size("c"))).first()[0] or 0.0


def until_still(step, centres: DataFrame, rounds: int, threshold: float) -> tuple[DataFrame, list[float]]:
    """Centres after steps until the mean absolute change is under threshold, ``rounds`` at most, and the change of each round."""
    centres, changes = centres.select("k", "c").checkpoint(), []
    for _ in range(rounds):
        new = step(centres).select("k", "c").checkpoint()
        changes.append(_moved(new, centres))
        centres = new
        if changes[-1] < threshold:
            break
    return centres, changes


def federated_lloyd(points: DataFrame, centres: DataFrame, rounds: int = 20, threshold: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """Every round each site takes a step from the shared centres, and the plain mean over sites is shared."""
    return until_still(lambda c: clusters.federated_lloyd(points, c), centres, rounds, threshold)


def warm_lloyd(points: DataFrame, centres: DataFrame, rounds: int = 300, threshold: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """k-means from given centres, one start."""
    return until_still(lambda c: clusters.lloyd(points, c), centres, rounds, threshold)


def stored_rounds(spark: SparkSession, path: str) -> list[int]:
    """The rounds of a loop that are stored whole below path, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [f.getPath() for f in store.listStatus(at) if f.getPath().getName().startswith("round-")]
    return sorted(int(n.getName().rpartition("-")[2]) for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def _matched(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The new centres in the order of the old ones that they are matched with, one to one at the least total distance."""
    to = alignment.cheapest_pairs(np.sqrt(((new[:, None, :] - old[None, :, :]) ** 2).sum(axis=2)))
    out = np.empty_like(new)
    out[to] = new
    return out


def matched_loop(points: DataFrame, centres: DataFrame, path: str, rounds: int = 30, threshold: float = 1e-4, step=None) -> DataFrame:
    """round, norm, k, c of every round: all sites step from the shared centres (k, c) and their sums are shared, until the matched centres move by under ``threshold``.

    New centres are matched one to one with those before, so that a new numbering is no movement; the norm is Frobenius' norm of the matched differences. The shared
    centre is the mean over sites weighted by their rows, the minimum of the sites' weighted squares; a centre without rows stays. Every round is
    stored below ``path``, whole or not at all, and a loop that finds rounds there goes on from the last, as after a lost driver. Centres are few
    (many_means.MOST_BYTES, else ValueError). step(points, centres) gives other new centres (a matrix), for another way to share.
    """
    spark = points.sparkSession
    first = sorted((r["k"], r["c"]) for r in centres.select("k", "c").collect())
    names, now = [k for k, _ in first], np.array([c for _, c in first], float)
    rows = points.where("x is not null").select(F.lit(0).alias("pool"), "x")

    def shared(_, at: np.ndarray) -> np.ndarray:
        return many_means.fit(rows, {0: (0, at)}, 1, -1.0)[0].centres

    schema, done = "round long, norm double, k long, c array<double>", stored_rounds(spark, path)
    if done:
        last = spark.read.schema(schema).parquet(f"{path}/round-{done[-1]}").orderBy("k").collect()
        now, norm = np.array([r["c"] for r in last], float), last[0]["norm"]
        if norm < threshold:
            rounds = 0
    for n in range(done[-1] + 1 if done else 1, rounds + 1):
        new = _matched((step or shared)(points, now), now)
        norm, now = float(np.sqrt(((new - now) ** 2).sum())), new
        state = spark.createDataFrame([(n, norm, int(k), [float(v) for v in c]) for k, c in zip(names, now)], schema)
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/round-{n}")
        if norm < threshold:
            break
    kept = [f"{path}/round-{n}" for n in stored_rounds(spark, path)]
    return spark.read.schema(schema).parquet(*kept) if kept else spark.createDataFrame([], schema)


def site_lloyd(points: DataFrame, centres: DataFrame, rounds: int = 300, threshold: float = 1e-4) -> DataFrame:
    """site, k, c, n, inertia: k-means at each site from its own centres (site, k, c), or the best of several starts (site, start, k, c).

    All sites and starts take their steps in the same jobs (many_means). The best start has the least inertia, the smaller start of equals. This
    is a site's upload record: its centres, their sizes and its inertia by centre. A centre without points stays and has n = 0. Sites without points upload nothing.
    """
    start = F.col("start") if "start" in centres.columns else F.lit(0)
    given: dict[tuple, dict[int, list[float]]] = {}
    for r in centres.select("site", start.alias("start"), "k", "c").collect():
        given.setdefault((r["site"], r["start"]), {})[r["k"]] = r["c"]
    keys = sorted(given, key=repr)
    places = [sorted(given[key]) for key in keys]
    rows = points.where("x is not null").select(F.col("site").alias("pool"), "x").persist()
    runs = many_means.fit(rows, {i: (site, np.array([given[site, s][k] for k in places[i]])) for i, (site, s) in enumerate(keys)}, rounds, threshold)
    rows.unpersist()
    found = []
    for site in {site for site, _ in keys}:
        own = sorted((i for i, key in enumerate(keys) if key[0] == site and runs[i].sizes.sum()), key=lambda i: keys[i][1])
        if own:
            best = runs[at := many_means.best_of(runs, own)]
            found += [(site, k, c, int(n), float(d)) for k, c, n, d in zip(places[at], best.centres.tolist(), best.sizes, best.inertia, strict=True)]
    if not found:
        raise ValueError("no site has points")
    kinds = {c: points.schema["site"].dataType.simpleString() if c == "site" else centres.schema["k"].dataType.simpleString() for c in ("site", "k")}
    return points.sparkSession.createDataFrame(found, f"site {kinds['site']}, k {kinds['k']}, c array<double>, n long, inertia double")


def upload_summary(uploads: DataFrame) -> DataFrame:
    """site, n_samples, n_features, n_clusters, inertia of upload records."""
    return uploads.groupBy("site").agg(F.sum("n").alias("n_samples"), F.max(F.size("c")).cast("long").alias("n_features"), F.count(F.lit(1)).alias("n_clusters"), F.sum("inertia").alias("inertia"))


def size_weighted(uploads: DataFrame) -> DataFrame:
    """k, c: centres of one number weighted by their sizes; the plain mean where all sizes are 0."""
    weighed = uploads.join(uploads.groupBy("k").agg(F.sum("n").alias("all_n")), "k").withColumn("w", F.when(F.col("all_n") > 0, F.col("n").cast("double")).otherwise(1.0))
    return clusters.mean_centres(weighed, ["k"], "c", "w")


def unequal_mean(uploads: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """k, c from sites with any number of centres: each site's are matched one to one with those of the first site that has k, at the least total distance, and
    averaged by the sites' weights (site, weight); centres without a partner are left out. Without a site of k centres: ValueError."""
    counts = uploads.groupBy("site").count()
    full = counts.where(F.col("count") == k).agg(F.min("site")).first()[0]
    if full is None:
        raise ValueError(f"no site has {k} centres")
    order = uploads.withColumn("place_of", F.when(F.col("site") == full, F.lit(-1)).otherwise(F.col("site")))  # alignment takes the smallest site as its reference
    matched = alignment.aligned(order.select(F.col("place_of").cast("long").alias("site"), "k", "n", "c")).where("place is not null")
    weighed = matched.join(weights.select(F.when(F.col("site") == full, F.lit(-1)).otherwise(F.col("site")).cast("long").alias("site"), "weight"), "site")
    return clusters.mean_centres(weighed, ["place"], "c", "weight").withColumnRenamed("place", "k")


def site_groups(uploads: DataFrame, k: int = 2) -> DataFrame:
    """site, label: sites in k groups by Ward's hierarchy over the plain mean of their centres; the label is the smallest site of a group."""
    means = clusters.mean_centres(uploads, ["site"], "c")
    return alignment.ward_labels(means.select(F.col("site").cast("long").alias("id"), "c"), k).select(F.col("id").alias("site"), "label")


def centre_statistics(centres: DataFrame) -> DataFrame:
    """One row: clusters, dims, and smallest, largest, mean, standard deviation (n below) and sum of all coordinates."""
    v = centres.select("k", F.explode("c").alias("v"))
    return v.agg(F.countDistinct("k").alias("clusters"), (F.count(F.lit(1)) / F.countDistinct("k")).cast("long").alias("dims"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.sum("v").alias("total"))


def method_ratios(points: DataFrame, methods: dict[str, DataFrame], uploads: DataFrame) -> DataFrame:
    """method, site, ratio: inertia with a method's centres over that with the site's own; site "Total" is that over all sites."""
    own = uploads.groupBy("site").agg(F.sum("inertia").alias("local"))
    found = []
    for name, centres in methods.items():
        sums = clusters.inertia(points, centres, ["site"]).withColumnRenamed("inertia", "global").join(own, "site")
        rows = sums.rollup("site").agg(F.sum("global").alias("global"), F.sum("local").alias("local"))
        found.append(rows.select(F.lit(name).alias("method"), F.coalesce(F.col("site").cast("string"), F.lit("Total")).alias("site"), F.try_divide("global", "local").alias("ratio")))
    return reduce(DataFrame.unionByName, found)


def best_method(ratios: DataFrame) -> DataFrame:
    """method, mean_ratio: that of the least mean ratio, the total among them; the earlier name of equals."""
    means = ratios.groupBy("method").agg(F.avg("ratio").alias("mean_ratio"))
    return means.agg(F.min(F.struct("mean_ratio", "method")).alias("b")).select("b.method", "b.mean_ratio")


def swarm(uploads: DataFrame, weights: DataFrame, particles: int = 10, rounds: int = 50, omega: float = 0.7, c1: float = 1.5, c2: float = 1.5, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """(k, c) and the best fitness of each round: a swarm that minimises sum w * |g - c| ** 2 over all sites' centres by position.

    Particles start at the sites' centres and at their weighted mean; the swarm sees summaries alone, clusters.MOST_CENTRES at most.
    """
    if uploads.count() > clusters.MOST_CENTRES:
        raise ValueError("too many centres for a swarm")
    rows = uploads.join(weights, "site").orderBy("site", "k").select("site", "k", "c", "weight").toPandas()
    sites = [g for _, g in rows.groupby("site")]
    places = sorted(rows["k"].unique().tolist())
    stack = np.stack([np.stack(pd.Series(g["c"].tolist(), g["k"]).reindex(places).tolist()).astype(float) for g in sites])
    w, rng = np.array([g["weight"].iloc[0] for g in sites]), np.random.default_rng(seed)
    fitness = lambda g: float((w[:, None, None] * (g[None] - stack) ** 2).sum())
    at = [*stack, np.tensordot(w / w.sum(), stack, 1)]
    at = np.stack([at[i % len(at)] for i in range(max(particles, len(at)))])
    speed, own, own_fit = np.zeros_like(at), at.copy(), np.array([fitness(g) for g in at])
    curve = [float(own_fit.min())]
    for _ in range(rounds):
        lead = own[own_fit.argmin()]
        pull = rng.random((2, len(at), 1, 1))
        speed = omega * speed + c1 * pull[0] * (own - at) + c2 * pull[1] * (lead - at)
        at = at + speed
        fit = np.array([fitness(g) for g in at])
        better = fit < own_fit
        own[better], own_fit[better] = at[better], fit[better]
        curve.append(float(own_fit.min()))
    best = own[own_fit.argmin()]
    return uploads.sparkSession.createDataFrame([(int(k), [float(v) for v in c]) for k, c in zip(places, best)], "k long, c array<double>"), curve
