"""Queries over feature vectors: nearest centres, cluster quality and aggregation over sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators import clusters as C

from . import views

QUERIES, SQL = {}, {}
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
NEAR = f"near AS (SELECT id, site, label, x, k, d2 FROM (SELECT id, site, label, x, k, {D2.format(a='x', b='c')} AS d2, row_number() OVER (PARTITION BY id ORDER BY {D2.format(a='x', b='c')}, k) AS r FROM feat, cen) WHERE r = 1)"
BASE = f"{views.FEATURES}, {views.CENTRES}, {NEAR}"
DIMS = "dims AS (SELECT id, site, label, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM near)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _both(spark, sf_dir):
    points = views.features(spark, sf_dir)
    return points, views.centres(points)


def _long(df, *by):
    return df.select(*by, F.posexplode("c").alias("i", "m")).select(*by, F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


@query(f"WITH {BASE} SELECT id, k, round(d2, 6) AS d2 FROM near")
def nearest_center(spark, sf_dir):
    return C.nearest(*_both(spark, sf_dir)).select("id", "k", F.round("d2", 6).alias("d2"))


@query(f"WITH {BASE} SELECT site, round(sum(d2), 5) AS inertia FROM near GROUP BY site")
def inertia(spark, sf_dir):
    return C.inertia(*_both(spark, sf_dir), ["site"]).withColumn("inertia", F.round("inertia", 5))


@query(f"WITH {BASE}, {DIMS} SELECT k, i, round(avg(v), 6) AS m FROM dims GROUP BY k, i")
def lloyd_1(spark, sf_dir):
    return _long(C.lloyd(*_both(spark, sf_dir)), "k")


@query(f"WITH {BASE}, {DIMS}, own AS (SELECT site, k, i, avg(v) AS m FROM dims GROUP BY site, k, i), grid AS (SELECT site, k, unnest(c) AS m0, unnest(range(len(c))) AS i FROM (SELECT DISTINCT site FROM feat), cen) SELECT grid.k, grid.i, round(avg(coalesce(m, m0)), 6) AS m FROM grid LEFT JOIN own ON grid.site = own.site AND grid.k = own.k AND grid.i = own.i GROUP BY grid.k, grid.i")
def fed_lloyd_1(spark, sf_dir):
    return _long(C.federated_lloyd(*_both(spark, sf_dir)), "k")


@query(f"WITH {BASE}, {DIMS} SELECT k, i, round(sum(m * n) / sum(n), 6) AS m FROM (SELECT site, k, i, avg(v) AS m, count(*) AS n FROM dims GROUP BY site, k, i) GROUP BY k, i")
def fed_mean_sizes(spark, sf_dir):
    own = C.mean_vectors(C.nearest(*_both(spark, sf_dir)), ["site", "k"])
    sizes = C.nearest(*_both(spark, sf_dir)).groupBy("site", "k").agg(F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(sizes), ["site", "k"]).groupBy("k", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("m"))


@query(f"WITH {BASE}, {DIMS}, s AS (SELECT site, count(*) AS n FROM feat GROUP BY site) SELECT k, i, round(sum(m * n) / sum(n), 6) AS m FROM (SELECT d.site, k, i, avg(v) AS m, any_value(s.n) AS n FROM dims d JOIN s ON d.site = s.site GROUP BY d.site, k, i) GROUP BY k, i")
def fed_mean_samples(spark, sf_dir):
    points, centres = _both(spark, sf_dir)
    own = C.mean_vectors(C.nearest(points, centres), ["site", "k"])
    sizes = points.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(sizes), "site").groupBy("k", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("m"))


@query(f"WITH {BASE}, {DIMS}, mine AS (SELECT site, k, i, avg(v) AS m FROM dims GROUP BY site, k, i), loc AS (SELECT d.site, sum((v - m) * (v - m)) AS l FROM dims d JOIN mine ON d.site = mine.site AND d.k = mine.k AND d.i = mine.i GROUP BY d.site), gl AS (SELECT site, sum(d2) AS g FROM near GROUP BY site) SELECT coalesce(CAST(site AS VARCHAR), 'Total') AS site, round(sum(g), 4) AS global_inertia, round(sum(l), 4) AS local_inertia, round(sum(g) / nullif(sum(l), 0), 6) AS ratio FROM gl JOIN loc USING (site) GROUP BY GROUPING SETS ((site), ())")
def fed_eval_total(spark, sf_dir):
    near = C.nearest(*_both(spark, sf_dir))
    own = C.gathered(C.mean_vectors(near, ["site", "k"]), ["site", "k"])
    rows = near.join(F.broadcast(own), ["site", "k"]).withColumn("l", C.squared_distance(F.col("x"), F.col("c")))
    sums = rows.rollup("site").agg(F.sum("d2").alias("g"), F.sum("l").alias("l"))
    return sums.select(F.coalesce(F.col("site").cast("string"), F.lit("Total")).alias("site"), F.round("g", 4).alias("global_inertia"), F.round("l", 4).alias("local_inertia"), F.round(F.try_divide(F.col("g"), F.col("l")), 6).alias("ratio"))


@query(f"WITH {BASE}, {DIMS}, cv AS (SELECT site, avg(vp) AS variance FROM (SELECT site, i, var_pop(m) AS vp FROM (SELECT site, k, i, avg(v) AS m FROM dims GROUP BY site, k, i) GROUP BY site, i) GROUP BY site), up AS (SELECT near.site, count(*) AS n, sum(d2) AS sse, avg(label) / 10 AS severity FROM near GROUP BY near.site), raw AS (SELECT up.site, (n / CAST(sum(n) OVER () AS DOUBLE)) / (sse / sum(sse) OVER () + 1e-10) / (variance + 1e-10) * (1 + 0.5 * severity) AS raw FROM up JOIN cv ON up.site = cv.site) SELECT site, round(raw / sum(raw) OVER (), 6) AS weight FROM raw")
def fed_weights(spark, sf_dir):
    near = C.nearest(*_both(spark, sf_dir))
    spread = C.mean_vectors(near, ["site", "k"]).groupBy("site", "i").agg(F.var_pop("m").alias("v")).groupBy("site").agg(F.avg("v").alias("variance"))
    up = near.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("sse"), (F.avg("label") / 10).alias("severity"))
    return C.institution_weights(up.join(F.broadcast(spread), "site")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {BASE}, {DIMS}, own AS (SELECT site, k, list(m ORDER BY i) AS c FROM (SELECT site, k, i, avg(v) AS m FROM dims GROUP BY site, k, i) GROUP BY site, k) SELECT p.site AS a, q.site AS b, round(1 / (1 + avg(sqrt({D2.format(a='p.c', b='q.c')}))), 6) AS similarity FROM own p JOIN own q ON p.site < q.site GROUP BY p.site, q.site")
def fed_similarity(spark, sf_dir):
    own = C.gathered(C.mean_vectors(C.nearest(*_both(spark, sf_dir)), ["site", "k"]), ["site", "k"])
    return C.site_similarity(own).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {views.FEATURES}, d AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM feat), o AS (SELECT label, i, count(*) AS n, avg(v) AS m, sum(v * v) - sum(v) * sum(v) / count(*) AS w FROM d GROUP BY label, i), a AS (SELECT i, avg(v) AS m, count(*) AS n FROM d GROUP BY i) SELECT round((sum(o.n * (o.m - a.m) * (o.m - a.m)) / (count(DISTINCT label) - 1)) / (sum(w) / (max(a.n) - count(DISTINCT label))), 6) AS score FROM o JOIN a ON o.i = a.i")
def calinski_harabasz(spark, sf_dir):
    return C.calinski_harabasz(views.features(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {views.FEATURES}, d AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM feat), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM d GROUP BY label, i) GROUP BY label), s AS (SELECT feat.label, any_value(c) AS c, avg(sqrt({D2.format(a='x', b='c')})) AS s FROM feat JOIN c ON feat.label = c.label GROUP BY feat.label) SELECT round(avg(w), 6) AS score FROM (SELECT p.label, max((p.s + q.s) / sqrt({D2.format(a='p.c', b='q.c')})) AS w FROM s p JOIN s q ON p.label <> q.label GROUP BY p.label)")
def davies_bouldin(spark, sf_dir):
    return C.davies_bouldin(views.features(spark, sf_dir)).withColumn("score", F.round("score", 6))
