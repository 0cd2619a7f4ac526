"""Queries over neighbours, aligned centres, solved processes, smoothed curves and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators import alignment, clusters, models, neighbours, smoothing, solvers

from . import process, vectors, views

QUERIES, SQL = {}, {}
DIMS_USED, K = list(range(16)), 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _knn_sql(x: str) -> str:
    d2 = vectors.D2.format
    return f"""{views.FEATURES}, cut AS (SELECT id, label, {x} AS x FROM feat), va AS (SELECT * FROM cut WHERE id % 20 = 0), tr AS (SELECT * FROM cut WHERE id % 20 <> 0),
 nn AS (SELECT va.id, va.label, tr.label AS tl, row_number() OVER (PARTITION BY va.id ORDER BY {d2(a='va.x', b='tr.x')}, tr.id) AS r FROM va, tr),
 votes AS (SELECT id, label, tl, count(*) AS n FROM nn WHERE r <= {K} GROUP BY id, label, tl), pred AS (SELECT id, label, tl AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, tl) AS r FROM votes) WHERE r = 1),
 f AS (SELECT c, 2.0::DOUBLE * count(*) FILTER (label = predicted) / (count(*) + count(*) FILTER (label = predicted)) AS f FROM (SELECT label AS c, label, predicted FROM pred UNION ALL SELECT predicted, label, predicted FROM pred WHERE predicted <> label) GROUP BY c),
 o AS (SELECT p.id, p.label, q.label AS ql, row_number() OVER (PARTITION BY p.id ORDER BY {d2(a='p.x', b='q.x')}, q.id) AS r FROM va p, va q WHERE p.id <> q.id),
 b AS (SELECT id, CASE WHEN count(*) FILTER (ql <> label) > {(K - 1) * 0.5} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS odd FROM o WHERE r <= {K - 1} GROUP BY id)"""


def _split(spark, sf_dir):
    points = views.features(spark, sf_dir)
    return points.where("id % 20 <> 0"), points.where("id % 20 = 0")


@query(f"WITH {_knn_sql('x')} SELECT id, label, predicted FROM pred")
def knn_predict(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    return neighbours.neighbour_votes(held, train, K)


@query(f"WITH {_knn_sql('x')} SELECT round(avg(f), 6) AS f1 FROM f")
def knn_f1(spark, sf_dir):
    return neighbours.macro_f1(knn_predict(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query(f"WITH {_knn_sql('x')} SELECT round(avg(odd), 6) AS ratio FROM b")
def border_ratio(spark, sf_dir):
    return neighbours.border_ratio(_split(spark, sf_dir)[1], K).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_knn_sql(f'x[1:{len(DIMS_USED)}]')} SELECT round(0.98 * (1 - (SELECT avg(f) FROM f)) + 0.01 * {len(DIMS_USED) / 64} + 0.01 * (SELECT avg(odd) FROM b), 6) AS fitness")
def subset_fitness(spark, sf_dir):
    return neighbours.subset_fitness(*_split(spark, sf_dir), DIMS_USED, 64).withColumn("fitness", F.round("fitness", 6))


@query(f"WITH {views.FEATURES}, m AS (SELECT p.id, p.label, q.label AS o, sum(sqrt({vectors.D2.format(a='p.x', b='q.x')})) AS t, count(*) AS n FROM feat p, feat q GROUP BY p.id, p.label, q.label), s AS (SELECT id, max(CASE WHEN label = o AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN label <> o THEN t / n END) AS b FROM m GROUP BY id) SELECT round(avg(coalesce((b - a) / nullif(CASE WHEN a IS NOT NULL THEN greatest(a, b) END, 0), 0)), 6) AS score FROM s")
def silhouette(spark, sf_dir):
    return neighbours.silhouettes(views.features(spark, sf_dir)).agg(F.round(F.avg("s"), 6).alias("score"))


_IMPUTE = """WITH g AS (SELECT l_orderkey, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS q, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS e, l_discount AS d, l_tax AS t FROM lineitem),
 c AS (SELECT *, (q + e + d + t) / 4 AS m FROM g WHERE q IS NOT NULL AND e IS NOT NULL AND d IS NOT NULL AND t IS NOT NULL), v AS (SELECT *, ((q - m) * (q - m) + (e - m) * (e - m) + (d - m) * (d - m) + (t - m) * (t - m)) / 3 AS s FROM c),
 x AS (SELECT sqrt(sum((q - e) * (q - e) / s)) AS qe, sqrt(sum((q - d) * (q - d) / s)) AS qd, sqrt(sum((q - t) * (q - t) / s)) AS qt, sqrt(sum((e - d) * (e - d) / s)) AS ed, sqrt(sum((e - t) * (e - t) / s)) AS et FROM v WHERE s > 0),
 n AS (SELECT g.*, list_sort(list_filter([{'w': qe, 'j': 1, 'v': e}, {'w': qd, 'j': 2, 'v': d}, {'w': qt, 'j': 3, 'v': t}], z -> z.v IS NOT NULL))[1:2] AS nq, list_sort(list_filter([{'w': qe, 'j': 0, 'v': q}, {'w': ed, 'j': 2, 'v': d}, {'w': et, 'j': 3, 'v': t}], z -> z.v IS NOT NULL))[1:2] AS ne FROM g, x)
 SELECT l_orderkey, round(coalesce(q, list_sum(list_transform(nq, z -> z.v / (z.w + 1e-10))) / list_sum(list_transform(nq, z -> 1 / (z.w + 1e-10)))), 6) AS q, round(coalesce(e, list_sum(list_transform(ne, z -> z.v / (z.w + 1e-10))) / list_sum(list_transform(ne, z -> 1 / (z.w + 1e-10)))), 6) AS e FROM n"""


@query(_IMPUTE.replace("z -> ", "lambda z: "))
def knn_impute(spark, sf_dir):
    d = views.table(spark, sf_dir, "lineitem")
    holed = d.select("l_orderkey", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")).alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    return neighbours.impute_from_columns(holed, ["q", "e", "d", "t"], 2).select("l_orderkey", F.round("q", 6).alias("q"), F.round("e", 6).alias("e"))


def _site_centres(spark, sf_dir):
    points = views.features(spark, sf_dir).withColumnRenamed("label", "k")
    sizes = points.groupBy("site", "k").agg(F.count(F.lit(1)).alias("n"))
    return clusters.gathered(clusters.mean_vectors(points, ["site", "k"]), ["site", "k"]).join(sizes, ["site", "k"]).select("site", "k", "n", "c")


def _long(df, key):
    return df.select(key, F.posexplode("c").alias("i", "m")).select(key, F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


@query()
def hungarian_align(spark, sf_dir):
    return _long(alignment.aligned_mean(_site_centres(spark, sf_dir)), "k")


@query()
def ward_merge(spark, sf_dir):
    return _long(alignment.ward_merge(_site_centres(spark, sf_dir), 10), "label")


@query(vectors.SQL["fed_weights"].rsplit(" SELECT site", 1)[0] + ", wt AS (SELECT site, raw / sum(raw) OVER () AS w FROM raw) SELECT k, i, round(sum(m * w) / sum(w), 6) AS m FROM (SELECT site, k, i, avg(v) AS m FROM dims GROUP BY site, k, i) JOIN wt USING (site) GROUP BY k, i")
def fed_weighted_mean(spark, sf_dir):
    """The minimum of sum w * |g - c| ** 2 over positions is the weighted mean, so no swarm has to look for it."""
    near = clusters.nearest(*vectors._both(spark, sf_dir))
    own = clusters.mean_vectors(near, ["site", "k"])
    spread = own.groupBy("site", "i").agg(F.var_pop("m").alias("v")).groupBy("site").agg(F.avg("v").alias("variance"))
    up = near.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("sse"), (F.avg("label") / 10).alias("severity"))
    weights = clusters.institution_weights(up.join(F.broadcast(spread), "site"))  # a row a site
    return own.join(F.broadcast(weights), "site").groupBy("k", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("m") * F.col("weight")) / F.sum("weight"), 6).alias("m"))


def _kept_process(spark, sf_dir):
    probs, rewards = process._process(process._counts(process._log(spark, sf_dir)))
    return probs.select("s", "a", "s2", "p").checkpoint(), rewards.checkpoint()


def _states_sql(gamma: float, limit: float, most: int, rest: str = "") -> str:
    """Sweeps from zero over states with an action, until a sweep's changes span less than limit: rows (n, s, v) of each sweep. The absorbing states stay at 0 and belong to the span."""
    swept = f"SELECT w.n, w.s, max(rew.r + {gamma} * coalesce(x.ahead, 0)) AS v, any_value(w.v) AS old FROM (SELECT * FROM it WHERE going) w JOIN rew ON rew.s = w.s LEFT JOIN (SELECT pr.s, pr.a, sum(pr.p * y.v) AS ahead FROM pr JOIN (SELECT * FROM it WHERE going) y ON y.s = pr.s2 GROUP BY pr.s, pr.a) x ON x.s = rew.s AND x.a = rew.a GROUP BY w.n, w.s"
    return f"it AS (SELECT 0 AS n, s, 0.0::DOUBLE AS v, true AS going FROM (SELECT DISTINCT s FROM rew) UNION ALL SELECT n + 1, s, v, greatest(max(v - old) OVER (), 0) - least(min(v - old) OVER (), 0) >= {limit} AND n + 1 < {most} FROM ({swept}))"


def _solution_sql(gamma: float, limit: float, most: int, base: str = process.BASE) -> str:
    return f"""WITH RECURSIVE {base}, {_states_sql(gamma, limit, most)}, last AS (SELECT s, v FROM it WHERE n = (SELECT max(n) FROM it)), before AS (SELECT s, v FROM it WHERE n = (SELECT max(n) - 1 FROM it)),
 q AS (SELECT rew.s, rew.a, r + {gamma} * coalesce(x.v, 0) AS q FROM rew LEFT JOIN (SELECT pr.s, a, sum(p * v) AS v FROM pr JOIN before ON pr.s2 = before.s GROUP BY pr.s, a) x ON rew.s = x.s AND rew.a = x.a)
 SELECT last.s, (SELECT min(a) FROM q WHERE q.s = last.s AND q.q >= (SELECT max(q) FROM q z WHERE z.s = last.s) - 1e-9) AS best, round(last.v, 6) AS v FROM last"""


def _solution(spark, sf_dir, method, gamma, **options):
    found = solvers.solved(*_kept_process(spark, sf_dir), method, gamma, **options)
    return found.select("s", "best", F.round("v", 6).alias("v")).distinct()


@query(_solution_sql(0.9, 0.01 * (1 - 0.9) / 0.9, 1000))
def value_iteration(spark, sf_dir):
    return _solution(spark, sf_dir, "values", 0.9)


@query(_solution_sql(process.GAMMA, 1e-10, 6000))
def policy_iteration(spark, sf_dir):
    return _solution(spark, sf_dir, "policies", process.GAMMA)


@query(_solution_sql(process.GAMMA, 1e-10, 6000).rsplit(" SELECT last.s", 1)[0] + " SELECT s, a, round(q, 6) AS q FROM q")
def policy_iteration_q(spark, sf_dir):
    """The table of q that a model keeps beside its policy."""
    return solvers.solved(*_kept_process(spark, sf_dir), "policies", process.GAMMA).select("s", "a", F.round("q", 6).alias("q"))


def _partial_sql(gamma: float, limit: float, sweeps: int = 10) -> str:
    """A greedy sweep (j = 0), then up to ``sweeps`` under its policy until none changes by limit, and again; it ends with the greedy sweep whose changes span less than limit."""
    return f"""WITH RECURSIVE {process.BASE}, st AS (SELECT s FROM rew UNION SELECT s2 FROM pr), choices AS (SELECT s, a, r FROM rew UNION ALL SELECT s, -1, 0.0 FROM st WHERE s NOT IN (SELECT s FROM rew)),
 it AS (SELECT 0 AS n, 0 AS j, s, (SELECT min(r) FROM choices) / (1 - {gamma}::DOUBLE) AS v, -1::BIGINT AS best, true AS going FROM st UNION ALL
 SELECT n + 1, CASE WHEN j = 0 THEN 1 WHEN j = {sweeps} OR max(abs(new - v)) OVER () < {limit} THEN 0 ELSE j + 1 END, s, new, a, j > 0 OR max(new - v) OVER () - min(new - v) OVER () >= {limit} FROM (
 SELECT n, j, s, v, a, CASE WHEN j = 0 THEN top ELSE q END AS new FROM (SELECT *, max(q) OVER (PARTITION BY s) AS top FROM (
 SELECT w.n, w.j, w.s, w.v, w.best, choices.a, choices.r + {gamma} * coalesce(x.ahead, 0) AS q FROM (SELECT * FROM it WHERE going) w JOIN choices ON choices.s = w.s
 LEFT JOIN (SELECT pr.s, pr.a, sum(pr.p * y.v) AS ahead FROM pr JOIN (SELECT * FROM it WHERE going) y ON y.s = pr.s2 GROUP BY pr.s, pr.a) x ON x.s = choices.s AND x.a = choices.a))
 QUALIFY CASE WHEN j = 0 THEN row_number() OVER (PARTITION BY s ORDER BY CASE WHEN q >= top - 1e-9 THEN 0 ELSE 1 END, a) = 1 ELSE a = best END))
 SELECT s, best, round(v, 6) AS v FROM it WHERE n = (SELECT max(n) FROM it) AND s IN (SELECT s FROM rew)"""


@query(_partial_sql(0.9, 0.01 * (1 - 0.9) / 0.9))
def modified_pi(spark, sf_dir):
    return _solution(spark, sf_dir, "partial", 0.9)


_AGAIN = f"""WITH RECURSIVE {process.BASE}, p2 AS (SELECT s, a, s2, p FROM pr UNION ALL SELECT s, 0, 0, 1.0 FROM (VALUES (750), (751)) t(s)), r2 AS (SELECT s, a, r FROM rew UNION ALL SELECT s, 0, 0.0 FROM (VALUES (750), (751)) t(s)),
 it AS (SELECT 0 AS n, s, 0.0::DOUBLE AS v, 0.0::DOUBLE AS gain, true AS going, 0.0::DOUBLE AS mean FROM (SELECT DISTINCT s FROM r2) UNION ALL
 SELECT n + 1, s, v, arg_max(v, s) OVER (), max(v - old) OVER () - min(v - old) OVER () >= 0.01 AND n + 1 < 1000, gain + min(v - old) OVER () FROM (
 SELECT w.n, w.s, max(r2.r + coalesce(x.ahead, 0)) - any_value(w.gain) AS v, any_value(w.v) AS old, any_value(w.gain) AS gain FROM (SELECT * FROM it WHERE going) w JOIN r2 ON r2.s = w.s LEFT JOIN (SELECT p2.s, p2.a, sum(p2.p * y.v) AS ahead FROM p2 JOIN (SELECT * FROM it WHERE going) y ON y.s = p2.s2 GROUP BY p2.s, p2.a) x ON x.s = r2.s AND x.a = r2.a GROUP BY w.n, w.s)),
 last AS (SELECT s, v, mean FROM it WHERE n = (SELECT max(n) FROM it)), before AS (SELECT s, v FROM it WHERE n = (SELECT max(n) - 1 FROM it)),
 q AS (SELECT r2.s, r2.a, r + coalesce(x.v, 0) AS q FROM r2 LEFT JOIN (SELECT p2.s, a, sum(p * v) AS v FROM p2 JOIN before ON p2.s2 = before.s GROUP BY p2.s, a) x ON r2.s = x.s AND r2.a = x.a)
 SELECT last.s, (SELECT min(a) FROM q WHERE q.s = last.s AND q.q >= (SELECT max(q) FROM q z WHERE z.s = last.s) - 1e-9) AS best, round(last.v, 6) AS v, round(mean, 6) AS average_reward FROM last"""


@query(_AGAIN)
def relative_vi(spark, sf_dir):
    """Stays that ended begin again at state 0, so that the mean reward a step exists."""
    probs, rewards = _kept_process(spark, sf_dir)
    again = spark.createDataFrame([(s, 0, 0, 1.0) for s in (750, 751)], "s long, a long, s2 long, p double")
    none = again.select("s", "a", F.lit(0.0).alias("r"))
    found = solvers.solved(probs.unionByName(again), rewards.unionByName(none), "relative")
    return found.select("s", "best", F.round("v", 6).alias("v"), F.round("gain", 6).alias("average_reward")).distinct()


def _smooth_sql(span: int, rounds: int) -> str:
    """Every pair of the 100 bins, once a round; fits by normal equations."""
    steps, power = [], lambda p, y="1": f"sum(w * pow(x, {p}) * {y})"
    sums = ", ".join([*(f"{power(p)} AS m{p}" for p in range(5)), *(f"{power(p, 'y')} AS t{p}" for p in range(3)), "sum(CASE WHEN w > 1e-12 THEN 1 ELSE 0 END) AS counted"])
    for k in range(rounds + 1):
        steps.append(f"""p{k} AS MATERIALIZED (SELECT a.i, z.i - a.i AS x, z.y, z.r, z.i - greatest(1, least(a.i - a.held // 2, a.n - a.held + 1)) BETWEEN 0 AND a.held - 1 AS inside, a.held FROM r{k} a, r{k} z),
 q{k} AS (SELECT *, bool_or(inside AND r <= 0) OVER (PARTITION BY i) AND max(r) OVER (PARTITION BY i) > 0 AS spoilt, rank() OVER (PARTITION BY i, r > 0 ORDER BY abs(x)) AS place FROM p{k}),
 d{k} AS (SELECT i, x / {span}.0 AS x, y, r, abs(x) / greatest(max(abs(x)) OVER (PARTITION BY i), 1.0) AS d FROM q{k} WHERE CASE WHEN spoilt THEN r > 0 AND place <= held ELSE inside END),
 w{k} AS (SELECT i, x, y, r * CASE WHEN max(pow(1 - pow(d, 3), 3)) OVER (PARTITION BY i) < pow(2, -52) THEN 1 ELSE pow(1 - pow(d, 3), 3) END AS w FROM d{k}),
 c{k} AS MATERIALIZED (SELECT i, coalesce(CASE WHEN counted >= 3 THEN (t0 * (m2 * m4 - m3 * m3) + t1 * (m2 * m3 - m1 * m4) + t2 * (m1 * m3 - m2 * m2))
 / (m0 * (m2 * m4 - m3 * m3) + m1 * (m2 * m3 - m1 * m4) + m2 * (m1 * m3 - m2 * m2)) WHEN m0 > 0 THEN t0 / m0 END, y) AS c FROM (SELECT i, {sums} FROM w{k} GROUP BY i) JOIN (SELECT i, y FROM r{k}) USING (i)),
 r{k + 1} AS MATERIALIZED (SELECT i, n, held, y, CASE WHEN coalesce(u, 0) < 1 THEN pow(1 - pow(coalesce(u, 0), 2), 2) ELSE 0 END AS r FROM (SELECT i, n, held, y, abs(y - c) / nullif(6 * greatest(median(abs(y - c)) OVER (), 1e8 * pow(2, -52) * max(abs(y)) OVER ()), 0) AS u FROM r{k} JOIN c{k} USING (i)))""")
    return f"""WITH cb AS MATERIALIZED ({process.SQL["calibration_bins"]}), b AS (SELECT bin, mean AS y, row_number() OVER (ORDER BY bin) AS i, count(*) OVER () AS n FROM cb WHERE mean IS NOT NULL),
 r0 AS MATERIALIZED (SELECT i, n, least({2 * (span // 2) + 1}, n) AS held, y, 1.0::DOUBLE AS r FROM b), {", ".join(steps)} SELECT cb.bin, cb.mean, round(c, 6) AS smooth FROM cb LEFT JOIN b USING (bin) LEFT JOIN c{rounds} USING (i)"""


@query(_smooth_sql(30, 5))
def smoothed_curve(spark, sf_dir):
    bins = process.calibration_bins(spark, sf_dir).withColumn("series", F.lit(0))
    return smoothing.smooth(bins, "series", "bin", "mean", 30).select("bin", "mean", F.round("smooth", 6).alias("smooth"))


@query("WITH n AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings) SELECT CAST(floor((greatest(1, floor(sqrt(n / 2))) + greatest(1, 2 * d)) / 2) AS BIGINT) AS simple, CAST(greatest(2, least(50, greatest(2, floor(sqrt(n))), greatest(2, 2 * floor(sqrt(d))))) AS BIGINT) AS heuristic FROM n")
def choose_k(spark, sf_dir):
    found = views.features(spark, sf_dir).agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return spark.createDataFrame([(models.few_clusters(*found), models.heuristic_clusters(*found))], "simple long, heuristic long")


@query()
def kmeans_best_of_n(spark, sf_dir):
    points = views.features(spark, sf_dir)
    centres, _ = models.kmeans_restarts(points, 10)
    return clusters.nearest(points, centres).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("inertia"))


@query()
def pca_scatter(spark, sf_dir):
    return models.components(views.features(spark, sf_dir)).select("id", *[F.round(F.col("pc")[i], 6).alias(f"pc{i + 1}") for i in range(2)])


@query()
def topk_importance(spark, sf_dir):
    points = views.features(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("double"))
    return models.top_importances(points, 10).withColumn("importance", F.round("importance", 6))
