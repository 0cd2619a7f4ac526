"""Queries over splits, lookups, federated rounds, normalisers, example processes and model search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.functions import ranks
from cohortflow.operators import attributions, clusters, federated, halo, models, neighbours, normalise, processes, search, smoothing, solvers, splits
from cohortflow.operators import trajectories as T

from . import process, searches, vectors, views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _draw(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


FOLD = f"CAST(floor({_draw('''icustayid || '|1' ''')} * 5) + 1 AS BIGINT)"


@query(f"WITH {views.PANEL} SELECT DISTINCT icustayid, {FOLD} AS fold FROM panel")
def fold_split(spark, sf_dir):
    return views.panel(spark, sf_dir).select("icustayid").distinct().withColumn("fold", splits.fold("icustayid", 1))


@query(f"WITH {views.PANEL} SELECT event_id, icustayid FROM panel WHERE {_draw('''event_id || '|sample|1' ''')} < 0.25")
def state_sample(spark, sf_dir):
    return views.panel(spark, sf_dir).where(splits.sampled("event_id", 1)).select("event_id", "icustayid")


@query(f"WITH {views.FEATURES}, d AS (SELECT id, label, {_draw('''id || '|42' ''')} AS u FROM feat) SELECT id, label, rank() OVER (PARTITION BY label ORDER BY u) <= ceil(0.8 * count(*) OVER (PARTITION BY label)) AS train FROM d")
def stratified_split(spark, sf_dir):
    return splits.stratified(views.features(spark, sf_dir).select("id", "label"), "id", "label")


@query(f"WITH {views.PANEL} SELECT icustayid, bloc, event_id FROM panel WHERE bloc <= 3")
def unique_with_cap(spark, sf_dir):
    return splits.first_of_each(views.panel(spark, sf_dir).select("icustayid", "bloc", "event_id"), ["icustayid"], ["bloc"], 3)


@query(f"WITH {views.PANEL} SELECT event_id, icustayid FROM panel WHERE {FOLD} <> 1")
def training_rows(spark, sf_dir):
    """Semi-join with the ids of the training folds."""
    return views.panel(spark, sf_dir).select("event_id", "icustayid").join(fold_split(spark, sf_dir).where("fold <> 1"), "icustayid", "left_semi")


@query(f"WITH {views.PANEL} SELECT event_id, icustayid FROM panel WHERE {FOLD} = 1")
def held_out_rows(spark, sf_dir):
    """Anti-join with the same ids."""
    return views.panel(spark, sf_dir).select("event_id", "icustayid").join(fold_split(spark, sf_dir).where("fold <> 1"), "icustayid", "left_anti")


@query(f"WITH {views.PANEL}, {process.BINS}, {process.ACTS}, m AS (SELECT action, median(iv) AS iv_median, median(vaso) AS vaso_median FROM acts GROUP BY action) SELECT event_id, action, round(iv_median, 6) AS iv_median, round(vaso_median, 6) AS vaso_median FROM acts JOIN m USING (action)")
def doses_of_actions(spark, sf_dir):
    """Each row with the median doses of its action."""
    acts = T.with_actions(views.panel(spark, sf_dir)).select("event_id", "action", "iv", "vaso").checkpoint()
    medians = ranks.column_quantiles(acts, ["iv", "vaso"], {"median": 0.5}, ["action"])
    return acts.join(medians, "action").select("event_id", "action", F.round("median_iv", 6).alias("iv_median"), F.round("median_vaso", 6).alias("vaso_median"))


@query(f"WITH {views.SEVERITY} SELECT id % 3 + 1 AS site, count(*) FILTER (severity = '1') AS mild, count(*) FILTER (severity = '2') AS moderate, count(*) FILTER (severity = '3') AS severe FROM sev GROUP BY 1")
def severity_pivot(spark, sf_dir):
    counts = views.severity(spark, sf_dir).groupBy((F.col("id") % 3 + 1).alias("site")).pivot("severity", ["1", "2", "3"]).count()
    return counts.select("site", *[F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("1", "mild"), ("2", "moderate"), ("3", "severe"))])


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS number, CAST(value AS BIGINT) - CASE WHEN CAST(value AS BIGINT) > value THEN 1 ELSE 0 END AS whole, to_json({'t': event_type, 'u': user_id}) AS packed, event_type AS unpacked FROM events")
def casts_and_json(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    packed = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u")))
    return e.select("event_id", F.expr("try_cast(event_type as double)").alias("number"), F.floor("value").cast("long").alias("whole"), packed.alias("packed"), F.get_json_object(packed, "$.t").alias("unpacked"))


@query(f"WITH {process.BASE}, e AS (SELECT icustayid, max(bloc) AS last, sum(reward) AS final FROM log GROUP BY icustayid) SELECT icustayid, bloc, round(pow({process.GAMMA}, last - bloc - 1) * final, 6) AS togo FROM log JOIN e USING (icustayid) WHERE action >= 0")
def return_to_go(spark, sf_dir):
    log = process._log(spark, sf_dir)
    ends = log.groupBy("icustayid").agg(F.max("bloc").alias("last"), F.sum("reward").alias("final"))
    return log.where("action >= 0").join(ends, "icustayid").select("icustayid", "bloc", F.round(F.pow(F.lit(process.GAMMA), F.col("last") - F.col("bloc") - 1) * F.col("final"), 6).alias("togo"))


@query(f"WITH {views.PANEL} SELECT icustayid, bloc, round(sum(value) OVER w, 6) AS total, round(avg(value) OVER (PARTITION BY icustayid ORDER BY bloc ROWS BETWEEN 49999 PRECEDING AND CURRENT ROW), 6) AS moving FROM panel WINDOW w AS (PARTITION BY icustayid ORDER BY bloc)")
def running_values(spark, sf_dir):
    """Cumulative sum, and the mean of the last 50,000 values of a series; in blocks of positions, so that no series is one task."""
    rows = halo.numbered(views.panel(spark, sf_dir).select("icustayid", "bloc", "value"), "icustayid", "bloc")
    found = halo.running_sum(halo.moving_mean(rows, "value", 50_000), "value")
    return found.select("icustayid", "bloc", F.round("total", 6).alias("total"), F.round("moving", 6).alias("moving"))


@query(f"""WITH {views.PANEL}, m AS (SELECT icustayid, bloc, avg(value) OVER (PARTITION BY icustayid ORDER BY bloc ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM panel),
 c AS (SELECT icustayid, bloc, m, abs((m - lag(m) OVER w) / nullif(lag(m) OVER w, 0)) AS d FROM m WHERE bloc % 5 = 0 WINDOW w AS (PARTITION BY icustayid ORDER BY bloc)),
 f AS (SELECT icustayid, min(bloc) AS stopped FROM c WHERE d < 0.05 GROUP BY icustayid)
 SELECT i.icustayid, f.stopped, round(m, 6) AS moving, round(d, 6) AS change FROM (SELECT DISTINCT icustayid FROM panel) i LEFT JOIN f USING (icustayid) LEFT JOIN c ON c.icustayid = f.icustayid AND c.bloc = f.stopped""")
def moving_stop(spark, sf_dir):
    """Where the mean of a stay's last 10 values, looked at every 5 steps, changes by under 5 per cent for the first time."""
    rows = halo.numbered(views.panel(spark, sf_dir).select("icustayid", "bloc", "value"), "icustayid", "bloc")
    return halo.settled(rows, "value", 10, 5, 0.05, ["icustayid"]).select("icustayid", "stopped", F.round("moving", 6).alias("moving"), F.round("change", 6).alias("change"))


@query(f"""WITH {views.PANEL}, d AS (SELECT a.icustayid, a.bloc, z.bloc AS near, rank() OVER (PARTITION BY a.icustayid, a.bloc ORDER BY abs(z.bloc - a.bloc)) AS place
 FROM panel a JOIN panel z ON z.icustayid = a.icustayid AND z.event_type = 'purchase') SELECT icustayid, bloc, near FROM d WHERE place <= 3""")
def nearest_purchases(spark, sf_dir):
    """For each step of a stay the 3 nearest steps of a kind, with those that tie with the third."""
    panel = views.panel(spark, sf_dir).select("icustayid", "bloc", (F.col("event_type") == "purchase").cast("double").alias("_r"))
    rows = halo.numbered(panel, "icustayid", "bloc")
    series = rows.where("_i = 1").select("_series", "icustayid")
    return smoothing.masked_neighbours(rows, 3).join(series, "_series").select("icustayid", F.col("_i").alias("bloc"), "near")


_N = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END - 0.5 AS flag, ln(0.1 + l_discount) AS dose, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS e, ln(0.1 + l_tax) AS t FROM lineitem"
_SCALED = "round((q - mq) / sq, 6) AS q, round((e - me) / se, 6) AS e, round(2 * (t - mt) / st, 6) AS t"
_MOMENTS = "SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(e) AS me, stddev_samp(e) AS se, avg(t) AS mt, stddev_samp(t) AS st FROM n"


def _lines(spark, sf_dir):
    flag = F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(0.0)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("flag"), F.col("l_discount").cast("double").alias("dose"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("e"), F.col("l_tax").cast("double").alias("t"))


def _normalised(df, stats=None):
    return normalise.normalised(df, ["flag", "dose"], ["q", "e"], ["t"], "dose", "t", stats)


def _shown(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "flag", *[F.round(c, 6).alias(c) for c in ("dose", "q", "e", "t")])


@query(f"WITH n AS ({_N}), m AS ({_MOMENTS}) SELECT l_orderkey, l_linenumber, l_partkey, flag, round(dose, 6) AS dose, {_SCALED} FROM n, m")
def core_normalised(spark, sf_dir):
    return _shown(_normalised(_lines(spark, sf_dir))[0])


@query(f"WITH n AS ({_N}), m AS ({_MOMENTS} WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, l_partkey, flag, round(dose, 6) AS dose, {_SCALED} FROM n, m WHERE l_orderkey % 5 = 0")
def normalised_by_training_moments(spark, sf_dir):
    """Held-out orders scaled by the moments of the others; the split is the feature."""
    lines = _lines(spark, sf_dir)
    _, stats = _normalised(lines.where("l_orderkey % 5 <> 0"))
    return _shown(_normalised(lines.where("l_orderkey % 5 = 0"), stats)[0])


@query(f"WITH n AS ({_N}), m AS ({_MOMENTS}) SELECT round(mq, 5) AS mean_q, round(sq, 5) AS sd_q, round(me, 3) AS mean_e, round(se, 3) AS sd_e, round(mt, 5) AS mean_t, round(st, 5) AS sd_t FROM m")
def conversion_moments(spark, sf_dir):
    stats = _normalised(_lines(spark, sf_dir))[1]
    return stats.select(*[F.round(f"{p}_{c}", 3 if c == "e" else 5).alias(f"{p}_{c}") for c in ("q", "e", "t") for p in ("mean", "sd")])


_SITE = f"""WITH {views.PANEL}, f AS (SELECT icustayid, icustayid % 3 AS site, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN iv END AS iv, CAST(y90 AS DOUBLE) AS y90 FROM panel WHERE bloc = 1),
 m AS (SELECT site, avg(value) AS v, avg(y90) AS y, median(iv) AS i FROM f GROUP BY site), g AS (SELECT icustayid, f.site, coalesce(value, v) AS value, coalesce(iv, i) AS iv, coalesce(y90, y) AS y90 FROM f JOIN m ON f.site = m.site),
 q AS (SELECT site, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b, quantile_cont(iv, 0.01) AS c, quantile_cont(iv, 0.99) AS d FROM g GROUP BY site), h AS (SELECT icustayid, g.site, greatest(a, least(b, value)) AS value, ln(0.1 + greatest(0, greatest(c, least(d, iv)))) AS iv, y90 FROM g JOIN q ON g.site = q.site),
 s AS (SELECT site, avg(value) AS mv, stddev_pop(value) AS sv, avg(iv) AS mi, stddev_pop(iv) AS si FROM h GROUP BY site) SELECT icustayid, h.site, round((value - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END, 6) AS value, round((iv - mi) / CASE WHEN si = 0 THEN 1 ELSE si END, 6) AS iv, y90 - 0.5 AS y90 FROM h JOIN s ON h.site = s.site"""


@query(_SITE)
def site_pipeline(spark, sf_dir):
    """A site's whole preprocessing, from first rows to scaled features."""
    panel = views.panel(spark, sf_dir).select("icustayid", "bloc", (F.col("icustayid") % 3).alias("site"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("iv")).alias("iv"), F.col("y90").cast("double").alias("y90"))
    found = normalise.SitePreprocessing(("value", "unknown"), ("iv",), ("y90",)).run(panel, "icustayid", "bloc", "site")
    return found.select("icustayid", "site", F.round("value", 6).alias("value"), F.round("iv", 6).alias("iv"), "y90")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem")
def wanted_columns(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    there, _ = normalise.chosen_columns(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_colour", "l_tax"])
    return lines.select(*there)


D2 = vectors.D2.format


def _round_sql(i: int, shared: bool) -> str:
    """SQL of one round from centres cen{i - 1}: of all points, or of each site and then the plain mean over sites."""
    near = f"n{i} AS (SELECT id, site, x, k FROM (SELECT id, site, x, k, row_number() OVER (PARTITION BY id ORDER BY {D2(a='x', b='c')}, k) AS r FROM feat, cen{i - 1}) WHERE r = 1), d{i} AS (SELECT site, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM n{i})"
    if not shared:
        return f"{near}, m{i} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(v) AS m FROM d{i} GROUP BY k, i) GROUP BY k), cen{i} AS (SELECT o.k, coalesce(m{i}.c, o.c) AS c FROM cen{i - 1} o LEFT JOIN m{i} ON o.k = m{i}.k)"
    own = f"o{i} AS (SELECT site, k, list(m ORDER BY i) AS c FROM (SELECT site, k, i, avg(v) AS m FROM d{i} GROUP BY site, k, i) GROUP BY site, k), g{i} AS (SELECT o.k, unnest(coalesce(o{i}.c, o.c)) AS v, unnest(range(len(o.c))) AS i FROM (SELECT DISTINCT site FROM feat) s CROSS JOIN cen{i - 1} o LEFT JOIN o{i} ON o{i}.site = s.site AND o{i}.k = o.k)"
    return f"{near}, {own}, cen{i} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(v) AS m FROM g{i} GROUP BY k, i) GROUP BY k)"


def _rounds_sql(rounds: int, shared: bool) -> str:
    each = ", ".join(_round_sql(i, shared) for i in range(1, rounds + 1))
    return f"WITH {views.FEATURES}, {views.CENTRES}, cen0 AS (SELECT k, c FROM cen), {each} SELECT k, unnest(range(len(c))) AS i, round(unnest(c), 6) AS m FROM cen{rounds}"


@query(_rounds_sql(3, False))
def lloyd_3(spark, sf_dir):
    return vectors._long(federated.warm_lloyd(*vectors._both(spark, sf_dir), rounds=3, threshold=0.0)[0], "k")


@query(_rounds_sql(3, True))
def fed_lloyd_3(spark, sf_dir):
    return vectors._long(federated.federated_lloyd(*vectors._both(spark, sf_dir), rounds=3, threshold=0.0)[0], "k")


def _loop_sql(rounds: int = 20) -> str:
    """SQL of shared rounds until the mean change is under 1e-4: ``changes`` (round, change) and ``final``, the centres after the last of them."""
    each = ", ".join(_round_sql(i, True) for i in range(1, rounds + 1))
    gaps = " UNION ALL ".join(f"SELECT {i} AS round, avg(abs(a - b)) AS change FROM (SELECT unnest(n.c) AS a, unnest(o.c) AS b FROM cen{i} n JOIN cen{i - 1} o ON n.k = o.k)" for i in range(1, rounds + 1))
    held = " UNION ALL ".join(f"SELECT {i} AS round, k, c FROM cen{i}" for i in range(1, rounds + 1))
    return f"""WITH {views.FEATURES}, {views.CENTRES}, cen0 AS (SELECT k, c FROM cen), {each.replace(' AS (SELECT k, list', ' AS MATERIALIZED (SELECT k, list')}, gaps AS MATERIALIZED ({gaps}),
        stop AS (SELECT coalesce(min(round) FILTER (change < 1e-4), {rounds}) AS final_round FROM gaps), changes AS (SELECT round, change FROM gaps, stop WHERE round <= final_round), final AS (SELECT k, c FROM ({held}) h, stop WHERE round = final_round)"""


@query(f"{_loop_sql()} SELECT k, unnest(range(len(c))) AS i, round(unnest(c), 6) AS m FROM final")
def fed_lloyd_loop(spark, sf_dir):
    """Twenty rounds at most, until the mean change is under 1e-4."""
    return vectors._long(federated.federated_lloyd(*vectors._both(spark, sf_dir))[0], "k")


def _matched_sql(rounds: int = 5) -> str:
    """SQL of shared Lloyd rounds with their norms; in these tables no centre changes places with another, so the match is by position."""
    each = ", ".join(_round_sql(i, False) for i in range(1, rounds + 1))
    gaps = " UNION ALL ".join(f"SELECT {i} AS round, k, sqrt(sum((a - b) * (a - b)) OVER ()) AS norm, a, i FROM (SELECT n.k, unnest(n.c) AS a, unnest(o.c) AS b, unnest(range(len(n.c))) AS i FROM cen{i} n JOIN cen{i - 1} o ON n.k = o.k)" for i in range(1, rounds + 1))
    return f"WITH {views.FEATURES}, {views.CENTRES}, cen0 AS (SELECT k, c FROM cen), {each}, gaps AS ({gaps}) SELECT CAST(round AS BIGINT) AS round, round(any_value(norm), 6) AS norm, k, round(sum(a), 6) AS total FROM gaps GROUP BY round, k"


@query(_matched_sql())
def fed_matched_loop(spark, sf_dir):
    """Five stored rounds with matching: the norm of each, and the sum of each centre's coordinates."""
    points, centres = vectors._both(spark, sf_dir)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"
    rounds = federated.matched_loop(points, centres, path, 5, 0.0)
    return rounds.select("round", F.round("norm", 6).alias("norm"), "k", F.round(F.aggregate("c", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"{_loop_sql()} SELECT CAST(round AS BIGINT) AS round, round(change, 6) AS change FROM changes")
def fed_convergence(spark, sf_dir):
    """The change of each round, as a series."""
    changes = federated.federated_lloyd(*vectors._both(spark, sf_dir))[1]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(changes, 1)], "round long, change double").withColumn("change", F.round("change", 6))


STARTS, UPLOADED = 10, 20  # starts a site; rounds of the SQL, after which every start has settled


def _uploads(spark, sf_dir):
    """Ten centres a site by k-means, the best of ten starts: start r are the site's points of places 10 r to 10 r + 9 by id, whatever the ids are."""
    points = views.features(spark, sf_dir).checkpoint()
    first = points.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("id"))).where(F.col("place") <= 10 * STARTS)  # cut in each task first
    place = (F.col("place") - 1).cast("long")
    starts = first.select("site", F.floor(place / 10).alias("start"), (place % 10).alias("k"), F.col("x").alias("c"))
    return points, federated.site_lloyd(points, starts, threshold=1e-12).checkpoint()


def _uploads_sql() -> str:
    """SQL of the same: all starts of all sites for UPLOADED rounds, and the start of the least inertia."""
    each = []
    for i in range(1, UPLOADED + 1):  # key: 10000 site + 100 start + k
        near = f"n{i} AS MATERIALIZED (SELECT x, key, d FROM (SELECT f.id, f.x, o.key, {D2(a='x', b='c')} AS d FROM feat f JOIN c{i - 1} o ON f.site = o.key // 10000) QUALIFY row_number() OVER (PARTITION BY id, key // 100 ORDER BY d, key) = 1)"
        sums = f"m{i} AS MATERIALIZED (SELECT key, list(v ORDER BY i) AS moved FROM (SELECT key, i, avg(v) AS v FROM (SELECT key, unnest(x) AS v, unnest(range(len(x))) AS i FROM n{i}) GROUP BY key, i) GROUP BY key)"
        each.append(f"{near}, {sums}, c{i} AS MATERIALIZED (SELECT key, coalesce(moved, c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (key))")
    return f"""WITH {views.FEATURES}, placed AS MATERIALIZED (SELECT site, x, row_number() OVER (PARTITION BY site ORDER BY id) AS place FROM feat),
        c0 AS MATERIALIZED (SELECT 10000 * site + 100 * ((place - 1) // 10) + (place - 1) % 10 AS key, x AS c FROM placed WHERE place <= {10 * STARTS}), {', '.join(each)},
        sizes AS MATERIALIZED (SELECT key, count(*) AS n, sum(d) AS inertia FROM n{UPLOADED} GROUP BY key), costs AS (SELECT key // 100 AS start, sum(inertia) AS cost FROM sizes GROUP BY 1),
        best AS MATERIALIZED (SELECT start FROM costs QUALIFY row_number() OVER (PARTITION BY start // 100 ORDER BY round(cost, 6), start) = 1),
        uploads AS (SELECT key // 10000 AS site, key % 100 AS k, c, coalesce(n, 0) AS n, coalesce(inertia, 0) AS inertia FROM c{UPLOADED} LEFT JOIN sizes USING (key) WHERE key // 100 IN (FROM best))"""


@query(f"{_uploads_sql()} SELECT site, k, n, round(inertia, 4) AS inertia, len(c) AS dims FROM uploads")
def fed_uploads(spark, sf_dir):
    """Each site's centres, with sizes and inertia."""
    return _uploads(spark, sf_dir)[1].select("site", "k", "n", F.round("inertia", 4).alias("inertia"), F.size("c").cast("long").alias("dims"))


@query(f"{_uploads_sql()} SELECT site, CAST(sum(n) AS BIGINT) AS n_samples, max(len(c)) AS n_features, count(*) AS n_clusters, round(sum(inertia), 4) AS inertia FROM uploads GROUP BY site")
def fed_upload_summary(spark, sf_dir):
    return federated.upload_summary(_uploads(spark, sf_dir)[1]).withColumn("inertia", F.round("inertia", 4))


@query()
def fed_unequal_mean(spark, sf_dir):
    """Sites with 10, 9 and 8 centres, matched with the first site's and weighted by their rows."""
    _, uploads = _uploads(spark, sf_dir)
    weights = uploads.groupBy("site").agg(F.sum("n").cast("double").alias("weight"))
    return vectors._long(federated.unequal_mean(uploads.where(F.col("k") < 11 - F.col("site")), weights, 10), "k")


@query()
def fed_site_groups(spark, sf_dir):
    return federated.site_groups(_uploads(spark, sf_dir)[1])


@query(f"WITH {vectors.BASE}, {vectors.DIMS}, m AS (SELECT k, i, avg(v) AS m FROM dims GROUP BY k, i) SELECT count(DISTINCT k) AS clusters, CAST(count(*) / count(DISTINCT k) AS BIGINT) AS dims, round(min(m), 6) AS low, round(max(m), 6) AS high, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, round(sum(m), 5) AS total FROM m")
def fed_statistics(spark, sf_dir):
    found = federated.centre_statistics(clusters.lloyd(*vectors._both(spark, sf_dir)))
    return found.select("clusters", "dims", *[F.round(c, 5 if c == "total" else 6).alias(c) for c in ("low", "high", "mean", "sd", "total")])


def _methods(spark, sf_dir):
    points, uploads = _uploads(spark, sf_dir)
    from cohortflow.operators import alignment

    start = federated.size_weighted(uploads).checkpoint()
    return points, uploads, {"mean by sizes": start, "aligned": alignment.aligned_mean(uploads.select("site", "k", "n", "c")).checkpoint(), "iterated": federated.federated_lloyd(points, start)[0]}


@query()
def fed_methods(spark, sf_dir):
    """Every method's inertia over the sites' own, by site and in all."""
    points, uploads, methods = _methods(spark, sf_dir)
    return federated.method_ratios(points, methods, uploads).withColumn("ratio", F.round("ratio", 6))


@query()
def fed_best_method(spark, sf_dir):
    points, uploads, methods = _methods(spark, sf_dir)
    return federated.best_method(federated.method_ratios(points, methods, uploads).checkpoint()).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query()
def fed_swarm(spark, sf_dir):
    _, uploads = _uploads(spark, sf_dir)
    weights = uploads.groupBy("site").agg(F.sum("n").cast("double").alias("weight"))
    return vectors._long(federated.swarm(uploads, weights)[0], "k")


_SIZES = f"WITH {vectors.BASE}"


@query(f"{_SIZES}, s AS (SELECT k, count(*) AS n FROM near GROUP BY k) SELECT CAST(floor(n / 10) AS BIGINT) AS bin, count(*) AS clusters FROM s GROUP BY 1")
def cluster_size_histogram(spark, sf_dir):
    sizes = clusters.nearest(*vectors._both(spark, sf_dir)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.floor(F.col("n") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("clusters"))


@query(f"{_SIZES} SELECT k, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean_distance, round(max(sqrt(d2)), 6) AS radius, round(sum(d2), 4) AS inertia, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM near GROUP BY k")
def cluster_statistics(spark, sf_dir):
    near = clusters.nearest(*vectors._both(spark, sf_dir))
    d = F.sqrt("d2")
    stats = near.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean_distance"), F.round(F.max(d), 6).alias("radius"), F.round(F.sum("d2"), 4).alias("inertia"))
    whole = stats.agg(F.sum("n").alias("all_n"))
    return stats.crossJoin(F.broadcast(whole)).select("k", "n", "mean_distance", "radius", "inertia", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


@query()
def choose_k_elbow(spark, sf_dir):
    points = views.features(spark, sf_dir)
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return spark.createDataFrame([(models.clusters_by_elbow(points, n, d),)], "k long")


@query()
def choose_k_silhouette(spark, sf_dir):
    points = views.features(spark, sf_dir)
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return spark.createDataFrame(models.clusters_by_silhouette(points, n, d), "k long, score double").withColumn("score", F.round("score", 6))


@query("WITH s AS (SELECT unnest(range(3)) AS s) SELECT s, 0 AS a, 0 AS s2, 0.1::DOUBLE AS p FROM s UNION ALL SELECT s, 0, least(s + 1, 2), 0.9 FROM s UNION ALL SELECT s, 1, 0, 1.0 FROM s")
def forest_process(spark, sf_dir):
    probs, rewards = processes.forest(spark)
    processes.check(probs, rewards, 0.96)
    return probs


@query("SELECT CAST(s AS BIGINT) AS s, CAST(best AS BIGINT) AS best, v FROM (VALUES (0, 0, 5.93215488::DOUBLE), (1, 0, 9.38815488), (2, 0, 13.38815488)) t(s, best, v)")
def forest_solved(spark, sf_dir):
    return solvers.solved(*processes.forest(spark), "values", 0.96).select("s", "best", F.round("v", 8).alias("v")).distinct()


@query("SELECT CAST(s AS BIGINT) AS s, CAST(a AS BIGINT) AS a, 1.0::DOUBLE AS total FROM (SELECT unnest(range(20)) AS s), (SELECT unnest(range(3)) AS a)")
def random_process_sums(spark, sf_dir):
    probs, rewards = processes.random_process(spark, 20, 3, 0.4)
    processes.check(probs, rewards, 0.9)
    return probs.groupBy("s", "a").agg(F.round(F.sum("p"), 9).alias("total"))


_TD = f"""WITH {process.BASE}, g AS (SELECT unnest(range(100)) AS rep), dr AS (SELECT log.*, rep FROM log, g WHERE {_draw('''icustayid || '|' || rep || '|td|0' ''')} < 0.75), e AS (SELECT icustayid, max(bloc) AS last, min(bloc) AS first, sum(reward) AS final FROM log GROUP BY icustayid),
 r AS (SELECT dr.*, last, first, final FROM dr JOIN e USING (icustayid) WHERE action >= 0), mq AS (SELECT rep, state AS s, action AS a, avg(pow({process.GAMMA}, last - bloc - 1) * final) AS q FROM r WHERE bloc > first GROUP BY ALL), w AS (SELECT rep, mq.s AS state, sum(p * q) AS q FROM mq JOIN pib ON mq.s = pib.s AND mq.a = pib.a GROUP BY ALL),
 y AS (SELECT icustayid, max(y90) AS y90 FROM panel GROUP BY icustayid)"""


@query(f"{_TD} SELECT r.rep, y90, count(*) AS n, round(avg(w.q), 5) AS q FROM r JOIN w ON r.rep = w.rep AND r.state = w.state JOIN y ON r.icustayid = y.icustayid GROUP BY r.rep, y90")
def td_records(spark, sf_dir):
    """The log of (value, outcome, stay, repetition) over 100 repetitions, as means by outcome."""
    log = process._log(spark, sf_dir)
    outcomes = views.panel(spark, sf_dir).groupBy("icustayid").agg(F.max("y90").alias("y90"))
    means = search.record_means(log, outcomes, T.behaviour_policy(process._counts(log)), process.GAMMA)
    return means.select("rep", F.col("y90").cast("int").alias("y90"), "n", F.round("q", 5).alias("q"))


def _model_panel(spark, sf_dir):
    panel = T.with_actions(views.panel(spark, sf_dir))
    return normalise.normalised(panel.withColumn("bloc_z", F.col("bloc").cast("double")), [], ["value", "bloc_z"], ["iv", "vaso"])[0].checkpoint()


@query()
def model_row(spark, sf_dir):
    """One model of the search, with its evaluation on training and held-out stays: 750 states, 32 restarts, all bootstraps."""
    return search.model_search(_model_panel(spark, sf_dir), ["value", "bloc_z", "iv", "vaso"], 1, least=1)[0]


@query()
def foraged_features(spark, sf_dir):
    """A search for a feature subset: twenty bacteria, fifty rounds."""
    train, held = searches._split(spark, sf_dir)
    train, held = (df.select("id", "x", "label").checkpoint() for df in (train, held))
    chosen, curve = search.foraging(neighbours.population_judge(train, held, 64), 64)
    return spark.createDataFrame([(len(chosen), float(curve[0]), float(curve[-1]))], "chosen long, first double, last double")


@query()
def shap_importance(spark, sf_dir):
    """The ten dimensions whose Shapley values of a boosted model's margin are largest on average, over all rows."""
    points = views.features(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("double"))
    values = attributions.attributions(points, models.boosted(points))
    return attributions.mean_attributions(values, 64).orderBy(F.desc("importance"), "dim").limit(10).withColumn("importance", F.round("importance", 6))


@query()
def supervised_clusters(spark, sf_dir):
    """The ten features that tell most of a label, clustered by k-means, and how good the clusters are."""
    points = views.features(spark, sf_dir)
    top = [r["dim"] for r in models.top_importances(points.withColumn("label", (F.col("label") >= 5).cast("double")), 10).collect()]
    cut = points.withColumn("x", F.array(*[F.col("x")[i] for i in sorted(top)])).select("id", "x").checkpoint()
    centres, cost = models.kmeans_restarts(cut, 5, 10, 300)
    labelled = clusters.nearest(cut, centres).select("id", "x", F.col("k").alias("label")).checkpoint()
    scores = clusters.calinski_harabasz(labelled).select(F.col("score").alias("calinski_harabasz")).crossJoin(clusters.davies_bouldin(labelled).select(F.col("score").alias("davies_bouldin")))
    return scores.select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round(F.lit(cost), 3).alias("inertia"))


@query()
def selected_then_clustered(spark, sf_dir):
    """Per site: the features that tell most of the label, those common to all sites, and each site's k-means on them."""
    points = views.features(spark, sf_dir)
    chosen = [{r["dim"] for r in models.top_importances(points.where(F.col("site") == s).withColumn("label", (F.col("label") >= 5).cast("double")), 24).collect()} for s in (1, 2, 3)]
    common = sorted(set.intersection(*chosen)) or sorted(set.union(*chosen))
    cut = points.withColumn("x", F.array(*[F.col("x")[i] for i in common])).select("id", "site", "x").checkpoint()
    starts = cut.where("id < 15").select("site", (F.row_number().over(Window.partitionBy("site").orderBy("id")) - 1).cast("long").alias("k"), F.col("x").alias("c"))
    return federated.upload_summary(federated.site_lloyd(cut, starts)).withColumn("inertia", F.round("inertia", 4))
