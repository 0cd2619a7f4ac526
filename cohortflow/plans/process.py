"""Queries over trajectories: actions, the empirical decision process, its solution and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.functions import ranks, scalars
from cohortflow.operators import trajectories as T

from . import views

QUERIES, SQL = {}, {}
LEAST, GAMMA = 2, 0.99


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bin_sql(dose: str, test: str) -> str:
    return f"(SELECT event_id, CAST(floor(((rank() OVER (ORDER BY {dose}) + (count(*) OVER (PARTITION BY {dose}) - 1) / 2.0) / count(*) OVER () + 0.2499999999) * 4) + 1 AS BIGINT) AS b FROM panel WHERE {dose} {test} 0)"


BINS = f"bins AS (SELECT p.*, coalesce(x.b, 1) AS io, coalesce(y.b, 1) AS vc FROM panel p LEFT JOIN {_bin_sql('iv', '>')} x ON p.event_id = x.event_id LEFT JOIN {_bin_sql('vaso', '<>')} y ON p.event_id = y.event_id)"
ACTS = "acts AS (SELECT *, dense_rank() OVER (ORDER BY io, vc) - 1 AS action FROM bins)"
LOG = "log AS (SELECT icustayid, bloc, state, action, 0.0::DOUBLE AS reward FROM acts UNION ALL SELECT icustayid, max(bloc) + 1, CASE WHEN max(y90) = 1 THEN 750 ELSE 751 END, -1, CASE WHEN max(y90) = 1 THEN -100.0 ELSE 100.0 END FROM acts GROUP BY icustayid)"
COUNTS = f"cnt AS (SELECT s, a, s2, count(*) AS n FROM (SELECT state AS s, action AS a, lead(state) OVER (PARTITION BY icustayid ORDER BY bloc) AS s2 FROM log) WHERE a >= 0 AND s2 IS NOT NULL GROUP BY s, a, s2 HAVING count(*) > {LEAST})"
PROBS = "pr AS (SELECT s, a, s2, n, n / CAST(sum(n) OVER (PARTITION BY s, a) AS DOUBLE) AS p FROM cnt)"
PIB = "pib AS (SELECT s, a, CAST(sum(n) AS DOUBLE) / CAST(sum(sum(n)) OVER (PARTITION BY s) AS DOUBLE) AS p FROM cnt GROUP BY s, a)"
REW = "rew AS (SELECT s, a, sum(p * CASE WHEN s2 = 751 THEN 100.0 WHEN s2 = 750 THEN -100.0 ELSE 0.0 END) AS r FROM pr GROUP BY s, a)"
BASE = f"{views.PANEL}, {BINS}, {ACTS}, {LOG}, {COUNTS}, {PROBS}, {PIB}, {REW}"


def _sweep_sql(i: int) -> str:
    q = "SELECT s, a, r AS q FROM rew" if i == 1 else f"SELECT rew.s, rew.a, r + {GAMMA} * coalesce(x.v, 0) AS q FROM rew LEFT JOIN (SELECT pr.s, a, sum(p * coalesce(v, 0)) AS v FROM pr LEFT JOIN v{i - 1} ON pr.s2 = v{i - 1}.s GROUP BY pr.s, a) x ON rew.s = x.s AND rew.a = x.a"
    return f"q{i} AS ({q}), v{i} AS (SELECT s, max(q) AS v FROM q{i} GROUP BY s)"


SWEEPS = ", ".join(_sweep_sql(i) for i in (1, 2, 3))
BEST = "best AS (SELECT q3.s, min(a) AS best FROM q3 JOIN v3 ON q3.s = v3.s AND q = v GROUP BY q3.s)"
N_ACTIONS = 25
SOFT_B = f"sb AS (SELECT u.s, g.a, CASE WHEN coalesce(pib.p, 0) > 0 THEN pib.p - 0.01 / used ELSE 0.01 / nullif({N_ACTIONS} - used, 0) END AS p FROM (SELECT s, count(*) AS used FROM pib GROUP BY s) u CROSS JOIN (SELECT unnest(range({N_ACTIONS})) AS a) g LEFT JOIN pib ON pib.s = u.s AND pib.a = g.a)"
SOFT_E = f"se AS (SELECT s, g.a, CASE WHEN g.a = best THEN 0.99::DOUBLE ELSE 0.01::DOUBLE / {N_ACTIONS - 1} END AS p FROM best CROSS JOIN (SELECT unnest(range({N_ACTIONS})) AS a) g)"
RHO = f"""st AS (SELECT *, row_number() OVER (PARTITION BY icustayid ORDER BY bloc) - 1 AS t FROM log),
 rho AS (SELECT icustayid, CASE WHEN sum(CASE WHEN action >= 0 AND (sb.p IS NULL OR sb.p <= 0 OR se.p IS NULL) THEN 1 ELSE 0 END) = 0 THEN exp(sum(CASE WHEN action >= 0 AND sb.p > 0 THEN ln(se.p / sb.p) END)) END AS rho,
 sum(CASE WHEN t > 0 THEN pow({GAMMA}, t - 1) * reward END) AS g FROM st LEFT JOIN sb ON state = sb.s AND action = sb.a LEFT JOIN se ON state = se.s AND action = se.a GROUP BY icustayid)"""
ALL = f"{BASE}, {SWEEPS}, {BEST}, {SOFT_B}, {SOFT_E}, {RHO}"


def _acts(spark, sf_dir):
    return T.with_actions(views.panel(spark, sf_dir))


def _log(spark, sf_dir):
    """The log, written once below spark.checkpoint.dir, so that what is derived from it doesn't build it again."""
    return T.trajectory_log(_acts(spark, sf_dir)).checkpoint()


def _counts(log):
    return T.transition_counts(log, LEAST).checkpoint()


def _process(counts):
    probs = T.transition_probs(counts)
    return probs, T.reward_matrix(probs)


def _solved(counts):
    return T.value_iteration(*_process(counts), GAMMA, 3)


def _policies(counts):
    return T.softened(T.behaviour_policy(counts), N_ACTIONS), T.greedy_softened(_solved(counts).select("s", "best"), N_ACTIONS)


@query(f"WITH {views.PANEL}, {BINS} SELECT event_id, io FROM bins")
def iv_bins(spark, sf_dir):
    return T.dose_bins(views.panel(spark, sf_dir), "iv", "io", True).select("event_id", "io")


@query(f"WITH {views.PANEL}, {BINS} SELECT event_id, vc FROM bins")
def vaso_bins(spark, sf_dir):
    return T.dose_bins(views.panel(spark, sf_dir), "vaso", "vc", False).select("event_id", "vc")


@query(f"WITH {views.PANEL}, {BINS}, {ACTS} SELECT event_id, io, vc, action FROM acts")
def action_ids(spark, sf_dir):
    return _acts(spark, sf_dir).select("event_id", "io", "vc", "action")


@query(f"WITH {views.PANEL}, {BINS}, {ACTS} SELECT action, io, vc, round(median(iv), 6) AS iv_median, round(median(vaso), 6) AS vaso_median, count(*) AS n FROM acts GROUP BY action, io, vc")
def bin_medians(spark, sf_dir):
    acts, key = _acts(spark, sf_dir).select("action", "io", "vc", "iv", "vaso").checkpoint(), ["action", "io", "vc"]
    medians = ranks.column_quantiles(acts, ["iv", "vaso"], {"median": 0.5}, key)
    return acts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(medians, key).select(*key, F.round("median_iv", 6).alias("iv_median"), F.round("median_vaso", 6).alias("vaso_median"), "n")


@query(f"WITH {BASE} SELECT icustayid, bloc, state, action, reward FROM log")
def trajectory_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"WITH {BASE} SELECT icustayid, bloc, state, reward FROM log WHERE action = -1")
def terminal_rows(spark, sf_dir):
    return _log(spark, sf_dir).where("action = -1").select("icustayid", "bloc", "state", "reward")


@query(f"WITH {BASE} SELECT s, a, s2, n FROM cnt")
def transition_counts(spark, sf_dir):
    return _counts(_log(spark, sf_dir))


@query(f"WITH {BASE} SELECT s, a, s2, round(p, 6) AS p FROM pr")
def transition_probs(spark, sf_dir):
    return T.transition_probs(_counts(_log(spark, sf_dir))).select("s", "a", "s2", F.round("p", 6).alias("p"))


@query(f"WITH {BASE} SELECT s, a, round(p, 6) AS p FROM pib")
def behaviour_policy(spark, sf_dir):
    return T.behaviour_policy(_counts(_log(spark, sf_dir))).withColumn("p", F.round("p", 6))


@query(f"WITH {BASE} SELECT s, a, round(r, 6) AS r FROM rew")
def reward_matrix(spark, sf_dir):
    return _process(_counts(_log(spark, sf_dir)))[1].withColumn("r", F.round("r", 6))


@query(f"WITH {BASE} SELECT count(*) AS pairs, count(*) FILTER (abs(t - 1) > 1e-9) AS not_stochastic, coalesce(sum(neg), 0)::BIGINT AS negative FROM (SELECT s, a, sum(p) AS t, sum(CASE WHEN p < 0 THEN 1 ELSE 0 END) AS neg FROM pr GROUP BY s, a)")
def mdp_validate(spark, sf_dir):
    sums = _process(_counts(_log(spark, sf_dir)))[0].groupBy("s", "a").agg(F.sum("p").alias("t"), F.count(F.when(F.col("p") < 0, 1)).alias("neg"))
    return sums.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.abs(F.col("t") - 1) > 1e-9, 1)).alias("not_stochastic"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negative"))


@query(f"WITH {BASE}, {SWEEPS} SELECT s, a, round(q, 6) AS q FROM q2")
def bellman_1(spark, sf_dir):
    probs, rewards = _process(_counts(_log(spark, sf_dir)))
    return T.q_values(probs, rewards, T.greedy(T.q_values(probs, rewards, None, GAMMA)), GAMMA).withColumn("q", F.round("q", 6))


@query(f"WITH {BASE}, {SWEEPS} SELECT s, round(v, 6) AS v FROM v3")
def value_iter_3(spark, sf_dir):
    return _solved(_counts(_log(spark, sf_dir))).select("s", F.round("v", 6).alias("v"))


@query(f"WITH {BASE}, {SWEEPS} SELECT 1 AS steps_left, s, round(v, 6) AS v FROM v1 UNION ALL SELECT 2, s, round(v, 6) FROM v2 UNION ALL SELECT 3, s, round(v, 6) FROM v3")
def finite_horizon_3(spark, sf_dir):
    probs, rewards = _process(_counts(_log(spark, sf_dir)))
    out, found = None, None
    for i in (1, 2, 3):
        found = T.greedy(T.q_values(probs, rewards, found, GAMMA))
        part = found.select(F.lit(i).alias("steps_left"), "s", F.round("v", 6).alias("v"))
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {BASE}, {SWEEPS}, {BEST} SELECT s, best FROM best")
def greedy_policy(spark, sf_dir):
    return _solved(_counts(_log(spark, sf_dir))).select("s", "best")


@query(f"WITH {ALL} SELECT sb.s, sb.a, round(sb.p, 6) AS pi_b, round(se.p, 6) AS pi_e FROM sb JOIN se ON sb.s = se.s AND sb.a = se.a")
def softened_policies(spark, sf_dir):
    b, e = _policies(_counts(_log(spark, sf_dir)))
    return b.withColumnRenamed("p", "pi_b").join(e.withColumnRenamed("p", "pi_e"), ["s", "a"]).select("s", "a", F.round("pi_b", 6).alias("pi_b"), F.round("pi_e", 6).alias("pi_e"))


@query(f"WITH {ALL} SELECT icustayid, bloc, state, action, round(sb.p, 6) AS pi_b, round(se.p, 6) AS pi_e FROM log LEFT JOIN sb ON state = sb.s AND action = sb.a LEFT JOIN se ON state = se.s AND action = se.a")
def log_with_policies(spark, sf_dir):
    log = _log(spark, sf_dir)
    b, e = (x.select(F.col("s").alias("state"), F.col("a").alias("action"), F.round("p", 6).alias(n)) for x, n in zip(_policies(_counts(log)), ("pi_b", "pi_e")))
    return log.join(b, ["state", "action"], "left").join(e, ["state", "action"], "left").select("icustayid", "bloc", "state", "action", "pi_b", "pi_e")


def _returns(spark, sf_dir):
    log = _log(spark, sf_dir)
    return T.returns(log, *_policies(_counts(log)), GAMMA).checkpoint()


@query(f"WITH {ALL} SELECT icustayid, round(ln(rho), 5) AS ln_rho, round(g, 5) AS g FROM rho")
def traj_rho_return(spark, sf_dir):
    return _returns(spark, sf_dir).select("icustayid", F.round(F.ln("rho"), 5).alias("ln_rho"), F.round("g", 5).alias("g"))


@query(f"WITH {ALL} SELECT round(sum(rho * g) / nullif(sum(rho), 0), 4) AS wis FROM rho")
def wis_full(spark, sf_dir):
    rows = _returns(spark, sf_dir)
    return rows.agg(F.round(T.weighted_importance(rows), 4).alias("wis"))


BOOTS = 750  # of the training rows; 2,000 of the held-out ones, in model_row


@query(f"WITH {ALL}, b AS (SELECT unnest(range({BOOTS})) AS boot), d AS (SELECT boot, rho, g FROM rho, b WHERE rho IS NOT NULL AND CAST('0x' || substr(md5(icustayid || '|' || boot || '|0'), 1, 8) AS BIGINT) / 4294967296.0 < 0.75) SELECT b.boot, round(sum(rho * g) / nullif(sum(rho), 0), 4) AS wis FROM b LEFT JOIN d ON b.boot = d.boot GROUP BY b.boot")
def wis_boot(spark, sf_dir):
    return T.bootstrap_wis(_returns(spark, sf_dir), BOOTS, 0.75).withColumn("wis", F.round("wis", 4))


MCQ = f"mcq AS (SELECT state AS s, action AS a, avg(pow({GAMMA}, last - bloc - 1) * final) AS q FROM (SELECT *, row_number() OVER (PARTITION BY icustayid ORDER BY bloc) AS t, max(bloc) OVER (PARTITION BY icustayid) AS last, sum(reward) OVER (PARTITION BY icustayid) AS final FROM log) WHERE action >= 0 AND t > 1 GROUP BY state, action)"


@query(f"WITH {BASE}, {MCQ} SELECT s, a, round(q, 6) AS q FROM mcq")
def mc_q(spark, sf_dir):
    return T.monte_carlo_q(_log(spark, sf_dir), GAMMA).withColumn("q", F.round("q", 6))


@query(f"WITH {BASE}, {MCQ}, vv AS (SELECT pib.s, sum(p * q) AS v FROM pib JOIN mcq ON pib.s = mcq.s AND pib.a = mcq.a GROUP BY pib.s), d0 AS (SELECT state AS s, count(*) AS n FROM log WHERE bloc = 1 GROUP BY state) SELECT round(sum(n * v) / sum(n), 6) AS td_value FROM d0 LEFT JOIN vv ON d0.s = vv.s")
def td_value(spark, sf_dir):
    log = _log(spark, sf_dir)
    return T.value_of_policy(T.monte_carlo_q(log, GAMMA), T.behaviour_policy(_counts(log)), log).withColumn("td_value", F.round("td_value", 6))


def _hazen_sql(q: float) -> str:
    return f"CASE WHEN n = 1 THEN v[1] ELSE v[k{int(q * 100)}] + greatest(0.0, least(n * {q} + 0.5 - k{int(q * 100)}, 1.0)) * (v[k{int(q * 100)} + 1] - v[k{int(q * 100)}]) END"


@query("WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type), k AS (SELECT *, " + ", ".join(f"greatest(1, least(CAST(floor(n * {q} + 0.5) AS BIGINT), n - 1)) AS k{int(q * 100)}" for q in (0.05, 0.5, 0.95)) + " FROM g) SELECT event_type, " + ", ".join(f"round({_hazen_sql(q)}, 6) AS q{int(q * 100)}" for q in (0.05, 0.5, 0.95)) + " FROM k")
def boot_quantiles(spark, sf_dir):
    found = ranks.quantiles(views.table(spark, sf_dir, "events"), "value", {f"q{int(q * 100)}": q for q in (0.05, 0.5, 0.95)}, ["event_type"], ranks.hazen)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(f"WITH {views.PANEL} SELECT icustayid, bloc, greatest(0.0, max(value - 50) OVER (PARTITION BY icustayid ORDER BY bloc)) AS top FROM panel")
def running_max(spark, sf_dir):
    w = Window.partitionBy("icustayid").orderBy("bloc").rowsBetween(Window.unboundedPreceding, 0)
    return views.panel(spark, sf_dir).select("icustayid", "bloc", F.greatest(F.lit(0.0), F.max(F.col("value") - 50).over(w)).alias("top"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type) SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM events JOIN q USING (event_type) GROUP BY event_type, q1, q2, q3")
def boxplot_stats(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_type", "value")
    q = ranks.quantiles(e, "value", {f"q{i}": i / 4 for i in (1, 2, 3)}, ["event_type"])
    span = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    whiskers = e.join(q, "event_type").groupBy("event_type", "q1", "q2", "q3").agg(F.min(F.when(v >= F.col("q1") - span, v)).alias("low"), F.max(F.when(v <= F.col("q3") + span, v)).alias("high"))
    return whiskers.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3", "low", "high")])


@query(f"WITH {views.PANEL}, b AS (SELECT CAST(least(99, greatest(0, floor((value - 100 + 100) / 2))) AS BIGINT) AS bin, value - 100 AS q, y90 FROM panel) SELECT g.bin, count(y90) AS n, round(avg(y90), 6) AS mean, round(stddev_pop(y90) / sqrt(nullif(count(y90), 0)), 6) AS sem, round(avg(q), 6) AS mean_q FROM (SELECT unnest(range(100)) AS bin) g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin")
def calibration_bins(spark, sf_dir):
    bin_ = F.least(F.lit(99), F.greatest(F.lit(0), F.floor(F.col("value") / 2)))
    b = views.panel(spark, sf_dir).select(bin_.cast("long").alias("bin"), (F.col("value") - 100).alias("q"), "y90")
    s = b.groupBy("bin").agg(F.count("y90").alias("n"), F.round(F.avg("y90"), 6).alias("mean"), F.round(F.stddev_pop("y90") / F.sqrt(F.count("y90")), 6).alias("sem"), F.round(F.avg("q"), 6).alias("mean_q"))
    return spark.range(100).withColumnRenamed("id", "bin").join(F.broadcast(s), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean", "sem", "mean_q")


@query(f"""WITH {views.PANEL}, m AS (SELECT icustayid, max(y90) AS y90, 2 * avg(value) - 100 AS v FROM panel GROUP BY icustayid), n AS (SELECT y90, count(*) AS all_n FROM m GROUP BY y90),
 h AS (SELECT y90, CASE WHEN v = 100 THEN 39 ELSE CAST(floor((v + 100) / 5) AS BIGINT) END AS bin, count(*) AS n FROM m WHERE v BETWEEN -100 AND 100 GROUP BY 1, 2)
 SELECT n.y90, g.bin, -100.0::DOUBLE + 5 * g.bin AS low, coalesce(h.n, 0) AS n, round(coalesce(h.n, 0) / CAST(all_n AS DOUBLE), 6) AS share FROM n CROSS JOIN (SELECT unnest(range(40)) AS bin) g LEFT JOIN h ON h.y90 = n.y90 AND h.bin = g.bin""")
def outcome_hist(spark, sf_dir):
    """By outcome: 40 bins between the edges -100 and 100, the last closed on both sides, as shares of all stays of the outcome. Means are exact, so a stay on an edge
    falls in the same bin however its rows are dealt."""
    m = views.panel(spark, sf_dir).groupBy("icustayid").agg(F.max("y90").alias("y90"), (2 * scalars.exact_mean(F.col("value")) - 100).alias("v"))
    return T.histogram(m, "v", ["y90"], -100.0, 100.0, 40).select("y90", "bin", "low", "n", F.round("share", 6).alias("share"))


@query(f"""WITH {views.PANEL}, q AS (SELECT icustayid, bloc, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM panel), w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN bloc END IGNORE NULLS) OVER a AS b0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN bloc END IGNORE NULLS) OVER z AS b1, first_value(v IGNORE NULLS) OVER z AS v1 FROM q WINDOW a AS (PARTITION BY icustayid ORDER BY bloc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY icustayid ORDER BY bloc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT icustayid, bloc, round(CASE WHEN v IS NOT NULL THEN v WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN v0 + (v1 - v0) * (bloc - b0) / (b1 - b0) END, 6) AS v FROM w""")
def gap_fill(spark, sf_dir):
    q = views.panel(spark, sf_dir).select("icustayid", "bloc", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    w = Window.partitionBy("icustayid").orderBy("bloc")
    known = F.when(F.col("v").isNotNull(), F.struct("bloc", "v"))
    q = q.withColumns({"lo": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.try_divide(F.col("bloc") - F.col("lo.bloc"), F.col("hi.bloc") - F.col("lo.bloc"))
    return q.select("icustayid", "bloc", F.round(F.coalesce("v", line), 6).alias("v"))
