"""Queries over diagnoses, severities, sites and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.functions import ranks
from cohortflow.operators import cohorts, comorbidity, normalise

from . import views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(expr: str, codes: str) -> str:
    return f"{expr} IN ({', '.join(repr(c) for c in codes.split())})"


def _flag_sql(name: str) -> str:
    full, four, three = comorbidity.CODES[name]
    tests = [_in(e, v) for e, v in (("icd9_code", full), ("substring(icd9_code, 1, 4)", four), ("substring(icd9_code, 1, 3)", three)) if v]
    return f"max(CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END) AS {name}"


def _view_sql(spec: tuple[str, ...]) -> str:
    if len(spec) == 1:
        return spec[0]
    a, how, b = spec
    return f"CASE WHEN {a} = 1 OR {b} = 1 THEN 1 ELSE 0 END" if how == "or" else f"CASE WHEN {b} = 1 THEN 0 WHEN {a} = 1 THEN 1 ELSE 0 END"


FLAGS = f"flags AS (SELECT hadm_id, {', '.join(map(_flag_sql, comorbidity.CODES))} FROM dx WHERE seq_num <> 1 GROUP BY hadm_id)"


@query(f"WITH {views.DIAGNOSES}, {FLAGS} SELECT o_orderkey AS hadm_id, {', '.join(f'{_view_sql(s)} AS {n}' for n, s in comorbidity.VIEW.items())} FROM orders LEFT JOIN flags ON o_orderkey = flags.hadm_id ORDER BY hadm_id")
def comorbidity_view(spark, sf_dir):
    return comorbidity.comorbidity_view(views.admissions(spark, sf_dir), views.diagnoses(spark, sf_dir)).orderBy("hadm_id")


@query(f"WITH {views.DIAGNOSES}, {FLAGS} SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in comorbidity.CODES)} FROM flags")
def comorbidity_prevalence(spark, sf_dir):
    found = comorbidity.secondary_flags(views.diagnoses(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in comorbidity.CODES])


_SCORES = """first AS (SELECT icustayid, value * 1.0 AS v FROM panel WHERE bloc = 1), m AS (SELECT icustayid, nullif(v / 20, 0) AS sofa, nullif(v / 50, 0) AS lactate, nullif(v, 0) AS pao2_fio2, nullif(v / 10, 0) AS gcs FROM first),
 p AS (SELECT icustayid, CASE WHEN sofa >= 10 THEN 3 WHEN sofa >= 5 THEN 2 WHEN sofa IS NOT NULL THEN 1 END AS a, CASE WHEN lactate > 4 THEN 3 WHEN lactate >= 2 THEN 2 WHEN lactate IS NOT NULL THEN 1 END AS b,
 CASE WHEN pao2_fio2 < 100 THEN 3 WHEN pao2_fio2 < 200 THEN 2 WHEN pao2_fio2 IS NOT NULL THEN 1 END AS c, CASE WHEN gcs <= 8 THEN 3 WHEN gcs <= 13 THEN 2 WHEN gcs IS NOT NULL THEN 1 END AS d FROM m),
 s AS (SELECT icustayid, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) * 1.0 / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) + CAST(d IS NOT NULL AS INT), 0) AS score FROM p)"""
_BAND = "CASE WHEN score IS NULL THEN 'Unknown' WHEN score < 1.5 THEN '1' WHEN score < 2.5 THEN '2' ELSE '3' END"


@query(f"WITH {views.PANEL}, {_SCORES} SELECT icustayid, round(CAST(score AS DOUBLE), 6) AS score, {_BAND} AS severity FROM s")
def severity_score(spark, sf_dir):
    first = cohorts.first_rows(views.panel(spark, sf_dir), "icustayid", "bloc")
    v = F.col("value")
    m = first.select("icustayid", (v / 20).alias("sofa"), (v / 50).alias("lactate"), v.alias("pao2_fio2"), (v / 10).alias("gcs"))
    score = cohorts.mean_of_present(*[cohorts.points(c, c) for c in ("sofa", "lactate", "pao2_fio2", "gcs")])
    return m.select("icustayid", F.round(score, 6).alias("score"), cohorts.severity_band(score).alias("severity"))


@query(f"WITH {views.PANEL}, {_SCORES} SELECT {_BAND} AS severity, count(*) AS n FROM s GROUP BY 1")
def severity_counts(spark, sf_dir):
    return severity_score(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.PANEL} SELECT event_id, CASE WHEN value / 3 > 90 OR value / 12 > 20 OR value / 2 < 90 AND value IS NOT NULL OR coalesce(regexp_matches(event_type, '(?i)yes|positive|true|1'), false) THEN 1 ELSE 0 END AS label FROM panel")
def rule_label(spark, sf_dir):
    v = F.col("value")
    m = views.panel(spark, sf_dir).select("event_id", (v / 3).alias("hr"), (v / 12).alias("rr"), (v / 2).alias("sbp"), F.col("event_type").alias("sepsis"))
    return m.select("event_id", cohorts.rule_label(m).alias("label"))


_RATIO = (5.5, 3.5, 1.0)


@query(f"""WITH {views.SEVERITY}, n AS (SELECT severity, count(*) AS n FROM sev GROUP BY severity), w(site, w) AS (VALUES (1, 5.5), (2, 3.5), (3, 1.0)),
 e AS (SELECT severity, site, n, CAST(n AS DOUBLE) * (CAST(w AS DOUBLE) / 10) AS x FROM n, w), r AS (SELECT *, floor(x) AS f, row_number() OVER (PARTITION BY severity ORDER BY x - floor(x) DESC, site DESC) AS k, n - sum(floor(x)) OVER (PARTITION BY severity) AS rest FROM e)
 SELECT severity, CAST(site AS BIGINT) AS site, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""")
def stratified_counts(spark, sf_dir):
    cohort = views.severity(spark, sf_dir)
    sizes = {r["severity"]: cohorts.apportion(r["count"], list(_RATIO)) for r in cohort.groupBy("severity").count().collect()}  # three severities
    sited = cohorts.assign_sites(cohort, sizes)
    return sited.groupBy("severity", F.col("site").cast("long").alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def id_intersection(spark, sf_dir):
    return views.admissions(spark, sf_dir).select(F.col("hadm_id").alias("id")).intersect(views.diagnoses(spark, sf_dir).select("hadm_id"))


_LISTS = f"""WITH {views.FEATURES}, v AS (SELECT site, unnest(x) AS v, unnest(range(len(x))) AS dim FROM feat), m AS (SELECT dim, avg(v) AS whole FROM v GROUP BY dim),
 l AS (SELECT site, dim FROM (SELECT site, dim, avg(v) AS own FROM v GROUP BY site, dim) JOIN m USING (dim) WHERE own > whole), l1 AS (SELECT dim FROM l WHERE site = 1), l2 AS (SELECT dim FROM l WHERE site = 2), l3 AS (SELECT dim FROM l WHERE site = 3)"""


@query(f"""{_LISTS} SELECT 'common' AS kind, NULL::BIGINT AS site, dim FROM (FROM l1 INTERSECT FROM l2 INTERSECT FROM l3) UNION ALL SELECT 'any', NULL, dim FROM (FROM l1 UNION FROM l2 UNION FROM l3)
 UNION ALL SELECT 'alone', 1, dim FROM (FROM l1 EXCEPT (FROM l2 UNION FROM l3)) UNION ALL SELECT 'alone', 2, dim FROM (FROM l2 EXCEPT (FROM l1 UNION FROM l3)) UNION ALL SELECT 'alone', 3, dim FROM (FROM l3 EXCEPT (FROM l1 UNION FROM l2))""")
def feature_set_ops(spark, sf_dir):
    """Each site's list of features (dimensions above the mean of all sites): what all lists share, what any holds, what one site alone lists."""
    rows = views.features(spark, sf_dir).select("site", F.posexplode("x").alias("dim", "v")).groupBy("site", "dim").agg(F.avg("v").alias("own"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("dim")
    lists = rows.withColumn("whole", F.sum("s").over(whole) / F.sum("n").over(whole)).where("own > whole")
    return cohorts.set_operations(lists.select("site", F.col("dim").cast("long").alias("dim")), "site", "dim", 3)


@query(f"WITH {views.PANEL} SELECT icustayid, bloc, iv, vaso, state FROM panel WHERE bloc = 1")
def first_bloc(spark, sf_dir):
    return cohorts.first_rows(views.panel(spark, sf_dir), "icustayid", "bloc").select("icustayid", "bloc", "iv", "vaso", "state")


@query(f"WITH {views.PANEL}, q AS (SELECT icustayid, bloc, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 3 <> 0 THEN event_type END AS t FROM panel) SELECT icustayid, arg_min(v, bloc) FILTER (WHERE v IS NOT NULL) AS v, arg_min(t, bloc) FILTER (WHERE t IS NOT NULL) AS t FROM q GROUP BY icustayid")
def first_nonnull_per_key(spark, sf_dir):
    q = views.panel(spark, sf_dir).select("icustayid", "bloc", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"))
    return q.groupBy("icustayid").agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("bloc", c)))[c].alias(c) for c in ("v", "t")])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _lines(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_NUM)


def _rounded(df, columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _z_sql(sd: str, expr: str = "{c}") -> str:
    return ", ".join(f"round(({expr.format(c=c)} - avg({expr.format(c=c)}) OVER ()) / {sd}({expr.format(c=c)}) OVER (), 6) AS {c}" for c in _NUM)


@query(f"SELECT {_KEYS}, {_z_sql('stddev_samp')} FROM lineitem")
def zscore_samp(spark, sf_dir):
    return _rounded(normalise.zscore(_lines(spark, sf_dir), _NUM), _NUM)


@query(f"SELECT {_KEYS}, {_z_sql('stddev_pop')} FROM lineitem")
def zscore_pop(spark, sf_dir):
    return _rounded(normalise.zscore(_lines(spark, sf_dir), _NUM, sample=False), _NUM)


@query(f"SELECT {_KEYS}, {_z_sql('stddev_samp', 'ln(0.1 + greatest({c}, 0.0))')} FROM lineitem")
def log_zscore(spark, sf_dir):
    return _rounded(normalise.zscore(_lines(spark, sf_dir).withColumns({c: normalise.log_shift(c) for c in _NUM}), _NUM), _NUM)


@query(f"WITH {views.PANEL} SELECT event_id, y90 - 0.5::DOUBLE AS y90 FROM panel")
def binary_shift(spark, sf_dir):
    return views.panel(spark, sf_dir).select("event_id", (F.col("y90") - F.lit(0.5).cast("double")).alias("y90"))


_HOLED = "g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber % 3 AS site, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS q, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS e FROM lineitem)"


def _holed(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("site"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")).alias("e"))


_IMPUTED = "i AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, site, coalesce(q, avg(q) OVER (PARTITION BY site)) AS q, coalesce(e, median(e) OVER (PARTITION BY site)) AS e FROM g)"


@query(f"WITH {_HOLED}, {_IMPUTED} SELECT {_KEYS}, site, round(q, 6) AS q, round(e, 6) AS e FROM i")
def site_impute(spark, sf_dir):
    return _rounded(normalise.impute(_holed(spark, sf_dir), ["q"], ["e"], ["site"]), ["q", "e"])


_CLIPPED = "c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, i.site, least(greatest(q, ql), qh) AS q, least(greatest(e, el), eh) AS e FROM i JOIN (SELECT site, quantile_cont(q, 0.01) AS ql, quantile_cont(q, 0.99) AS qh, quantile_cont(e, 0.01) AS el, quantile_cont(e, 0.99) AS eh FROM i GROUP BY site) b ON i.site = b.site)"


@query(f"WITH {_HOLED}, {_IMPUTED}, {_CLIPPED} SELECT {_KEYS}, site, round(q, 6) AS q, round(e, 6) AS e FROM c")
def winsorize(spark, sf_dir):
    filled = normalise.impute(_holed(spark, sf_dir), ["q"], ["e"], ["site"])
    return _rounded(normalise.winsorise(filled, ["q", "e"], by=["site"]), ["q", "e"])


@query(f"WITH {_HOLED}, {_IMPUTED}, {_CLIPPED}, l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, site, q, ln(0.1 + greatest(e, 0.0)) AS e FROM c) SELECT {_KEYS}, site, round((q - avg(q) OVER (PARTITION BY site)) / stddev_pop(q) OVER (PARTITION BY site), 6) AS q, round((e - avg(e) OVER (PARTITION BY site)) / stddev_pop(e) OVER (PARTITION BY site), 6) AS e FROM l")
def fed_preprocess(spark, sf_dir):
    return _rounded(normalise.site_preprocess(_holed(spark, sf_dir), ["q"], ["e"], [], ["site"]), ["q", "e"])


_TWICE = f"{_HOLED}, {_IMPUTED}, {_CLIPPED}, l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, site, q, ln(0.1 + greatest(e, 0.0)) AS e FROM c), z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, site, (q - avg(q) OVER w) / stddev_pop(q) OVER w AS q, ln(0.1 + greatest((e - avg(e) OVER w) / stddev_pop(e) OVER w, 0.0)) AS e FROM l WINDOW w AS (PARTITION BY site))"


@query(f"WITH {_TWICE} SELECT {_KEYS}, site, round((q - avg(q) OVER w) / stddev_pop(q) OVER w, 6) AS q, round((e - avg(e) OVER w) / stddev_pop(e) OVER w, 6) AS e FROM z WINDOW w AS (PARTITION BY site)")
def renormalize(spark, sf_dir):
    once = normalise.site_preprocess(_holed(spark, sf_dir), ["q"], ["e"], [], ["site"])
    return _rounded(normalise.renormalise(once, ["e"], ["q", "e"], ["site"]), ["q", "e"])


@query()
def biased_counts(spark, sf_dir):
    cohort = views.severity(spark, sf_dir)
    counts = {r["severity"]: r["count"] for r in cohort.groupBy("severity").count().collect()}  # three severities
    room, sizes = cohorts.apportion(sum(counts.values()), [4, 3, 3]), {}
    for severity, weights in (("3", [6, 3, 1]), ("1", [1, 3, 6]), ("2", [4, 3, 3])):
        sizes[severity] = cohorts.allocate_within(counts.get(severity, 0), weights, room)
        room = [r - n for r, n in zip(room, sizes[severity])]
    return cohorts.assign_sites(cohort, sizes).groupBy("severity", F.col("site").cast("long").alias("site")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(spark, sf_dir):
    return normalise.correlations(_lines(spark, sf_dir), _NUM).withColumn("r", F.round("r", 6))


@query("SELECT DISTINCT b AS name FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) > 0.003")
def corr_prune(spark, sf_dir):
    return normalise.correlated_columns(_lines(spark, sf_dir), _NUM, 0.003)


@query("""WITH c AS (SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), s AS (SELECT CAST(coalesce(sum(n) FILTER (label = 1 AND predicted = 1), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (label = 0 AND predicted = 1), 0) AS DOUBLE) AS fp, CAST(coalesce(sum(n) FILTER (label = 1 AND predicted = 0), 0) AS DOUBLE) AS fn, CAST(coalesce(sum(n) FILTER (label = 0 AND predicted = 0), 0) AS DOUBLE) AS tn FROM c)
 SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_1, round(tp / nullif(tp + fn, 0), 6) AS recall_1, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""")
def confusion_metrics(spark, sf_dir):
    c = views.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    of = lambda y, p: F.count(F.when((F.col("quality") == y) & (F.col("toxic") == p), 1)).cast("double")
    s = c.agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return s.select("tp", "fp", "fn", "tn", F.round(F.try_divide(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision_1"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall_1"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


@query("WITH d AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT x, sum(y) AS p, count(*) - sum(y) AS q FROM d GROUP BY x), r AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(CAST(sum(p * (below + q / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS DOUBLE), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(views.table(spark, sf_dir, "labels"), "doc_id")
    c = d.groupBy("n_chars").agg(F.sum("quality").alias("p"), (F.count(F.lit(1)) - F.sum("quality")).alias("q"))
    below = ranks.running(c, "n_chars", "q")
    return below.agg(F.round(F.sum(F.col("p") * (F.col("before") + F.col("q") / 2)) / (F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"))
