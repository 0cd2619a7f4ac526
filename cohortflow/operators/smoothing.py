"""Robust local quadratic smoothing of series of any length: blocks with borders from their neighbours, least squares in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks
from . import halo

CELLS = 1_000_000  # weights that a task holds at a time
SHORT = 50_000  # rows of the longest series up to which a group's median is taken as one aggregate


def nearest_places(places: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of at, indices into the ascending places and which of them are among the k nearest, all that tie with the k-th included; all places if k or fewer."""
    k = min(k, len(places))
    near = np.searchsorted(places, at)[:, None] + np.arange(-k, k)[None, :]
    inside = (near >= 0) & (near < len(places))
    near = np.clip(near, 0, len(places) - 1)
    away = np.where(inside, np.abs(places[near] - at[:, None]), np.inf)
    return near, away <= np.partition(away, k - 1, axis=1)[:, k - 1 : k]


def local_quadratic(x: np.ndarray, y: np.ndarray, r: np.ndarray, used: np.ndarray) -> np.ndarray:
    """For each row of matrices the value at x = 0 of the quadratic fitted to its used points, whose weight is r times the cube of 1 - |x / reach| ** 3.

    Where these cubes are all nil, points count by r alone. Polynomials are orthogonal under the weights. Fewer than three points: the weighted mean; none: NaN.
    """
    away = np.where(used, np.abs(x), 0.0)
    fall = np.where(used, (1 - (away / np.maximum(away.max(axis=1, keepdims=True), 1.0)) ** 3) ** 3, 0.0)
    w = np.where((fall < 2.0**-52).all(axis=1, keepdims=True), used, fall) * r
    with np.errstate(all="ignore"):
        share = w / w.sum(axis=1, keepdims=True)
        mean = (share * x).sum(axis=1, keepdims=True)
        wide = np.sqrt((share * (x - mean) ** 2).sum(axis=1, keepdims=True))
        u, u0 = (x - mean) / wide, (-mean / wide)[:, 0]
        skew = (share * u**3).sum(axis=1)
        bend = u * u - skew[:, None] * u - 1
        norm = (share * bend**2).sum(axis=1)
        level = (share * y).sum(axis=1)
        curve = level + (share * u * y).sum(axis=1) * u0 + (share * bend * y).sum(axis=1) / norm * (u0 * u0 - skew * u0 - 1)
    return np.where(((w > 1e-12).sum(axis=1) >= 3) & (norm > 1e-14), curve, level)


def fitted(i: np.ndarray, y: np.ndarray, r: np.ndarray, own: np.ndarray, n: int, span: int) -> np.ndarray:
    """The curve at the own rows of a block: places i ascending with their values and weights, n rows in the series, span odd. Where no fit exists, y stays."""
    held, places = min(span, n), i[own]
    start = np.searchsorted(i, np.clip(places - held // 2, 1, n - held + 1))
    sound, out = np.flatnonzero(r > 0), np.empty(len(places))
    step = max(1, CELLS // (2 * held))
    for a in range(0, len(places), step):
        at, cols = places[a : a + step], start[a : a + step, None] + np.arange(held)[None, :]
        out[a : a + step] = local_quadratic((i[cols] - at[:, None]).astype(float), y[cols], r[cols], np.ones(cols.shape, bool))
        spoilt = np.flatnonzero((r[cols] <= 0).any(axis=1))
        if len(spoilt) and len(sound):
            near, used = nearest_places(i[sound], at[spoilt], held)
            cols = sound[near]
            out[a + spoilt] = local_quadratic((i[cols] - at[spoilt, None]).astype(float), y[cols], r[cols], used)
    return np.where(np.isfinite(out), out, y[own])


def _sound_borders(rows: DataFrame, span: int, size: int) -> DataFrame:
    """The rows of weight above 0 that each block needs beyond its own: the last ``span`` before it and the first ``span`` behind it, however far away.

    Sound rows are ranked within the series by counts of blocks; a block asks for the ranks about its own, in buckets of span ranks, by equal keys.
    """
    placed = rows.withColumn("_block", F.floor((F.col("_i") - 1) / size))
    counts = placed.groupBy("_series", "_block").agg(F.sum((F.col("_r") > 0).cast("long")).alias("_m"))
    above = Window.partitionBy("_series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = counts.withColumn("_s", F.coalesce(F.sum("_m").over(above), F.lit(0)))
    inside = Window.partitionBy("_series", "_block").orderBy("_i")
    sound = placed.where("_r > 0").withColumn("_rank", F.row_number().over(inside)).join(blocks, ["_series", "_block"])
    edge = sound.where((F.col("_rank") <= span) | (F.col("_rank") > F.col("_m") - span)).withColumn("_rank", F.col("_rank") + F.col("_s"))
    edge = edge.withColumn("_bucket", F.floor(F.col("_rank") / span)).drop("_block", "_m", "_s")
    sides = F.array(F.struct((F.col("_s") - span + 1).alias("low"), F.col("_s").alias("high")), F.struct((F.col("_s") + F.col("_m") + 1).alias("low"), (F.col("_s") + F.col("_m") + span).alias("high")))
    asked = blocks.select("_series", "_block", F.explode(sides).alias("_side")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_side.low") / span), F.floor(F.col("_side.high") / span))))
    met = asked.join(edge, ["_series", "_bucket"]).where(F.col("_rank").between(F.col("_side.low"), F.col("_side.high")))
    return met.select(*rows.columns, "_block", F.lit(False).alias("_own"))


def masked_neighbours(rows: DataFrame, k: int, block: int = halo.BLOCK) -> DataFrame:
    """_series, _i, near: for each numbered row the places of the k nearest rows of its series that ``_r`` > 0 marks, itself included if marked, with all that tie with the k-th.

    Fewer than k marked rows: all of them. A row whose series has none is not returned. Marked rows of any distance reach a block as its borders.
    """
    rows, size = rows.select("_series", "_i", "_n", "_r"), max(block, k)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        own, marks = pdf[pdf["_own"]], np.sort(pdf.loc[pdf["_r"] > 0, "_i"].to_numpy())
        if not len(marks):
            return pd.DataFrame({"_series": [], "_i": [], "near": []}, dtype="int64")
        at = own["_i"].to_numpy()
        near, used = nearest_places(marks, at, k)
        return pd.DataFrame({"_series": own["_series"].iloc[0], "_i": np.repeat(at, used.sum(axis=1)), "near": marks[near[used]]})

    wide = halo.spread(rows, 0, 0, size).unionByName(_sound_borders(rows, k, size))
    return wide.groupBy("_series", "_block").applyInPandas(pairs, "_series long, _i long, near long")


def _medians(fits: DataFrame, longest: int) -> DataFrame:
    if longest <= SHORT:
        return fits.groupBy("_series").agg(F.median("_off").alias("_mid"))
    return ranks.quantiles(fits, "_off", {"_mid": 0.5}, ["_series"])


def smooth(df: DataFrame, by: str, order: str, y: str, span: int, rounds: int = 5, block: int = halo.BLOCK) -> DataFrame:
    """df with ``smooth``: for each row of a series the robust local quadratic of the ``span`` rows about it, by row number.

    span is made odd and at most the length. Weights fall off by the cube of distance; after each of ``rounds`` fits, rows far
    from the curve (bisquare, 6 median deviations of the series) weigh less, and a row near one of weight 0 is fitted to the
    nearest others of the whole series, span in number and those that tie with the last. Null and NaN y take no part and get null; where no fit
    exists, y stays. Rows of equal order follow y. A null ``by`` is a series. Columns of df must not begin with an underscore.

    A series is cut into blocks, which get the rows about them and, where a stretch of rows weighs nothing, the sound rows beyond it; medians are exact
    (selection where a series is long). Each round's weights are stored by checkpoint().
    """
    odd = 2 * (span // 2) + 1
    size = max(block, odd)
    value = F.col(y).cast("double")
    stored = df.withColumn("_key", F.monotonically_increasing_id()).checkpoint()
    known = stored.where(value.isNotNull() & ~F.isnan(value)).select(F.col(by).alias("_by"), F.col(order).alias("_order"), value.alias("_y"), "_key")
    rows = halo.numbered(known, "_by", "_order", ["_y"]).select("_key", "_series", "_i", "_n", "_y", F.lit(1.0).alias("_r"))
    tops = rows.groupBy("_series").agg(F.max(F.abs("_y")).alias("_top"), F.max("_n").alias("_n")).checkpoint()
    longest = tops.agg(F.max("_n")).first()[0] or 0

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_i", "_own"], ascending=[True, False]).drop_duplicates("_i")
        own = pdf["_own"].to_numpy()
        kept = pdf.loc[own, ["_key", "_series", "_i", "_n", "_y"]]
        return kept.assign(_smooth=fitted(pdf["_i"].to_numpy(), pdf["_y"].to_numpy(), pdf["_r"].to_numpy(), own, int(pdf["_n"].iloc[0]), odd))

    for k in range(rounds + 1):
        wide = halo.spread(rows, odd, odd, size)
        if k and longest > size:  # in one block all rows are at hand
            wide = wide.unionByName(_sound_borders(rows, odd, size))
        fits = wide.groupBy("_series", "_block").applyInPandas(fit, "_key long, _series long, _i long, _n long, _y double, _smooth double")
        if k == rounds:
            break
        fits = fits.withColumn("_off", F.abs(F.col("_y") - F.col("_smooth"))).checkpoint()
        scales = _medians(fits, longest).join(tops.drop("_n"), "_series").select("_series", (6 * F.greatest("_mid", 1e8 * 2.0**-52 * F.col("_top"))).alias("_scale"))
        u = F.coalesce(F.try_divide("_off", "_scale"), F.lit(0.0))
        rows = fits.join(scales, "_series").withColumn("_r", F.when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)).select("_key", "_series", "_i", "_n", "_y", "_r").checkpoint()
    return stored.join(fits.select("_key", F.col("_smooth").alias("smooth")), "_key", "left").select(*df.columns, "smooth")
