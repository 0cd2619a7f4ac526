"""Moments, scaling, imputation, winsorising and correlation pruning, in one pass over each group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortflow.functions.ranks import column_quantiles
from cohortflow.functions.scalars import clip, present

from . import gram
from .cohorts import first_rows


def moments(df: DataFrame, columns: list[str], by: list[str] | None = None, sample: bool = True) -> DataFrame:
    """One row (or one for each group) with mean_c and sd_c of each column; NaN is missing; sd with n - 1 or n below."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*(by or [])).agg(*[f(present(c)).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", sd))])


def _with(df: DataFrame, stats: DataFrame, by: list[str] | None, how: str = "inner") -> DataFrame:
    """stats has one row, or one for each group; Spark broadcasts them if they are small."""
    return df.join(stats, by, how) if by else df.crossJoin(F.broadcast(stats))


def zscore(df: DataFrame, columns: list[str], by: list[str] | None = None, sample: bool = True) -> DataFrame:
    """(c - mean) / sd; a sd of 0 counts as 1."""
    stats = moments(df, columns, by, sample)
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}")) for c in columns}
    return _with(df, stats, by).withColumns(scaled).select(df.columns)


def scale_by(df: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """df scaled by given moments (mean_c, sd_c), such as those of training rows, for rows that had no part in them; a sd of 0 counts as 1."""
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}")) for c in columns}
    return _with(df, stats, by).withColumns(scaled).select(df.columns)


def normalised(df: DataFrame, binary: list[str], normal: list[str], log: list[str], dose: str | None = None, doubled: str | None = None, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df, moments): binary columns less a half, normal ones scaled, log ones scaled after ln(0.1 + c), n - 1 below; a dose is ln(c + 0.6) after its half is
    taken off, so ln(0.1 + dose); one column counts twice. With ``stats`` given, those moments are used, otherwise those of df."""
    shifted = df.withColumns({c: log_shift(c) for c in log})
    stats = moments(shifted, normal + log) if stats is None else stats
    out = scale_by(shifted, stats, normal + log).withColumns({c: F.col(c) - 0.5 for c in binary})
    if dose:
        out = out.withColumn(dose, F.ln(F.col(dose) + 0.6))
    return (out.withColumn(doubled, 2 * F.col(doubled)) if doubled else out), stats


@dataclass(frozen=True)
class SitePreprocessing:
    """What a site's preprocessing does, in this order: first row of each stay, selection, imputation, clipping to quantiles, log-shift, pruning, scaling."""

    normal: tuple[str, ...]
    log: tuple[str, ...]
    binary: tuple[str, ...]
    first_bloc: bool = True
    low: float = 0.01
    high: float = 0.99
    prune: bool = False
    most: float = 0.9

    def run(self, df: DataFrame, key: str, order: str, site: str) -> DataFrame:
        """key, site and the features that are left."""
        rows = first_rows(df, key, order) if self.first_bloc else df
        normal, log, binary = ([c for c in columns if c in df.columns] for columns in (self.normal, self.log, self.binary))
        filled = winsorise(impute(rows.select(key, site, *normal, *log, *binary), normal + binary, log, [site]).checkpoint(), normal + log, self.low, self.high, [site])
        shifted = filled.withColumns({c: log_shift(c) for c in log})
        gone = {r["name"] for r in correlated_columns(shifted, normal + log, self.most).collect()} if self.prune else set()
        kept = [c for c in normal + log if c not in gone]
        return zscore(shifted.drop(*gone), kept, [site], sample=False).withColumns({c: F.col(c) - 0.5 for c in binary})


def chosen_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Those of the wanted columns that df has, in the order wanted, and those that it lacks."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def numeric_columns(df: DataFrame, without: list[str]) -> list[str]:
    """All numeric columns but those excluded: what is used when no features are named."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def log_shift(c: str) -> Column:
    """ln(0.1 + c), with c below 0 as 0; null stays null."""
    return F.when(F.col(c).isNotNull(), F.ln(F.lit(0.1) + F.greatest(F.col(c), F.lit(0.0))))


def impute(df: DataFrame, means: list[str], medians: list[str], by: list[str] | None = None) -> DataFrame:
    """Missing values (null or NaN) as the group's mean or exact median."""
    stats = df.groupBy(*(by or [])).agg(*[F.avg(present(c)).alias(f"_{c}") for c in means], F.count(F.lit(1)).alias("_rows")).drop("_rows")
    if medians:
        stats = _with(stats, column_quantiles(df, medians, {"": 0.5}, by), by, "left")
    return _with(df, stats, by).withColumns({c: F.coalesce(present(c), F.col(f"_{c}")) for c in [*means, *medians]}).select(df.columns)


def winsorise(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Values within the group's exact quantiles; then infinities and nulls as 0."""
    stats = column_quantiles(df, columns, {"_low": low, "_high": high}, by)
    held = {c: clip(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}")) for c in columns}
    finite = {c: F.when(held[c].isNull() | (F.abs(held[c]) == float("inf")), 0.0).otherwise(held[c]) for c in columns}
    return _with(df, stats, by, "left").withColumns(finite).select(df.columns)


def site_preprocess(df: DataFrame, normal: list[str], log: list[str], binary: list[str], by: list[str]) -> DataFrame:
    """Impute, winsorise, log-shift, scale with n below, and binary columns less a half; statistics are each site's own."""
    filled = winsorise(impute(df, normal + binary, log, by).checkpoint(), normal + log, by=by)
    shifted = filled.withColumns({c: log_shift(c) for c in log})
    return zscore(shifted, normal + log, by, sample=False).withColumns({c: F.col(c) - 0.5 for c in binary})


def renormalise(df: DataFrame, log: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """A second pass over scaled data: log-shift of ``log``, then all columns scaled again with n below."""
    return zscore(df.withColumns({c: log_shift(c) for c in log}), columns, by, sample=False)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns in the order given, over the rows that have both (null or NaN is missing); null where one does not vary. See gram."""
    return gram.correlations(df, columns)


def correlated_columns(df: DataFrame, columns: list[str], most: float = 0.9) -> DataFrame:
    """name: columns whose |r| with any earlier column is over ``most``; an unknown r keeps a column."""
    return correlations(df, columns).where(F.abs("r") > most).select(F.col("b").alias("name")).distinct()
