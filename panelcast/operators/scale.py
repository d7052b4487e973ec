"""Scalers fitted on one panel and applied to any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import standard_score
from panelcast.operators.sizing import checked_broadcast


def fit_scaler(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, sample sd and the standardized zero of every measure (A3)."""
    stats = df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    zero = standard_score(F.lit(0.0), F.col("mean"), F.col("sd"))
    return stats.withColumn("zero_value", zero)


def _with_stats(df: DataFrame, stats: DataFrame, metric: str) -> DataFrame:
    return df.join(checked_broadcast(stats.select(metric, "mean", "sd")), metric, "inner")


def standardize(df: DataFrame, stats: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """``(x - mean) / sd`` per measure."""
    scored = standard_score(F.col(value), F.col("mean"), F.col("sd"))
    return _with_stats(df, stats, metric).withColumn(value, scored).select(*df.columns)


def unstandardize(df: DataFrame, stats: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """``x * sd + mean`` per measure (P20)."""
    back = F.col(value) * F.col("sd") + F.col("mean")
    return _with_stats(df, stats, metric).withColumn(value, back).select(*df.columns)


def fit_global_sd(df: DataFrame, value: str = "value") -> DataFrame:
    """One sample sd over every cell, as a one-row table (A4)."""
    return df.agg(F.stddev_samp(value).alias("sd_all"))


def scale_global(df: DataFrame, sd: DataFrame, value: str = "value") -> DataFrame:
    """Divide every value by the global sd, a one-row table."""
    return df.join(F.broadcast(_one_row(sd))).withColumn(value, F.try_divide(F.col(value), F.col("_sd_all"))).select(*df.columns)


def unscale_global(df: DataFrame, sd: DataFrame, value: str = "value") -> DataFrame:
    """Multiply every value by the global sd, a one-row table."""
    return df.join(F.broadcast(_one_row(sd))).withColumn(value, F.col(value) * F.col("_sd_all")).select(*df.columns)


def _one_row(sd: DataFrame) -> DataFrame:
    """One row whatever the input; without rows the sd is null."""
    return sd.agg(F.max("sd_all").alias("_sd_all"))


def fit_moments(df: DataFrame, by: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """``(by..., n, mean, m2)``: count, mean and centred sum of squares, mergeable with those of other rows (A3, A4).

    Add the release to ``by`` to keep one row per release: a corrected release then replaces its own rows.
    """
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))


def merge_moments(moments: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Moments of the union from moments of its parts, by the pairwise rule, which subtracts no squares of large sums.

    The parts of a group stand in one array: releases of a measure, or measures and releases of the whole panel.
    Parts without rows add nothing.
    """
    parts = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))))
    gathered = moments.groupBy(*by).agg(parts.alias("_p"))
    n, step = "(a.n + p.n)", "(p.mean - a.mean)"
    merged = (f"named_struct('n', {n}, 'mean', a.mean + {step} * (p.n / {n}), "
              f"'m2', a.m2 + p.m2 + {step} * {step} * (a.n / {n}) * p.n)")
    total = F.expr(f"aggregate(_p, named_struct('n', 0L, 'mean', 0D, 'm2', 0D), (a, p) -> {merged})")
    out = gathered.withColumn("_t", total).select(*by, "_t.n", "_t.mean", "_t.m2")
    return out.withColumn("mean", F.when(F.col("n") > 0, F.col("mean"))).withColumn("m2", F.when(F.col("n") > 0, F.col("m2")))


def _sd_of_moments() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


def scaler_from_moments(moments: DataFrame, metric: str = "metric") -> DataFrame:
    """The table :func:`fit_scaler` makes, from moments."""
    stats = moments.select(metric, "mean", _sd_of_moments().alias("sd"))
    return stats.withColumn("zero_value", standard_score(F.lit(0.0), F.col("mean"), F.col("sd")))


def global_sd_from_moments(moments: DataFrame) -> DataFrame:
    """The table :func:`fit_global_sd` makes, from moments of any parts of the panel (A4)."""
    return merge_moments(moments, ()).select(_sd_of_moments().alias("sd_all"))
