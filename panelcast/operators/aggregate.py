"""Totals and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import AGE_METRICS, KEYS, TIME, TOTAL_KEY, measures
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.sizing import staged
from panelcast.operators.shape import to_long


def with_totals(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = KEYS,
                by: Sequence[str] = (TIME,)) -> DataFrame:
    """Append one total row per time point, keyed '0' (A5).

    Only the totals are aggregated, with partial sums; detail rows are not shuffled.
    """
    cols = list(measures(df, (*by, *keys)) if cols is None else cols)
    totals = df.groupBy(*by).agg(*[F.expr(f"sum(`{c}`) AS `{c}`") for c in cols])
    totals = totals.selectExpr(*by, *[f"'{TOTAL_KEY}' AS {k}" for k in keys], *cols)
    return df.select(*by, *keys, *cols).unionByName(totals)


def without_totals(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that are not total rows."""
    return df.where(F.col(keys[-1]) != TOTAL_KEY)


def report_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest value of each column, the axis scale of a report."""
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in cols])


def age_profile(df: DataFrame, place: str, bins: Sequence[str] = AGE_METRICS, t: str = TIME) -> DataFrame:
    """Population by age bin and year of one place."""
    return to_long(df.where(F.col("place") == place).select(t, *bins), [t], bins, "age_bin", "population")


def histogram_density(df: DataFrame, x: str, lo: float, hi: float, bins: int = 30,
                      by: Sequence[str] = ()) -> DataFrame:
    """Density per equal-width bin of the values within [lo, hi], empty bins included.

    A group without a value in the range has no rows.
    """
    width = (hi - lo) / bins
    bin_no = F.least(F.floor((F.col(x) - lo) / width), F.lit(bins - 1)).cast("int")
    # One row per group and filled bin, then a map of at most ``bins`` entries per group.
    filled = (df.where(F.col(x).between(lo, hi)).groupBy(*by, bin_no.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(*by).agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_bins")))
    counts = (filled.where("_all > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
              .withColumn("n", F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0).cast("long"))))
    density = F.col("n") / (F.col("_all") * F.lit(width))
    return counts.select(*by, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"), "n",
                         density.alias("density"))


def bandwidth(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Rule-of-thumb Gaussian bandwidth ``0.9 min(sd, IQR/1.34) n^-0.2`` of every group."""
    spread = df.groupBy(*by).agg(F.stddev_samp(x).alias("_sd"), F.count(x).alias("n"))
    quartiles = exact_quantiles(df, x, [0.25, 0.75], by).groupBy(*by).agg(
        (F.max("value") - F.min("value")).alias("_iqr"))
    low = F.least(F.col("_sd"), F.col("_iqr") / 1.34)
    low = F.when(low == 0, F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))).otherwise(low)
    return spread.join(quartiles, list(by)).select(*by, "n", (0.9 * low * F.pow("n", F.lit(-0.2))).alias("bw"))


def kde(df: DataFrame, x: str, by: Sequence[str], lo: float, hi: float, points: int = 512) -> DataFrame:
    """Gaussian density curve of every group at ``points`` places in [lo, hi].

    Values are split linearly between the two nearest of ``points`` bins spanning
    [lo - 4 bw, hi + 4 bw], which one partial aggregate does for any number of rows;
    the curve is then a sum over bins, a fixed amount of work per group.  A group of one value has no bandwidth and no curve.
    The values are made once and written, as the bandwidth takes several passes over them.
    """
    by = list(by)
    used = staged(df.where(F.col(x).between(lo, hi)).select(*by, F.col(x).cast("double").alias("_x")))
    bw = bandwidth(used, "_x", by).where("bw is not null")
    start = F.lit(lo) - 4 * F.col("bw")
    step = (F.lit(hi - lo) + 8 * F.col("bw")) / (points - 1)
    pos = (F.col("_x") - start) / step
    cell = F.floor(pos).cast("int")
    frac = pos - F.floor(pos)
    shares = F.inline(F.array(F.struct(cell.alias("_bin"), (1 - frac).alias("_m")),
                              F.struct((cell + 1).alias("_bin"), frac.alias("_m"))))
    masses = used.join(bw, by).select(*by, "bw", "n", shares).groupBy(*by, "bw", "n", "_bin").agg(F.sum("_m").alias("_mass"))
    # The bins of a group, ``points`` at most, in one row; every point of its curve is a sum over them.
    bins = masses.groupBy(*by, "bw", "n").agg(F.collect_list(F.struct(
        (start + F.col("_bin") * step).alias("at"), F.col("_mass").alias("m"))).alias("_bins"))
    at = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    height = F.expr("aggregate(_bins, 0D, (s, b) -> s + b.m * exp(-0.5D * pow((x - b.at) / bw, 2)))")
    return (bins.select("*", grid).withColumn("x", at)
            .select(*by, "i", "x", (height / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))).alias("density")))
