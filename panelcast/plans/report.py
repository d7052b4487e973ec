"""Report tables of projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import AGE_GROUPS, AGE_METRICS, KEYS, TIME, TOTAL_KEY
from panelcast.operators.aggregate import kde, with_totals
from panelcast.operators.clean import fill_missing
from panelcast.operators.derive import add_age_groups, add_ratios
from panelcast.operators.relate import compare_tagged
from panelcast.operators.shape import in_order, to_wide

# Report order of the quantile paths.
QUANTILE_ORDER = ("Upper", "Middle", "Lower")
REPORT_COLUMNS = ("total", "youth", "working", "senior", "working_senior_ratio", "working_total_ratio",
                  "senior_total_ratio")
PATH = ("model", "quantile")


def projection_series(paths: DataFrame, names: Mapping[float, str], bins: Sequence[str] = AGE_METRICS,
                      groups: Mapping[str, Sequence[str]] = AGE_GROUPS) -> DataFrame:
    """Totals, age groups and ratios per model, quantile path, year and place.

    ``paths`` is ``(model, q, year, state, place, metric, value)``: all models and quantiles
    go through one pivot and one total, whatever their number.  ``names`` labels the levels.
    """
    quantile = "CASE q " + " ".join(f"WHEN {q!r}D THEN '{n}'" for q, n in names.items()) + " END"
    labelled = paths.withColumn("quantile", F.expr(quantile)).where("quantile IS NOT NULL")
    wide = to_wide(labelled, bins, (*PATH, TIME, *KEYS))
    totals = with_totals(wide, bins, by=(*PATH, TIME))
    shaped = add_ratios(add_age_groups(totals, groups)).select(*PATH, TIME, *KEYS, *REPORT_COLUMNS)
    return fill_missing(shaped, cols=REPORT_COLUMNS)


def with_history(paths: DataFrame, observed: DataFrame, models: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """``paths`` with the observed years ``(year, state, place, metric, value)`` in front, once for each model and quantile."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(q)).alias("q")) for m in models for q in quantiles]))
    before = observed.withColumn("_of", each).select("*", "_of.model", "_of.q").drop("_of")
    return before.select(*paths.columns).unionByName(paths)


def total_comparison(series: DataFrame, paths: Sequence[tuple[str, str]], value: str = "total") -> DataFrame:
    """One column per (model, quantile); the first one decides the rows."""
    name, names = F.lit(None).cast("string"), []
    for model, quantile in paths:
        names.append(f"{value}_{quantile.lower()}_{model}")
        name = F.when((F.col("model") == model) & (F.col("quantile") == quantile), names[-1]).otherwise(name)
    return compare_tagged(series.withColumn("_series", name).where("_series IS NOT NULL"), "_series", names, value)


def tagged_series(series: DataFrame, value: str = "working_senior_ratio") -> DataFrame:
    """One measure of every path with its quantile's position in the legend."""
    return (series.select(*PATH, TIME, *KEYS, value)
            .withColumn("quantile_order", in_order("quantile", QUANTILE_ORDER)))


def ratio_distribution(series: DataFrame, years: Sequence[int], lo: float = -8.0, hi: float = 10.0,
                       last_observed: int | None = None, model: str | None = None) -> DataFrame:
    """Density of the working/senior ratio by year and model: median paths, entities only.

    Years up to ``last_observed`` are the same for all models; they get one curve, from the rows of ``model``.
    """
    rows = series.where(F.col(TIME).isin(*years) & (F.col("place") != TOTAL_KEY) & (F.col("quantile") == "Middle"))
    kind = F.concat_ws("_", F.col(TIME).cast("string"), "model")
    if last_observed is not None:
        seen = F.col(TIME) <= last_observed
        rows = rows.where(~seen | (F.col("model") == model))
        kind = F.when(seen, F.col(TIME).cast("string")).otherwise(kind)
    return kde(rows.withColumn("type", kind), "working_senior_ratio", ["type"], lo, hi)
