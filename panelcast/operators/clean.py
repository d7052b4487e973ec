"""Cleaning of wide panels and floor clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import RESIDUAL, SENTINEL, measures
from panelcast.functions.numeric import at_least
from panelcast.operators.sizing import checked_broadcast


def fill_missing(df: DataFrame, value: float = 0.0, cols: Sequence[str] | None = None) -> DataFrame:
    """Null and NaN measures become ``value``; infinities stay."""
    return df.na.fill(value, list(measures(df) if cols is None else cols))


def clean_sentinel(df: DataFrame, threshold: float = SENTINEL, cols: Sequence[str] | None = None) -> DataFrame:
    """Measures at or below the threshold become 0; keys are never touched."""
    chosen = set(measures(df) if cols is None else cols)
    return df.selectExpr(*[f"CASE WHEN `{c}` <= {threshold!r}D THEN 0D ELSE `{c}` END AS `{c}`" if c in chosen
                           else f"`{c}`" for c in df.columns])


def metric_means(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row holding the mean of every measure (A2); no data is shuffled."""
    return df.selectExpr(*[f"avg(`{c}`) AS `{c}`" for c in (measures(df) if cols is None else cols)])


def zero_metrics(df: DataFrame) -> list[str]:
    """Measures whose overall mean is 0.  Decide once on training data, drop on every panel."""
    means = metric_means(df).first()
    return [c for c in means.__fields__ if means[c] == 0]


def drop_zero_metrics(df: DataFrame) -> DataFrame:
    return df.drop(*zero_metrics(df))


def zero_floor(metric: Column, floor: Column) -> Column:
    """The floor of a measure; the residual has none."""
    return F.when(metric != RESIDUAL, floor)


def clip_floor(df: DataFrame, floors: DataFrame | float = 0.0, value: str = "value",
               metric: str = "metric") -> DataFrame:
    """Raise values of a long panel to their measure's floor.

    ``floors`` is one number for all measures or a table ``(metric, floor)``.
    """
    if not isinstance(floors, DataFrame):
        floor = zero_floor(F.col(metric), F.lit(float(floors)))
        return df.withColumn(value, at_least(F.col(value), floor))
    joined = df.join(checked_broadcast(floors.select(metric, "floor")), metric, "left")
    floor = zero_floor(F.col(metric), F.col("floor"))
    return joined.withColumn(value, at_least(F.col(value), floor)).select(*df.columns)
