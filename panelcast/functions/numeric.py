"""Numeric expressions shared by the operators.

Functions ending in ``_sql`` return expression text: operators over hundreds of
measures build one string per measure, which is far cheaper to hand to Spark than
a tree of Column objects and plans the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale`` where 0/0 is 0 and x/0 is signed infinity."""
    at_zero = F.when(num == 0, F.lit(0.0)).otherwise(F.signum(num) * F.lit(float("inf")))
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den) * F.lit(scale))


def percent_of_sql(base: str, pct: str) -> str:
    return f"{base} * {pct} / 100"


def max_when_sql(column: str, key: str, value: str) -> str:
    """The value of ``column`` in the row of a group whose key has the given value."""
    return f"max(CASE WHEN {key} = '{value}' THEN {column} END)"


def standard_score(x: Column, mean: Column, sd: Column) -> Column:
    """``(x - mean) / sd``; a constant measure (sd 0) scores 0."""
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, sd))


def at_least(x: Column, floor: Column) -> Column:
    """``x`` raised to ``floor``; a null floor means there is none."""
    return F.when(x < floor, floor).otherwise(x)


def ema_steps_sql(series: Sequence[str], span: int = 2) -> list[str]:
    """Exponential moving average at every step of an ordered series, seeded with its first value."""
    a = f"(2D / {span + 1})"
    out = [series[0]]
    for x in series[1:]:
        out.append(f"({a} * {x} + (1 - {a}) * {out[-1]})")
    return out


def weighted_sum_sql(weights: Sequence[float], terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"{float(w)!r}D * {x}" for w, x in zip(weights, terms)) + ")"


def pseudo_huber_quantile(y: Column, pred: Column, q: Column) -> Column:
    """Signed pseudo-Huber quantile loss; its absolute value is the per-cell loss."""
    e = y - pred
    over = F.sqrt(q * q * e * e + 1) - 1
    under = F.sqrt((1 - q) * (1 - q) * e * e + 1) - 1
    return F.when(e >= 0, over).otherwise(-under)


def interpolated(sorted_values: Column, p: Column) -> Column:
    """Linear-interpolation quantile of one bounded, sorted array."""
    h = (F.size(sorted_values) - 1) * p
    lo = F.floor(h).cast("int")
    v_lo = F.element_at(sorted_values, lo + 1)
    v_hi = F.element_at(sorted_values, F.ceil(h).cast("int") + 1)
    return v_lo + (h - lo) * (v_hi - v_lo)
