"""Clean panel to model-ready panel, the same for training and held-out data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import BIRTHS, KEYS, MIGRATION, POPULATION, TIME
from panelcast.operators import packed
from panelcast.operators.clean import fill_missing
from panelcast.operators.derive import residual_change, scale_by_sibling, sum_columns
from panelcast.operators.packed import Packed
from panelcast.operators.shape import canonical_order, drop_metrics

# Rows of S0701 and S1301 that do not count people, and redundant groups.
MOBILITY_NON_COUNT_ROWS = ("011E", "048E")
NON_COUNT_PATTERNS = (r"^S0701_C\d{2}_(011E|048E)$", r"^S1301_C01_(031E|032E)$")
REDUNDANT_PATTERN = r"^S1301_(C03|C04)_"
MOBILITY_PARTS = ("C02", "C03", "C04", "C05")


def to_counts(df: DataFrame) -> DataFrame:
    """Percentages to counts, migration sums, redundant and non-count columns gone.

    A projection: nothing is shuffled.
    """
    out = scale_by_sibling(df, "S0701", "C01", MOBILITY_PARTS, MOBILITY_NON_COUNT_ROWS)
    out = sum_columns(out, "S0701", MOBILITY_PARTS, "C06", MOBILITY_NON_COUNT_ROWS)
    out = drop_metrics(out, REDUNDANT_PATTERN)
    out = scale_by_sibling(out, "S1301", "C02", ("C05",))
    return drop_metrics(out, *NON_COUNT_PATTERNS)


def prepare_panel(df: DataFrame, first: int, t: str = TIME, total: str = POPULATION,
                  parts: Sequence[str] = (MIGRATION, BIRTHS)) -> DataFrame:
    """Counts, residual change, first time point dropped, order fixed, gaps filled with 0."""
    out = residual_change(to_counts(df), total, parts, t=t).where(F.col(t) != first)
    return fill_missing(canonical_order(out, (t, *KEYS)))


def to_counts_packed(p: Packed) -> Packed:
    """:func:`to_counts` on a packed panel."""
    out = packed.scale_by_sibling(p, "S0701", "C01", MOBILITY_PARTS, MOBILITY_NON_COUNT_ROWS)
    out = packed.sum_columns(out, "S0701", MOBILITY_PARTS, "C06", MOBILITY_NON_COUNT_ROWS)
    out = packed.drop(out, REDUNDANT_PATTERN)
    out = packed.scale_by_sibling(out, "S1301", "C02", ("C05",))
    return packed.drop(out, *NON_COUNT_PATTERNS)


def prepare_packed(p: Packed, first: int, t: str = TIME, total: str = POPULATION,
                   parts: Sequence[str] = (MIGRATION, BIRTHS)) -> Packed:
    """:func:`prepare_panel` on a packed panel, for the full width of the releases."""
    out = packed.residual_change(to_counts_packed(p), total, parts, t=t)
    later = replace(out, df=out.df.where(F.col(t) != first))
    return packed.fill_missing(packed.canonical(later))
