"""Derived measures on wide panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.codes import (
    AGE_GROUPS, BIRTHS, KEYS, LAYOUT_CHANGE_YEAR, MIGRATION, POPULATION, RESIDUAL, TIME, measures, parse,
)
from panelcast.functions.numeric import percent_of_sql, ratio


def _replace(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{exprs[c]} AS `{c}`" if c in exprs else f"`{c}`" for c in df.columns])


def pct_to_count(df: DataFrame, tbl: str = "S0101", base_row: str = "001E",
                 cols: Sequence[str] = ("C01", "C02", "C03"), before: int | None = LAYOUT_CHANGE_YEAR,
                 t: str = TIME, digits: int = 0) -> DataFrame:
    """Percentages of a column group's own total become counts, rounded half to even."""
    exprs = {}
    for name in measures(df):
        parts = parse(name)
        if parts is None or parts[0] != tbl or parts[1] not in cols or parts[2] == base_row:
            continue
        count = f"bround({percent_of_sql(f'{tbl}_{parts[1]}_{base_row}', name)}, {digits})"
        exprs[name] = count if before is None else f"CASE WHEN {t} < {before} THEN {count} ELSE {name} END"
    return _replace(df, exprs)


def scale_by_sibling(df: DataFrame, tbl: str, base_col: str, cols: Sequence[str],
                     exclude_rows: Sequence[str] = ()) -> DataFrame:
    """Percentages become counts of the same row in a sibling column group."""
    exprs = {}
    for name in measures(df):
        parts = parse(name)
        if parts is None or parts[0] != tbl or parts[1] not in cols or parts[2] in exclude_rows:
            continue
        exprs[name] = percent_of_sql(f"{tbl}_{base_col}_{parts[2]}", name)
    return _replace(df, exprs)


def sum_family(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """New measures, each the row-wise sum of a family of measures (P10)."""
    return df.selectExpr("*", *[f"{' + '.join(cols)} AS `{n}`" for n, cols in families.items()])


def sum_columns(df: DataFrame, tbl: str, cols: Sequence[str], into: str,
                exclude_rows: Sequence[str] = ()) -> DataFrame:
    """Sum sibling column groups row by row, e.g. migration C06 = C02 + ... + C05 (P10)."""
    rows = [parse(c)[2] for c in measures(df)
            if parse(c) and parse(c)[:2] == (tbl, cols[0]) and parse(c)[2] not in exclude_rows]
    return sum_family(df, {f"{tbl}_{into}_{r}": [f"{tbl}_{c}_{r}" for c in cols] for r in rows})


def add_age_groups(df: DataFrame, groups: Mapping[str, Sequence[str]] = AGE_GROUPS,
                   total: str | None = "total") -> DataFrame:
    """Youth, working and senior sums, and their total (P10)."""
    families = dict(groups)
    if total:
        families[total] = [c for cols in groups.values() for c in cols]
    return sum_family(df, families)


def add_ratios(df: DataFrame, total: str = "total") -> DataFrame:
    """Working/senior, working/total in percent, senior/total in percent."""
    working, senior, whole = F.col("working"), F.col("senior"), F.col(total)
    return df.select(
        "*",
        ratio(working, senior).alias("working_senior_ratio"),
        ratio(working, whole, 100.0).alias("working_total_ratio"),
        ratio(senior, whole, 100.0).alias("senior_total_ratio"),
    )


def growth_rate(df: DataFrame, value: str, first: int, last: int, n: int | None = None,
                keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Percent change between two end points for entities with ``n`` rows."""
    ends = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col(t) == first, F.col(value))).alias("first_value"),
        F.max(F.when(F.col(t) == last, F.col(value))).alias("last_value"),
    )
    if n is not None:
        ends = ends.where(F.col("_n") == n)
    change = ratio(F.col("last_value") - F.col("first_value"), F.col("first_value"), 100.0)
    return ends.drop("_n").withColumn("growth_rate", change)


def residual_change(df: DataFrame, total: str = POPULATION, parts: Sequence[str] = (MIGRATION, BIRTHS),
                    keys: Sequence[str] = KEYS, t: str = TIME, name: str = RESIDUAL) -> DataFrame:
    """Change of the total since the entity's previous row, less its known components."""
    w = Window.partitionBy(*keys).orderBy(t)
    change = F.col(total) - F.lag(total).over(w)
    for p in parts:
        change = change - F.col(p)
    return df.withColumn(name, change)
