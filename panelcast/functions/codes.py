"""Measure codes ``S<table>_C<column>_<row>E`` and the fixed tables around them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("state", "place")
TIME = "year"
SPLIT_LABELS = ("cluster", "calib", "cluster_size")
RESIDUAL = "dn"
TOTAL_KEY = "0"

CODE = r"^(S\d{4})_(C\d{2})_(\d{3}E)$"

# Cells at or below this mean "not available" in the source releases.
SENTINEL = -111111111.0

# The 18 age bins, rows 002-019 of table S0101.
AGE_LABELS = (
    "0-4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34", "35-39", "40-44",
    "45-49", "50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80-84", "85+",
)
AGE_ROWS = range(2, 20)

# Rows of each age group.
AGE_GROUP_ROWS = {
    "youth": range(2, 7),
    "working": range(7, 15),
    "senior": range(15, 20),
}

# The source tables, (columns, rows), in the two release layouts.
RELEASE_TABLES_NEW = {
    "S0101": ((1, 3, 5), range(1, 20)),
    "S0701": ((1, 2, 3, 4, 5), range(1, 54)),
    "S1301": ((1, 2, 3, 4, 5), range(1, 33)),
}
RELEASE_TABLES_OLD = {**RELEASE_TABLES_NEW, "S0101": ((1, 2, 3), range(1, 20))}
LAYOUT_CHANGE_YEAR = 2017

# Old layout column groups of S0101 and their names in the new layout.
VINTAGE_RENAMES = {"S0101": {"C03": "C05", "C02": "C03"}}


def code(tbl: str, col: int, row: int) -> str:
    return f"{tbl}_C{col:02d}_{row:03d}E"


AGE_METRICS = tuple(code("S0101", 1, r) for r in AGE_ROWS)
AGE_GROUPS = {g: tuple(code("S0101", 1, r) for r in rows) for g, rows in AGE_GROUP_ROWS.items()}
MIGRATION = code("S0701", 6, 1)
WOMEN = code("S1301", 1, 1)
BIRTHS = code("S1301", 2, 1)
POPULATION = code("S0101", 1, 1)
MODEL_METRICS = (*AGE_METRICS, MIGRATION, WOMEN, BIRTHS, RESIDUAL)


def parse(name: str) -> tuple[str, str, str] | None:
    """Split a code into (table, column, row); None for any other name."""
    found = re.match(CODE, name)
    return found.groups() if found else None


def code_part(metric: Column | str, part: str) -> Column:
    """Column expression for the ``table``, ``column`` or ``row`` part of a code."""
    group = {"table": 1, "column": 2, "row": 3}[part]
    return F.regexp_extract(metric, CODE, group)


def measures(df: DataFrame, ids: Iterable[str] = (TIME, *KEYS, *SPLIT_LABELS)) -> list[str]:
    """Measure columns of a wide panel: everything that is not an id or a split label."""
    skip = set(ids)
    return [c for c in df.columns if c not in skip]


def matching(names: Iterable[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names that match every ``include`` regex and no ``exclude`` regex, in order."""
    return [
        n for n in names
        if all(re.search(p, n) for p in include) and not any(re.search(p, n) for p in exclude)
    ]
