"""Yearly releases, lookups and staged panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import (
    KEYS, LAYOUT_CHANGE_YEAR, RELEASE_TABLES_NEW, RELEASE_TABLES_OLD, TIME, code, measures,
)
from panelcast.operators.shape import stack_releases, tag


def codebook(spark: SparkSession, tables: Mapping[str, tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """``(tbl, col, row, metric)`` for every table, column and row number, sorted by code."""
    config = [(tbl, list(cols), list(rows)) for tbl, (cols, rows) in tables.items()]
    base = spark.createDataFrame(config, "tbl string, cols array<int>, rows array<int>")
    grid = base.select("tbl", F.explode("cols").alias("col"), "rows").select("tbl", "col", F.explode("rows").alias("row"))
    return grid.withColumn("metric", F.format_string("%s_C%02d_%03dE", "tbl", "col", "row")).orderBy("metric")


def release_codes(year: int) -> list[str]:
    """Sorted codes a release of that year holds."""
    tables = RELEASE_TABLES_OLD if year < LAYOUT_CHANGE_YEAR else RELEASE_TABLES_NEW
    return sorted(code(t, c, r) for t, (cols, rows) in tables.items() for c in cols for r in rows)


def panel_schema(names: Sequence[str], ids: Sequence[str] = (TIME, *KEYS)) -> T.StructType:
    """INT time, STRING keys (leading zeros survive), DOUBLE measures."""
    kinds = {TIME: T.IntegerType(), **{k: T.StringType() for k in KEYS}}
    return T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in (*ids, *names)])


def read_release(spark: SparkSession, path: str, year: int) -> DataFrame:
    """One release from CSV with a header, year first, keys as text, measures as doubles.

    What is not a number, such as ``(X)``, ``-`` or ``N``, is null, which the cleaning turns into 0.
    """
    return typed_release(spark.read.option("header", True).csv(path), year)


def typed_release(raw: DataFrame, year: int) -> DataFrame:
    """A release read as text, year first, keys as text, measures as doubles."""
    typed = raw.selectExpr(*KEYS, *[f"try_cast(`{c}` AS DOUBLE) AS `{c}`" for c in raw.columns if c not in KEYS])
    return tag(typed, **{TIME: year})


def read_releases(spark: SparkSession, paths: Mapping[int, str]) -> dict[int, DataFrame]:
    """Releases by year, from ``{year: path}`` (S1); stack them after alignment."""
    return {year: read_release(spark, path, year) for year, path in sorted(paths.items())}


def read_lookup(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",", header: bool = False,
                columns: Sequence[int] | None = None) -> DataFrame:
    """A delimited lookup, all text, columns chosen by position and named.

    Carriage returns at line ends are dropped.
    """
    raw = spark.read.option("sep", sep).option("header", header).option("lineSep", "\n").csv(path)
    chosen = columns if columns is not None else range(len(names))
    return raw.select(*[F.regexp_replace(F.col(f"`{raw.columns[i]}`"), "\r$", "").alias(n)
                        for i, n in zip(chosen, names)])


def read_panel(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A staged table with explicit types: no inference, keys stay text."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (S3)."""
    df.write.mode(mode).option("header", True).csv(path)


def stack_all(releases: Mapping[int, DataFrame]) -> DataFrame:
    """All releases, year first."""
    stacked = stack_releases([releases[y] for y in sorted(releases)])
    return stacked.select(TIME, *KEYS, *measures(stacked))
