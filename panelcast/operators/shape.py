"""Columns, names and the two panel shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import CODE, KEYS, RESIDUAL, SPLIT_LABELS, TIME, code_part, matching, measures, parse
from panelcast.functions.numeric import max_when_sql

# Beyond this many measures a conditional aggregate per measure is slower than pivot's own.
CONDITIONAL_PIVOT_LIMIT = 64


def tag(df: DataFrame, **constants) -> DataFrame:
    """Add constant columns and put them first."""
    rest = [c for c in df.columns if c not in constants]
    return df.select(*[F.lit(v).alias(k) for k, v in constants.items()], *rest)


def stack_releases(releases: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a measure a release lacks becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), releases)


def align_vintage(df: DataFrame, renames: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rename column groups of a wide release, all at once.

    ``{"S0101": {"C03": "C05", "C02": "C03"}}`` moves C03 to C05 and C02 to C03;
    because every name is mapped from its old value, the order does not matter.
    """
    def new_name(name: str) -> str:
        parts = parse(name)
        if parts is None:
            return name
        tbl, col, row = parts
        return f"{tbl}_{renames.get(tbl, {}).get(col, col)}_{row}"

    return df.toDF(*[new_name(c) for c in df.columns])


def align_vintage_long(df: DataFrame, renames: Mapping[str, Mapping[str, str]], before: int,
                       t: str = TIME, metric: str = "metric") -> DataFrame:
    """The same rename on a long panel, for rows earlier than ``before``."""
    tbl, col = code_part(metric, "table"), code_part(metric, "column")
    new_col = col
    for table, moves in renames.items():
        for old, new in moves.items():
            new_col = F.when((tbl == table) & (col == old), F.lit(new)).otherwise(new_col)
    renamed = F.concat_ws("_", tbl, new_col, code_part(metric, "row"))
    applies = (F.col(t) < before) & F.col(metric).rlike(CODE)
    return df.withColumn(metric, F.when(applies, renamed).otherwise(F.col(metric)))


def select_metrics(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                   ids: Sequence[str] = (TIME, *KEYS)) -> DataFrame:
    """Keep ids and the measures chosen by name regex."""
    return df.select(*ids, *matching(measures(df, ids), include, exclude))


def drop_metrics(df: DataFrame, *patterns: str) -> DataFrame:
    """Drop measures matching any of the patterns."""
    return df.drop(*[c for p in patterns for c in matching(measures(df), [p])])


def canonical_order(df: DataFrame, ids: Sequence[str] = (TIME, *KEYS)) -> DataFrame:
    """Ids, sorted coded measures, the residual, then split labels (P5)."""
    coded = sorted(c for c in df.columns if parse(c))
    tail = [c for c in (RESIDUAL, *SPLIT_LABELS) if c in df.columns]
    return df.select(*ids, *coded, *tail)


def parse_metric(df: DataFrame, metric: str = "metric") -> DataFrame:
    """Add ``tbl``, ``col`` and ``row`` taken from the code."""
    return df.select("*", code_part(metric, "table").alias("tbl"),
                     code_part(metric, "column").alias("col"), code_part(metric, "row").alias("row"))


def intersect_schema(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common columns, in the order of the first."""
    common = [c for c in a.columns if c in set(b.columns)]
    return a.select(*common), b.select(*common)


def to_long(df: DataFrame, ids: Sequence[str] = (TIME, *KEYS), cols: Sequence[str] | None = None,
            name: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot wide to long.

    Written as a generator, which keeps the input's hash partitioning: windows by
    entity and measure that follow need no further shuffle.
    """
    cols = list(cols if cols is not None else measures(df, ids))
    pairs = ", ".join(f"struct('{c}' AS {name}, CAST(`{c}` AS DOUBLE) AS {value})" for c in cols)
    return df.selectExpr(*ids, f"inline(array({pairs}))")


def to_wide(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = (TIME, *KEYS),
            name: str = "metric", value: str = "value") -> DataFrame:
    """Pivot long to wide over an explicit measure list: one shuffle by ``ids``."""
    if len(metrics) > CONDITIONAL_PIVOT_LIMIT:
        return df.groupBy(*ids).pivot(name, list(metrics)).agg(F.max(value))
    return df.groupBy(*ids).agg(*[F.expr(f"{max_when_sql(value, name, m)} AS `{m}`") for m in metrics])


def transpose(df: DataFrame, row: str, columns: Sequence[str], to: str = "measure",
              labels: Sequence | None = None) -> DataFrame:
    """Swap a report table: one row per column, one column per row label, as a pivot.

    ``labels`` fixes the columns; without it they are read from the table, which is then worth only for small ones.
    """
    if labels is None:
        labels = [r[0] for r in df.select(row).distinct().orderBy(row).collect()]
    cells = df.select(row, *columns).unpivot([row], list(columns), to, "_cell")
    return cells.groupBy(to).pivot(row, list(labels)).agg(F.max("_cell"))


def with_quantile_dim(df: DataFrame, quantiles: Sequence[float], q: str = "q") -> DataFrame:
    """One copy of every row per quantile level, told apart by column ``q``."""
    return df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in quantiles])).alias(q))


def take_quantile(df: DataFrame, level: float, q: str = "q") -> DataFrame:
    """Rows of one quantile level, without the level column."""
    return df.where(F.col(q) == F.lit(float(level))).drop(q)


def label_metrics(df: DataFrame, labels: Mapping[str, str], metric: str = "metric") -> DataFrame:
    """Replace codes by labels; codes without a label stay."""
    return df.withColumn(metric, F.expr(label_sql(metric, labels)))


def label_sql(metric: str, labels: Mapping[str, str]) -> str:
    cases = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in labels.items())
    return f"CASE {metric} {cases} ELSE {metric} END"


def in_order(label: str, order: Sequence[str]) -> Column:
    """Sort index of an ordered category, e.g. Upper, Middle, Lower."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(label)).cast("int")
