"""Joins between panels, lookups and entity tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import KEYS, TIME
from panelcast.operators.sizing import checked_broadcast, fetch_small, local_table


def build_holdout(lookups: Sequence[DataFrame], names: DataFrame, exclude: Sequence[str] = (),
                  code: str = "FIPS", name: str = "Name") -> DataFrame:
    """Lookup rows whose name is wanted, lookups stacked, known-bad codes removed."""
    stacked = reduce(DataFrame.unionByName, [df.select(code, name) for df in lookups])
    kept = stacked.join(checked_broadcast(names.select(name).distinct()), name, "left_semi").select(code, name)
    return kept.where(~F.col(code).isin(*exclude)) if exclude else kept


def split_by_list(df: DataFrame, entities: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed entities and all other rows."""
    listed = checked_broadcast(entities.select(*keys).distinct())
    held, rest = (df.join(listed, list(keys), how) for how in ("left_semi", "left_anti"))
    return held.select(*df.columns), rest.select(*df.columns)


def decode(df: DataFrame, lookup: DataFrame, code: str, name: str, column: str) -> DataFrame:
    """Replace the codes in ``column`` by the names a lookup gives them.

    A code with two names would multiply rows, so it is rejected.
    """
    pairs = lookup.select(F.col(code).alias(column), F.col(name).alias("_name"))
    local = fetch_small(pairs)
    if local is None:
        twice = pairs.groupBy(column).count().where("count > 1").select(column).take(1)
    else:
        counts = local.group_by(column).aggregate([([], "count_all")])
        twice = [[r[column]] for r in counts.to_pylist() if r["count_all"] > 1]
        pairs = F.broadcast(local_table(df.sparkSession, local, pairs))
    if twice:
        raise ValueError(f"lookup gives code {twice[0][0]!r} more than one name")
    joined = df.join(pairs, column, "inner")
    return joined.select(*[F.col("_name").alias(c) if c == column else F.col(c) for c in df.columns])


def attach(df: DataFrame, entities: DataFrame, keys: Sequence[str] = KEYS, missing: int | None = 0) -> DataFrame:
    """Entity attributes on every row of the entity; unmatched become ``missing``."""
    added = [c for c in entities.columns if c not in keys]
    joined = df.join(entities, list(keys), "left")
    fill = [F.coalesce(F.col(c), F.lit(missing)).alias(c) if missing is not None else F.col(c) for c in added]
    return joined.select(*df.columns, *fill)


def history_counts(df: DataFrame, keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Time points per entity (A1)."""
    return df.groupBy(*keys).agg(F.count_distinct(t).alias("n"))


def require_history(df: DataFrame, n: int, at_least: bool = False, present_at: int | None = None,
                    keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Rows of entities with exactly (or at least) ``n`` time points.

    ``present_at`` also asks for a row at that time.  Counting is a partial
    aggregate and the filter a semi-join, so one very long entity cannot fill a task.
    """
    counts = df.groupBy(*keys).agg(
        F.count_distinct(t).alias("_n"), F.max((F.col(t) == F.lit(present_at)).cast("int")).alias("_present"))
    kept = counts.where(F.col("_n") >= n if at_least else F.col("_n") == n)
    if present_at is not None:
        kept = kept.where(F.col("_present") == 1)
    return df.join(kept.select(*keys), list(keys), "left_semi").select(*df.columns)


def compare_projections(series: Mapping[str, DataFrame], value: str,
                        on: Sequence[str] = (TIME, *KEYS)) -> DataFrame:
    """One column per named series on the rows of the first.

    The chain of left joins is one union and one aggregate: a single shuffle
    however many series there are.
    """
    tagged = [df.select(*on, F.lit(name).alias("_series"), F.col(value).alias("_v")) for name, df in series.items()]
    return compare_tagged(reduce(DataFrame.unionByName, tagged), "_series", list(series), "_v", on)


def compare_tagged(df: DataFrame, tag: str, names: Sequence[str], value: str, on: Sequence[str] = (TIME, *KEYS)) -> DataFrame:
    """The same from one table whose column ``tag`` names the series of a row, so what makes the table is run once."""
    merged = df.groupBy(*on).agg(
        F.max((F.col(tag) == names[0]).cast("int")).alias("_in_first"),
        *[F.max(F.when(F.col(tag) == s, F.col(value))).alias(s) for s in names],
    )
    return merged.where("_in_first = 1").drop("_in_first")


def align(pred: DataFrame, actual: DataFrame, on: Sequence[str] = (TIME, *KEYS, "metric"),
          value: str = "value") -> DataFrame:
    """Predictions next to actuals, matched by key."""
    left = pred.select(*on, F.col(value).alias("pred"), *[c for c in pred.columns if c not in (*on, value)])
    return left.join(actual.select(*on, F.col(value).alias("actual")), list(on), "inner")


def entity_labels(entities: DataFrame, panel: DataFrame, at: int, labels: Sequence[str],
                  keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Labels the listed entities carry at one time point."""
    picked = panel.where(F.col(t) == at).select(*keys, *labels)
    return entities.select(*keys).join(picked, list(keys), "inner")
