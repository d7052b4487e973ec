"""Feature state carried from release to release.

The state is one row per series: its last ``depth`` values and their times.  A new release meets the state by
series and gives its rows' features, so nothing older is read again; the cost is that of the state and one release.
A release holds at most one row of a series, later than those before; an earlier one is refused.
Values are doubles, or the arrays of a packed panel with ``by`` the entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.codes import KEYS, TIME
from panelcast.operators.features import SERIES, ema_features


def _last(column: str, depth: int) -> str:
    """The last ``depth`` entries of an array, all of a shorter one."""
    return f"slice({column}, greatest(size({column}) - {depth}, 0) + 1, {depth})"


def build_state(df: DataFrame, depth: int = 7, value: str = "value", by: Sequence[str] = SERIES, t: str = TIME) -> DataFrame:
    """``(by..., times, recent)``: the last ``depth`` rows of every series, oldest first, nulls kept."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(t).alias("at"), F.col(value).alias("value"))))
    packed = df.groupBy(*by).agg(rows.alias("_w")).withColumn("_w", F.expr(_last("_w", depth)))
    return packed.select(*by, F.col("_w.at").alias("times"), F.col("_w.value").alias("recent"))


def _met(state: DataFrame, release: DataFrame, value: str, by: Sequence[str], t: str, how: str) -> DataFrame:
    """Rows of a release beside the state of their series; ``_at`` is null where the release has no row."""
    rows = release.select(*by, F.col(t).alias("_at"), F.col(value).alias("_value"))
    met = rows.join(state, list(by), how)
    stale = F.col("_at") <= F.element_at("times", -1)
    refuse = F.raise_error(F.concat(F.lit("a release is not later than the state: "), F.col("_at").cast("string")))
    return met.withColumn("_at", F.when(stale, refuse.cast("int")).otherwise(F.col("_at")))


def advance(state: DataFrame, release: DataFrame, depth: int = 7, value: str = "value",
            by: Sequence[str] = SERIES, t: str = TIME) -> DataFrame:
    """The state after a release: its rows join their series, others stay, new series begin."""
    met = _met(state, release, value, by, t, "full")

    def grown(old: str, new: str) -> Column:
        longer = f"CASE WHEN _at IS NULL THEN {old} ELSE concat(coalesce({old}, array()), array({new})) END"
        return F.expr(longer)

    longer = met.select(*by, grown("times", "_at").alias("times"), grown("recent", "_value").alias("recent"))
    return longer.select(*by, F.expr(_last("times", depth)).alias("times"), F.expr(_last("recent", depth)).alias("recent"))


def release_features(state: DataFrame, release: DataFrame, lookback: int = 6, value: str = "value",
                     by: Sequence[str] = SERIES, t: str = TIME) -> DataFrame:
    """The rows of a release with ``lag_1`` .. ``lag_lookback``, EMA and ``history``, as a run over all history gives them.

    The state must go back ``lookback`` rows at least.
    """
    met = _met(state, release, value, by, t, "left")
    lags = [F.try_element_at("recent", F.lit(-i)).alias(f"lag_{i}") for i in range(1, lookback + 1)]
    history = F.expr("concat(coalesce(recent, array()), array(_value))").alias("_all")
    rows = met.select(F.col("_at").alias(t), *by, F.col("_value").alias(value), *lags, history)
    return ema_features(rows, window=lookback + 1, value=value).withColumn("history", F.expr(_last("_all", lookback + 1))).drop("_all")


def release_samples(state: DataFrame, release: DataFrame, lookback: int = 6, value: str = "v",
                    keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Model samples that a release completes: ``x`` the (lookback+1) rows before it, ``y`` its row, at the time of the last of ``x``.

    Windows with a missing time are left out, as in ``window_samples``.
    """
    met = _met(state, release, value, keys, t, "inner").withColumn("times", F.expr(_last("times", lookback + 1)))
    whole = F.expr(f"times = sequence(_at - {lookback + 1}, _at - 1)")
    x = F.expr(_last("recent", lookback + 1))
    return met.where(whole).select(*keys, (F.col("_at") - 1).alias(t), x.alias("x"), F.col("_value").alias("y"))
