"""Window features and model samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import KEYS, TIME
from panelcast.functions.numeric import ema_steps_sql, max_when_sql

SERIES = (*KEYS, "metric")


def _order(by: Sequence[str], t: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(t)


def _shift(value: str, steps: int, by: Sequence[str], t: str, gap_aware: bool) -> Column:
    """The value ``steps`` rows (or time units) away; negative looks back."""
    if gap_aware:
        return F.max(value).over(_order(by, t).rangeBetween(steps, steps))
    return F.lead(value, steps).over(_order(by, t)) if steps > 0 else F.lag(value, -steps).over(_order(by, t))


def lag_features(df: DataFrame, k: int = 6, value: str = "value", by: Sequence[str] = SERIES,
                 t: str = TIME, gap_aware: bool = False) -> DataFrame:
    """``lag_1`` .. ``lag_k`` of every series.

    Row-based: a missing time does not yield null.  ``gap_aware`` looks up the exact time instead.
    """
    return df.select("*", *[_shift(value, -i, by, t, gap_aware).alias(f"lag_{i}") for i in range(1, k + 1)])


def lead_target(df: DataFrame, value: str = "value", by: Sequence[str] = SERIES, t: str = TIME,
                name: str = "y") -> DataFrame:
    """The next value of every series."""
    return df.withColumn(name, _shift(value, 1, by, t, gap_aware=False))


def history(df: DataFrame, n: int = 7, value: str = "value", by: Sequence[str] = SERIES, t: str = TIME) -> DataFrame:
    """The last ``n`` values, oldest first."""
    return df.withColumn("history", F.collect_list(value).over(_order(by, t).rowsBetween(1 - n, 0)))


def ema_features(df: DataFrame, span: int = 2, window: int = 7, keep: int = 5, value: str = "value") -> DataFrame:
    """EMA over lag_(window-1) .. lag_1, current; ``ema_keep`` (oldest) .. ``ema_1`` (current)."""
    last = ema_steps_sql([*[f"lag_{i}" for i in range(window - 1, 0, -1)], value], span)[-keep:]
    return df.selectExpr("*", *[f"{e} AS ema_{keep - i}" for i, e in enumerate(last)])


def panel_features(df: DataFrame, lookback: int = 6, value: str = "value", by: Sequence[str] = SERIES,
                   t: str = TIME) -> DataFrame:
    """Lags, next value and EMA together: one window, one sort."""
    return ema_features(lead_target(lag_features(df, lookback, value, by, t), value, by, t),
                        window=lookback + 1, value=value)


def row_sql(cols: Sequence[str]) -> str:
    """Array of the measures of one row."""
    return "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in cols) + ")"


def window_samples(df: DataFrame, cols: Sequence[str], lookback: int = 6, horizon: int = 1,
                   anchors: Sequence[int] | None = None, keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Model samples: ``x`` is (lookback+1) rows of measures, ``y`` the row(s) after.

    A range frame over the time axis replaces the self-join; windows with a
    missing time are left out.
    """
    w = _order(keys, t).rangeBetween(-lookback, horizon)
    framed = df.select(*keys, t, F.collect_list(F.expr(row_sql(cols))).over(w).alias("_w"))
    framed = framed.where(F.size("_w") == lookback + 1 + horizon)
    if anchors is not None:
        framed = framed.where(F.col(t).isin(*anchors))
    ahead = F.element_at("_w", -1) if horizon == 1 else F.slice("_w", lookback + 2, horizon)
    return framed.select(*keys, t, F.slice("_w", 1, lookback + 1).alias("x"), ahead.alias("y"))


def latest_window(df: DataFrame, cols: Sequence[str], at: int, lookback: int = 6,
                  keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """The last (lookback+1) rows up to time ``at`` of every entity that has them all."""
    recent = df.where(F.col(t).between(at - lookback, at))
    row = F.expr(f"struct({t}, {row_sql(cols)} AS v)")
    packed = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_w"))
    return packed.where(F.size("_w") == lookback + 1).select(*keys, F.transform("_w", lambda r: r["v"]).alias("x"))


def target_vector(x: str, i: int, m: int, lookback: int = 6, span: int = 2, keep: int = 5) -> Column:
    """Feature array of target ``i``: its current value, lags and EMA, and the others' current values (K4).

    ``x`` names a column holding (lookback+1) rows of ``m`` measures, oldest first.
    """
    own = [f"{x}[{step}][{i}]" for step in range(lookback + 1)]
    ema = ema_steps_sql(own, span)[-keep:]
    others = [f"{x}[{lookback}][{j}]" for j in range(m) if j != i]
    return F.expr(f"array({', '.join([*reversed(own), *ema, *others])})")


def target_positions(i: int, m: int, lookback: int = 6, keep: int = 5) -> list[int]:
    """Where the features of target ``i``, as in :func:`target_vector`, stand in those of :func:`window_features`."""
    block = lookback + 1 + keep
    return [*range(i * block, (i + 1) * block), *[j * block for j in range(m) if j != i]]


def window_matrix(x: np.ndarray, span: int = 2, keep: int = 5) -> np.ndarray:
    """For each measure of windows (rows, lookback + 1, measures) its current value, lags and EMA, side by side."""
    a = 2.0 / (span + 1)
    steps = [x[:, 0]]
    for k in range(1, x.shape[1]):
        steps.append(a * x[:, k] + (1 - a) * steps[-1])
    return np.concatenate([x[:, ::-1], np.stack(steps[-keep:], axis=1)], axis=1).transpose(0, 2, 1).reshape(len(x), -1)


def windows_of(column: pa.Array, measures: int) -> np.ndarray:
    """Windows of equal length as (rows, steps, measures); a missing value is NaN."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1, measures) if len(column) else flat.reshape(0, 0, measures)


def as_lists(values: np.ndarray) -> pa.Array:
    """An array of two or three dimensions as nested lists."""
    out = pa.array(np.ascontiguousarray(values, dtype=float).ravel())
    for axis in range(values.ndim - 1, 0, -1):
        rows = int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * values.shape[axis]), out)
    return out


def window_features(df: DataFrame, m: int, x: str = "x", out: str = "features") -> DataFrame:
    """Add the features of all targets of windows ``x`` in one array.

    Written out as expressions, hundreds of features are more code than the JVM compiles, so Arrow batches they are.
    """
    at = df.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(window_matrix(windows_of(batch.column(at), m)))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def target_features(features: DataFrame, target: str, metrics: Sequence[str], lookback: int = 6, keep: int = 5,
                    keys: Sequence[str] = KEYS, t: str = TIME, metric: str = "metric",
                    value: str = "value") -> DataFrame:
    """Wide feature table of one target from long features (K4)."""
    def of(name: str, column: str, alias: str) -> Column:
        return F.expr(f"{max_when_sql(column, metric, name)} AS `{alias}`")

    own = [*[f"lag_{i}" for i in range(1, lookback + 1)], *[f"ema_{i}" for i in range(keep, 0, -1)]]
    return features.groupBy(*keys, t).agg(
        of(target, value, target), *[of(target, c, f"{target}_{c}") for c in own],
        *[of(m, value, m) for m in metrics if m != target], of(target, "y", "y"))
