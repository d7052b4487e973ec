"""Recursive projection and one-step backtest (K8, K9).

An entity's future depends on its own history and shared models only, so its state
is one row and every step is a narrow projection: nothing is shuffled after the
histories are packed.  Quantile paths are separate rows, each fed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import KEYS, RESIDUAL, TIME
from panelcast.functions.numeric import weighted_sum_sql
from panelcast.operators.features import SERIES, as_lists, window_features, window_matrix, windows_of
from panelcast.operators.forest import QuantileForestModel
from panelcast.operators.shape import with_quantile_dim
from panelcast.operators.sizing import cut_lineage
from panelcast.operators.trees import bins_of


@dataclass(frozen=True)
class LinearScorer:
    """Next value as a weighted sum of the last ones (oldest first), widened by quantile."""

    weights: Sequence[float]
    spread: float = 0.0

    @property
    def lookback(self) -> int:
        return len(self.weights)

    def next_sql(self, path: str, q: str) -> str:
        """Expression of the value after the end of array ``path`` on quantile path ``q``."""
        last = [f"element_at({path}, {i - self.lookback})" for i in range(self.lookback)]
        return f"{weighted_sum_sql(self.weights, last)} * (1 + {float(self.spread)!r}D * ({q} - 0.5D))"


# One floor for all measures, or one per measure (such as the standardized zero); the residual never has one.
Floor = float | Mapping[str, float]


def _floor_of(floor: Floor, metric: str) -> float | None:
    if metric == RESIDUAL:
        return None
    return floor.get(metric) if isinstance(floor, Mapping) else float(floor)


def _floor_sql(by: Sequence[str], floor: Floor) -> str:
    """The floor of a series; null, hence none, for the residual."""
    if isinstance(floor, Mapping):
        cases = " ".join(f"WHEN '{m}' THEN {float(v)!r}D" for m, v in floor.items() if m != RESIDUAL)
        return f"CASE metric {cases} END"
    return f"CASE WHEN metric <> '{RESIDUAL}' THEN {float(floor)!r}D END" if "metric" in by else f"{float(floor)!r}D"


def conformal_shift(qhat: Mapping[tuple[str, float], float], metric: str, level: float) -> float:
    """What conformal calibration adds to a measure's prediction at a quantile level.

    An empty ``qhat`` means uncalibrated; one without this measure and level is an error.
    """
    sign = -1.0 if level < 0.5 else 1.0 if level > 0.5 else 0.0
    if not sign or not qhat:
        return 0.0
    key = (metric, round(min(level, 1 - level), 6))
    if key not in qhat:
        raise KeyError(f"no qhat for {key}")
    return sign * qhat[key]


def project_linear(df: DataFrame, scorer: LinearScorer, at: int, steps: int, quantiles: Sequence[float],
                   floor: Floor = 0.0, by: Sequence[str] = SERIES, t: str = TIME, value: str = "value") -> DataFrame:
    """``(by, q, t, value)`` for the ``steps`` times after ``at``, in a single plan (K8)."""
    n = scorer.lookback
    recent = df.where(F.col(t).between(at - n + 1, at))
    packed = recent.groupBy(*by).agg(F.expr(f"sort_array(collect_list(struct({t}, {value})))").alias("_h"))
    packed = packed.where(F.size("_h") == n).selectExpr(*by, f"_h.{value} AS _h", f"{_floor_sql(by, floor)} AS _floor")
    grow = f"(path, i) -> concat(path, array(greatest({scorer.next_sql('path', 'q')}, _floor)))"
    paths = with_quantile_dim(packed, quantiles).selectExpr(
        *by, "q", f"slice(aggregate(sequence(1, {steps}), _h, {grow}), {n + 1}, {steps}) AS _p")
    return (paths.selectExpr(*by, "q", f"posexplode(_p) AS (_i, {value})")
            .selectExpr(*by, "q", f"CAST(_i + {at + 1} AS INT) AS {t}", value))


def backtest(df: DataFrame, scorer: LinearScorer, years: Sequence[int], floor: Floor = 0.0,
             by: Sequence[str] = SERIES, t: str = TIME, value: str = "value") -> DataFrame:
    """``(by, t, pred, actual)``: each year predicted from actual history up to the year before (K9).

    All years come from one window pass; no loop.
    """
    n = scorer.lookback
    w = Window.partitionBy(*by).orderBy(t)
    framed = df.select(*by, t, F.collect_list(value).over(w.rangeBetween(1 - n, 0)).alias("_h"),
                       F.max(value).over(w.rangeBetween(1, 1)).alias("actual"))
    anchors = framed.where(F.col(t).isin(*[y - 1 for y in years]) & (F.size("_h") == n)
                           & F.col("actual").isNotNull())
    pred = f"greatest({scorer.next_sql('_h', '0.5D')}, {_floor_sql(by, floor)})"
    return anchors.selectExpr(*by, f"CAST({t} + 1 AS INT) AS {t}", f"{pred} AS pred", "actual")


def _paths_to_long(state: DataFrame, metrics: Sequence[str], at: int, lookback: int, keys: Sequence[str],
                   t: str) -> DataFrame:
    cells = ", ".join(f"struct('{m}' AS metric, _row[{i}] AS value)" for i, m in enumerate(metrics))
    future = f"slice(x, {lookback + 2}, size(x) - {lookback + 1})"
    return (state.selectExpr(*keys, "q", f"posexplode({future}) AS (_i, _row)")
            .selectExpr(*keys, "q", f"CAST(_i + {at + 1} AS INT) AS {t}", f"inline(array({cells}))"))


def _clipped_sql(value: str, floor: float | None) -> str:
    return value if floor is None else f"greatest({value}, {float(floor)!r}D)"


def project_forest(windows: DataFrame, model: QuantileForestModel, qhat: Mapping[tuple[str, float], float], at: int, steps: int,
                   quantiles: Sequence[float], floor: Floor = 0.0, lookback: int = 6, keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Projection with a quantile forest of all measures (K8).

    ``windows`` holds ``(keys, x)`` from :func:`latest_window`, its columns in the order
    of the model's targets.  Each step scores every measure, moves it by its conformal shift,
    clips it and appends the row.  While the forests fit a task, all steps of an entity are one pass; larger ones are applied
    step by step, in slices, with the state written in between and cut back to one window.
    """
    metrics, m = list(model.targets), len(model.targets)
    levels = sorted({float(q) for q in quantiles})
    shift = np.array([[conformal_shift(qhat, name, q) for name in metrics] for q in levels])
    floors = [_floor_of(floor, name) for name in metrics]
    state = with_quantile_dim(windows.select(*keys, "x"), levels)
    held = model.held()
    if len(held) > 1:
        return _project_by_step(state, model, shift, floors, at, steps, levels, lookback, keys, t)
    bottom = np.array([-np.inf if f is None else f for f in floors])
    shared, cuts = held[0], model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            past = windows_of(batch.column("x"), m)
            path = np.concatenate([past, np.empty((len(past), steps, m))], axis=1)
            which = np.searchsorted(levels, batch.column("q").to_numpy())
            for end in range(past.shape[1], path.shape[1]):
                x = bins_of(window_matrix(path[:, end - lookback - 1:end]), cuts)
                for i in range(m):
                    drawn = shared.value[i].values(x)
                    for k, q in enumerate(levels):
                        mine = which == k
                        path[mine, end, i] = np.quantile(drawn[mine], q, axis=1)
                path[:, end] = np.maximum(path[:, end] + shift[which], bottom)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "q")), as_lists(path)], [*keys, "q", "x"])

    out = T.StructType([state.schema[c] for c in (*keys, "q")] + [T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return _paths_to_long(state.select(*keys, "q", "x").mapInArrow(run, out), metrics, at, lookback, keys, t)


def _project_by_step(state: DataFrame, model: QuantileForestModel, shift: np.ndarray, floors: Sequence[float | None], at: int, steps: int,
                     levels: Sequence[float], lookback: int, keys: Sequence[str], t: str) -> DataFrame:
    metrics = list(model.targets)
    which = "CASE q " + " ".join(f"WHEN {v!r}D THEN {i}" for i, v in enumerate(levels)) + " END"
    moved = ["CASE q " + " ".join(f"WHEN {v!r}D THEN {float(shift[k, i])!r}D" for k, v in enumerate(levels)) + " END" for i in range(len(metrics))]
    row = ", ".join(_clipped_sql(f"_p[{i}][{which}] + {moved[i]}", f) for i, f in enumerate(floors))
    window = f"slice(x, -{lookback + 1}, {lookback + 1})"
    out = None
    for step in range(steps):
        framed = window_features(state, len(metrics), out="_f")
        scored = model.predict_all(framed, levels, "_f", "_p")
        state = cut_lineage(scored.selectExpr(*keys, "q", f"concat(x, array(array({row}))) AS x"))
        part = _paths_to_long(state, metrics, at + step, lookback, keys, t)
        out = part if out is None else out.unionByName(part)
        state = state.withColumn("x", F.expr(window))
    return out


def backtest_forest(samples: DataFrame, model: QuantileForestModel, floor: Floor = 0.0, keys: Sequence[str] = KEYS,
                    t: str = TIME) -> DataFrame:
    """``(keys, t, metric, pred, actual)``: medians for the time after each sample of actual history (K9)."""
    rows = window_features(samples.select(*keys, t, "x", "y"), len(model.targets), out="_f").drop("x")
    scored = model.predict_all(rows, [0.5], "_f", "_p")
    cells = ", ".join(f"struct('{m}' AS metric, {_clipped_sql(f'_p[{i}][0]', _floor_of(floor, m))} AS pred, "
                      f"y[{i}] AS actual)" for i, m in enumerate(model.targets))
    return scored.selectExpr(*keys, f"CAST({t} + 1 AS INT) AS {t}", f"inline(array({cells}))")


Scorer = Callable[[np.ndarray, float], np.ndarray]


def project_sequences(windows: DataFrame, scorer: Scorer, metrics: Sequence[str], at: int, steps: int,
                      quantiles: Sequence[float], qhat: Mapping[tuple[str, float], float] | None = None,
                      floor: Floor = 0.0, lookback: int = 6, keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """Projection with any model of whole windows: ``scorer((n, lookback+1, m), q) -> (n, m)`` (K8).

    The scorer sees batches of entities as arrays; all steps of a batch run in one task.
    """
    keys, m = list(keys), len(metrics)
    floors = [_floor_of(floor, name) for name in metrics]
    bottom = np.array([-np.inf if f is None else f for f in floors])
    shifts = {float(q): np.array([conformal_shift(qhat or {}, name, q) for name in metrics]) for q in quantiles}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column("q").to_numpy()
            for q in np.unique(levels):
                part = batch.filter(pa.array(levels == q))
                past = windows_of(part.column("x"), m)
                path = np.concatenate([past, np.empty((len(past), steps, m))], axis=1)
                for end in range(past.shape[1], path.shape[1]):
                    nxt = np.asarray(scorer(path[:, end - lookback - 1:end, :], float(q))).reshape(-1, m) + shifts[q]
                    path[:, end] = np.maximum(nxt, bottom)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, "q")), as_lists(path)], [*keys, "q", "x"])

    state = with_quantile_dim(windows.select(*keys, "x"), quantiles)
    out = T.StructType([state.schema[c] for c in (*keys, "q")] +
                       [T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType())))])
    paths = state.select(*keys, "q", "x").mapInArrow(run, out)
    return _paths_to_long(paths, metrics, at, lookback, keys, t)


def score_sequences(samples: DataFrame, scorer: Scorer, metrics: Sequence[str], quantiles: Sequence[float] = (0.5,),
                    floor: Floor | None = None, keys: Sequence[str] = KEYS, t: str = TIME) -> DataFrame:
    """``(target, keys, t, q, pred, y)`` for the time after each sample, from actual history (K9).

    Without a floor these are the calibration predictions of K6; with one, the back-test.
    """
    keys, m = list(keys), len(metrics)
    floors = [None if floor is None else _floor_of(floor, name) for name in metrics]
    bottom = np.array([-np.inf if f is None else f for f in floors])
    levels = [float(q) for q in quantiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, t, "y"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = windows_of(batch.column("x"), m)
            for q in levels:
                pred = np.maximum(np.asarray(scorer(x, q), dtype=float).reshape(-1, m), bottom)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(np.full(len(x), q)), as_lists(pred)], [*names, "q", "pred"])

    rows = samples.select(*keys, t, "x", "y")
    out = T.StructType([rows.schema[c] for c in (*keys, t, "y")] + [
        T.StructField("q", T.DoubleType()), T.StructField("pred", T.ArrayType(T.DoubleType()))])
    cells = ", ".join(f"struct('{name}' AS target, pred[{i}] AS pred, y[{i}] AS y)" for i, name in enumerate(metrics))
    return rows.mapInArrow(run, out).selectExpr(
        *keys, f"CAST({t} + 1 AS INT) AS {t}", "q", f"inline(array({cells}))")
