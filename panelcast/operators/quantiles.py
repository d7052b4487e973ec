"""Exact quantiles that never gather an unbounded group in one task.

One aggregated row, the size of the largest group and the number of groups, says how often groups must be
cut.  A cut takes a mergeable sketch of the raw column, sums the weights between its points where the rows are read, and opens
only the buckets that hold a wanted position; they are cut again until a bucket is small enough for one
window.  The sketch decides nothing but where the cuts fall, so the answer is exact however rough it is.
The result is a DataFrame in every case, nothing is cached or passes through the driver; opened buckets, if any, are
kept in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.sizing import cut_lineage, staged

BUCKETS = 64
SKETCH_ACCURACY = 2_000
# A bucket holds at most this share of what was cut: 1 / BUCKETS and the error of the sketch on both sides.
SHRINK = 32
# Rows a single window task may sort.
SMALL_GROUP = 200_000
# Groups up to which cuts and hits, a row for each group and position, are sent to the executors.
SENT_GROUPS = 10_000

Position = Callable[[Column], Column]


def _values_at(df: DataFrame, by: Sequence[str], x: str, positions: Sequence[Position],
               weight: str | None, right_closed: bool, small_group: int = SMALL_GROUP) -> DataFrame:
    """``(by, i, n, v)``: the value covering the i-th position on the cumulative weight axis.

    A position is a function of the group's total weight ``n``.  A value covers
    [before, upto), or (before, upto] if ``right_closed``.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), w.alias("_w"))
    if weight is not None:
        rows = rows.where("_w > 0")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"))
    largest, groups = sizes.agg(F.max("_d"), F.count(F.lit(1))).first()
    levels, left = 0, largest or 0
    while left > max(1, small_group):
        levels, left = levels + 1, left / SHRINK
    if not levels:
        return _in_windows(rows, by, positions, right_closed)
    return _in_buckets(rows, by, positions, right_closed, levels, F.broadcast if groups <= SENT_GROUPS else lambda df: df)


def _reached(cum: str, pos: Column, right_closed: bool) -> Column:
    return F.col(cum) >= pos if right_closed else F.col(cum) > pos


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Equal values of a group as one row with their weight."""
    return rows.groupBy(*by, "_x").agg(F.sum("_w").alias("_w"))


def _in_windows(rows: DataFrame, by: list[str], positions: Sequence[Position], right_closed: bool) -> DataFrame:
    """Positions of groups known to be small: one cumulative window."""
    ordered = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    running = _merged(rows, by).select(*by, "_x", F.sum("_w").over(ordered).alias("_cum"),
                                       F.sum("_w").over(Window.partitionBy(*by)).alias("n"))
    first = [F.coalesce(F.min(F.when(_reached("_cum", p(F.col("n")).cast("double"), right_closed), F.col("_x"))),
                        F.max("_x")) for p in positions]
    at = running.groupBy(*by, "n").agg(F.array(*first).alias("_v"))
    return at.select(*by, F.posexplode("_v").alias("i", "v"), "n")


def _in_buckets(rows: DataFrame, by: list[str], positions: Sequence[Position], right_closed: bool, levels: int,
                sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Positions of groups of any size: ``levels`` cuts, then a window over each bucket that holds one."""
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p(F.col("n")).cast("double").alias("_pos"))
                                 for i, p in enumerate(positions)])).alias("_p")
    asked = (rows.groupBy(*by).agg(F.sum("_w").alias("n")).select(*by, "n", wanted)
             .select(*by, "n", "_p.i", "_p._pos", F.lit(0.0).alias("_before")))
    path, cut = list(by), F.percentile_approx("_x", [i / BUCKETS for i in range(1, BUCKETS)], SKETCH_ACCURACY)
    for level in range(levels):
        b = f"_b{level}"
        cuts = rows.groupBy(*path).agg(cut.alias("_cuts"))
        bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
        placed = rows.join(sent(cuts), path).select(*path, bucket.alias(b), "_x", "_w")
        upto = Window.partitionBy(*path).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
        totals = placed.groupBy(*path, b).agg(F.sum("_w").alias("_bw"))
        spans = totals.select(*path, b, F.sum("_bw").over(upto).alias("_upto"), "_bw",
                              (F.max(b).over(Window.partitionBy(*path)) == F.col(b)).alias("_last"))
        pos, before, end = F.col("_pos"), F.col("_from"), F.col("_to")
        if right_closed:
            inside = ((pos > before) | F.col("_first")) & ((pos <= end) | F.col("_last"))
        else:
            inside = ((pos >= before) | F.col("_first")) & ((pos < end) | F.col("_last"))
        asked = (spans.join(sent(asked), path).withColumns({
            "_to": F.col("_before") + F.col("_upto"), "_from": F.col("_before") + F.col("_upto") - F.col("_bw"),
            "_first": F.col("_upto") == F.col("_bw")})
            .where(inside).select(*path, b, "n", "i", "_pos", F.col("_from").alias("_before")))
        path = [*path, b]
        # Both are small beside what was cut; written down, so the next cut reads nothing else.
        asked = cut_lineage(asked)
        rows = cut_lineage(placed.join(sent(asked.select(*path).distinct()), path, "left_semi"))
    within = Window.partitionBy(*path).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    running = _merged(rows, path).select(*path, "_x", F.sum("_w").over(within).alias("_in"))
    first = F.coalesce(F.min(F.when(_reached("_cum", F.col("_pos"), right_closed), F.col("_x"))), F.max("_x"))
    return (running.join(sent(asked), path).withColumn("_cum", F.col("_before") + F.col("_in"))
            .groupBy(*by, "i", "n").agg(first.alias("v")))


def _level(p: Column, n: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * (n - 1)


def exact_quantiles(df: DataFrame, x: str, levels: Sequence[float | Position], by: Sequence[str] = (),
                    small_group: int = SMALL_GROUP) -> DataFrame:
    """``(by, level, n, value)``: linear-interpolation quantiles of every group.

    A level is a number or a function of the group size giving one (A10); such
    functions may also use the group columns, and report their level as null.
    """
    groups = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    fns = [lv if callable(lv) else (lambda n, lv=lv: F.lit(float(lv))) for lv in levels]
    ends = []
    for fn in fns:
        ends += [lambda n, fn=fn: F.floor(_level(fn(n), n)), lambda n, fn=fn: F.ceil(_level(fn(n), n))]
    at = _values_at(df, groups, x, ends, None, False, small_group)
    which = F.floor(F.col("i") / 2).cast("int")
    pairs = at.groupBy(*groups, "n", which.alias("_k")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("_lo"),
        F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("_hi"))
    h = F.lit(None).cast("double")
    level = F.lit(None).cast("double")
    for k, (lv, fn) in enumerate(zip(levels, fns)):
        h = F.when(F.col("_k") == k, _level(fn(F.col("n")), F.col("n"))).otherwise(h)
        level = F.when(F.col("_k") == k, F.lit(None if callable(lv) else float(lv))).otherwise(level)
    value = F.col("_lo") + (h - F.floor(h)) * (F.col("_hi") - F.col("_lo"))
    return pairs.select(*by, level.alias("level"), F.col("n").cast("long").alias("n"), value.alias("value"))


def weighted_quantiles(df: DataFrame, x: str, weight: str, levels: Sequence[float],
                       by: Sequence[str] = (), small_group: int = SMALL_GROUP) -> DataFrame:
    """``(by, level, value)``: smallest value whose cumulative weight reaches the level."""
    groups = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    at = _values_at(df, groups, x, [lambda n, lv=lv: n * F.lit(float(lv)) for lv in levels], weight, True,
                    small_group)
    level = F.element_at(F.array(*[F.lit(float(lv)) for lv in levels]), F.col("i") + 1)
    return at.select(*by, level.alias("level"), F.col("v").alias("value"))


def conformal_level(n: Column, alpha: Column) -> Column:
    """``(n + 1)(1 - alpha) / n``, at most 1."""
    return F.least(F.lit(1.0), (n + 1) * (1 - alpha) / n)


def conformal_qhat(scores: DataFrame, by: Sequence[str] = ("target",), alpha: str = "alpha",
                   score: str = "score") -> DataFrame:
    """``(by, alpha, n, qhat, clamped)``: the finite-sample corrected quantile of the scores (A10).

    ``clamped`` marks groups too small for their level, which would pass 1.  The scores are made once and written.
    """
    q = exact_quantiles(staged(scores.select(*by, alpha, score)), score, [lambda n: conformal_level(n, F.col(alpha))], by=(*by, alpha))
    over = (F.col("n") + 1) * (1 - F.col(alpha)) / F.col("n") > 1
    return q.select(*by, alpha, "n", F.col("value").alias("qhat"), over.alias("clamped"))
