"""Soft-DTW distances and clustering of entity series (K1, K2).

Distances are taken from every series to ``k`` centres, never between all pairs of
series, so the work is linear in the number of entities.  The numpy kernels below
run inside tasks on batches that Spark has partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import KEYS, TIME, measures
from panelcast.operators.features import row_sql
from panelcast.operators.sizing import cut_lineage, spread

# Cells (centres x steps x measures) that may travel to every task and back to the driver.
MAX_CENTRE_CELLS = 20_000_000
# Cells worked on at a time inside a task.
CHUNK_CELLS = 4_000_000
# Cells of the distance tables swept together: they fit a core's cache.
TABLE_CELLS = 400_000
# Members of a cluster that meet as many others in one group; small clusters share one.
SLICE = 256


def entity_series(df: DataFrame, n: int, cols: Sequence[str] | None = None, keys: Sequence[str] = KEYS,
                  t: str = TIME) -> DataFrame:
    """``(keys, series)``: an n x measures matrix per entity with all ``n`` time points."""
    cols = list(measures(df, (t, *keys)) if cols is None else cols)
    row = F.expr(f"struct({t}, {row_sql(cols)} AS v)")
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_s"))
    return packed.where(F.size("_s") == n).select(*keys, F.transform("_s", lambda r: r["v"]).alias("series"))


def sweep(costs: np.ndarray, gamma: float = 0.0) -> np.ndarray:
    """Soft-DTW of n pairs from their costs (T, S, n); DTW if ``gamma`` is 0.

    Cells of an anti-diagonal lie at even distances in the table, so they are taken together without copies, and only the last two are kept.
    The softened minimum is the minimum, to the last bit, unless another value is within 40 ``gamma`` of it; only such cells take exponentials.
    """
    steps, width, n = costs.shape
    cells = costs.reshape(steps * width, n)
    two, one, now = (np.full((steps + 1, n), np.inf) for _ in range(3))
    two[0] = 0.0
    for total in range(2, steps + width + 1):
        lo, hi = max(1, total - width), min(steps, total - 1)
        cost = cells[(lo - 1) * width + total - lo - 1::max(1, width - 1)][:hi - lo + 1]
        a, b, c, r = two[lo - 1:hi], one[lo - 1:hi], one[lo:hi + 1], now[lo:hi + 1]
        low = np.minimum(a, b)
        if gamma:
            second = np.minimum(np.maximum(a, b), np.maximum(low, c))
        np.minimum(low, c, out=low)
        np.add(cost, low, out=r)
        if gamma:
            close = np.flatnonzero(second - low < 40 * gamma)
            if len(close):
                before = np.stack([v.reshape(-1)[close] for v in (a, b, c)])
                # Below -60 a share is lost beside the minimum's 1, and exponentials are slow.
                share = np.exp(np.maximum(-(before - low.reshape(-1)[close]) / gamma, -60.0))
                r.reshape(-1)[close] -= gamma * np.log(share.sum(0))
        if lo == 1:
            now[0] = np.inf
        if hi < steps:
            now[hi + 1] = np.inf
        two, one, now = one, now, two
    return one[steps].copy()


def _pairs_at_once(steps: int, width: int) -> int:
    return max(16, TABLE_CELLS // (steps * width))


def pair_distances(x: np.ndarray, centres: np.ndarray, i: np.ndarray, j: np.ndarray, gamma: float) -> np.ndarray:
    """Soft-DTW (DTW if ``gamma`` is 0) of the pairs (x[i], centres[j]); a pair's value doesn't depend on what is computed beside it."""
    found = np.empty(len(i))
    size = _pairs_at_once(x.shape[1], centres.shape[1])
    for lo in range(0, len(i), size):
        a, b = x[i[lo:lo + size]], centres[j[lo:lo + size]]
        d = (a ** 2).sum(-1)[:, :, None] + (b ** 2).sum(-1)[:, None, :] - 2 * a @ np.swapaxes(b, -1, -2)
        found[lo:lo + size] = sweep(np.ascontiguousarray(np.moveaxis(np.maximum(d, 0.0), 0, -1)), gamma)
    return found


def soft_dtw_kernel(gamma: float):
    """``(values, alignment)`` functions of a batch of series (n, T, m) against one centre (S, m)."""

    def diagonals(steps, width):
        """Cells (i, j) of each anti-diagonal: independent of one another, so done together."""
        for total in range(2, steps + width + 1):
            i = np.arange(max(1, total - width), min(steps, total - 1) + 1)
            yield i, total - i

    def table(x, centre):
        """Cumulated costs of series against one centre."""
        d = (x ** 2).sum(-1)[:, :, None] + (centre ** 2).sum(-1)[..., None, :] - 2 * x @ np.swapaxes(centre, -1, -2)
        d = np.maximum(d, 0.0)
        n, steps, width = d.shape
        r = np.full((n, steps + 1, width + 1), np.inf)
        r[:, 0, 0] = 0.0
        for i, j in diagonals(steps, width):
            before = np.stack([r[:, i - 1, j - 1], r[:, i - 1, j], r[:, i, j - 1]])
            low = before.min(0)
            r[:, i, j] = d[:, i - 1, j - 1] + low - gamma * np.log(np.exp(-(before - low) / gamma).sum(0))
        return r

    def values(x, centre):
        centres = centre if centre.ndim == 3 else centre[None]
        return pair_distances(x, centres, np.arange(len(x)), np.arange(len(x)) if centre.ndim == 3 else np.zeros(len(x), int), gamma)

    def alignment(x, centre):
        """Expected alignment (n, T, S): how much each step of a series is matched to each step of the centre."""
        r = table(x, centre)
        n, steps, width = r.shape[0], r.shape[1] - 1, r.shape[2] - 1
        e = np.zeros((n, steps + 1, width + 1))
        e[:, steps, width] = 1.0
        for i, j in reversed(list(diagonals(steps, width))):
            before = np.stack([r[:, i - 1, j - 1], r[:, i - 1, j], r[:, i, j - 1]])
            share = np.exp(-(before - before.min(0)) / gamma)
            share = e[:, i, j] * share / share.sum(0)
            e[:, i - 1, j - 1] += share[0]
            e[:, i - 1, j] += share[1]
            e[:, i, j - 1] += share[2]
        return e[:, 1:, 1:]

    return values, alignment


def _check_centres(centres: np.ndarray) -> None:
    if centres.size > MAX_CENTRE_CELLS:
        raise ValueError(f"{centres.shape[0]} centres of {centres.shape[1:]} exceed {MAX_CENTRE_CELLS} cells")


def _on_series(df: DataFrame, centres: np.ndarray, keys: Sequence[str], schema: T.StructType | str, work) -> DataFrame:
    """Run ``work(keys of a chunk, series (n, T, m), centres)`` over Arrow batches; it yields record batches.

    Centres are broadcast once, after a check of their size.
    """
    _check_centres(centres)
    shared = df.sparkSession.sparkContext.broadcast(centres)
    keys, chunk_cells = list(keys), CHUNK_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value

        def chunks():
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = centres.shape[2]
                x = np.asarray(batch.column("series").flatten().flatten()).reshape(batch.num_rows, -1, m)
                size = max(1, chunk_cells // (x.shape[1] * (m + 4 * centres.shape[1])))
                for lo in range(0, len(x), size):
                    yield [batch.column(k).slice(lo, size) for k in keys], x[lo:lo + size]

        yield from work(chunks(), centres)

    return df.select(*dict.fromkeys([*keys, "series"])).mapInArrow(run, schema)


def _keyed(series: DataFrame, keys: Sequence[str], column: str) -> T.StructType:
    return T.StructType([series.schema[k] for k in keys] + [
        T.StructField(column, T.IntegerType()), T.StructField("distance", T.DoubleType())])


def series_distances(series: DataFrame, centres: np.ndarray, gamma: float = 0.01,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, centre, distance)``: soft-DTW of every series to every centre (K1)."""
    values, _ = soft_dtw_kernel(gamma)
    names = [*keys, "centre", "distance"]

    def work(chunks, centres):
        for ids, x in chunks:
            for c, centre in enumerate(centres):
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(np.full(len(x), c + 1, dtype="int32")), pa.array(values(x, centre))], names)

    return _on_series(series, centres, keys, _keyed(series, keys, "centre"), work)


def path_slack(steps: int, width: int, gamma: float) -> float:
    """By how much soft-DTW can fall below DTW: ``gamma`` times the logarithm of the number of paths, of which there are at most 3^(T+S)."""
    return gamma * (steps + width) * float(np.log(3))


def nearest_centres(x: np.ndarray, centres: np.ndarray, gamma: float, among: np.ndarray | None = None, nearest: np.ndarray | None = None,
                    best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, distance, soft alignments computed) of the nearest centre of each series; ties go to the lower number.

    Plain DTW lies above soft-DTW by at most ``path_slack`` and is far cheaper, so only centres whose DTW is within that of the least are aligned
    softly.  A path starts and ends with both series, which bounds DTW from below; centres beyond the least DTW by that bound are skipped.
    Given the ``nearest`` centres and their distances ``best`` so far, only the centres ``among`` are tried against them.
    """
    n, steps, m = x.shape
    width = centres.shape[1]
    among = np.arange(len(centres)) if among is None else among
    fresh = nearest is None
    nearest = np.full(n, -1) if fresh else nearest.copy()
    best = np.full(n, np.inf) if fresh else best.astype(float)
    if not n or not len(among):
        return nearest, best, 0
    tried, made, slack = centres[among], 0, path_slack(steps, width, gamma)
    square = (tried ** 2).sum(-1)
    # Squared distances of all steps as one product.
    sides = np.concatenate([-2 * tried, np.ones((len(among), width, 1)), square[..., None]], axis=-1)
    size = _pairs_at_once(steps, width)
    for lo in range(0, n, size):
        part = x[lo:lo + size]
        own = (part ** 2).sum(-1)
        flat = np.ascontiguousarray(np.concatenate([part, own[..., None], np.ones((*own.shape, 1))], axis=-1).transpose(1, 2, 0))
        # What rounding may add to a sum of squares along a path.
        slip = 1e-12 * (steps + width) * (own.max() + square.max())
        ends = own[:, :1] + square[:, 0] - 2 * part[:, 0] @ tried[:, 0].T
        if steps + width > 2:
            ends = ends + own[:, -1:] + square[:, -1] - 2 * part[:, -1] @ tried[:, -1].T
        ends = ends - (slack + 2 * slip)
        hard = np.full(ends.shape, np.inf)
        least = best[lo:lo + size].copy()
        if fresh:
            rows, first = np.arange(len(part)), ends.argmin(axis=1)
            hard[rows, first] = pair_distances(part, tried, rows, first, 0.0)
            least = hard[rows, first] + slip
        few = []
        for c in np.flatnonzero((ends <= least[:, None]).any(axis=0)):
            rows = np.flatnonzero((ends[:, c] <= least) & (hard[:, c] == np.inf))
            if 4 * len(rows) < len(part):
                few.append((rows, np.full(len(rows), c)))
                continue
            hard[:, c] = sweep(sides[c] @ flat)
            least = np.minimum(least, hard[:, c] + slip)
        if few:
            rows, c = (np.concatenate(v) for v in zip(*few, strict=True))
            open_ = ends[rows, c] <= least[rows]
            rows, c = rows[open_], c[open_]
            hard[rows, c] = pair_distances(part, tried, rows, c, 0.0)
            least = np.minimum(least, hard.min(axis=1) + slip)
        rows, c = np.nonzero(hard - (slack + slip) <= least[:, None])
        made += len(rows)
        soft = pair_distances(part, tried, rows, c, gamma)
        order = np.lexsort((among[c], soft, rows))
        rows, at = np.unique(rows[order], return_index=True)
        soft, c, rows = soft[order][at], among[c[order][at]], rows + lo
        closer = (soft < best[rows]) | ((soft == best[rows]) & (c < nearest[rows])) | (nearest[rows] < 0)
        nearest[rows[closer]], best[rows[closer]] = c[closer], soft[closer]
    best[nearest < 0] = np.nan
    return np.maximum(nearest, 0), best, made


def assign_clusters(series: DataFrame, centres: np.ndarray, gamma: float = 0.01,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, cluster, distance)``: the nearest centre of every series; ties go to the lower number."""
    names = [*keys, "cluster", "distance"]

    def work(chunks, centres):
        for ids, x in chunks:
            nearest, best, _ = nearest_centres(x, centres, gamma)
            yield pa.RecordBatch.from_arrays([*ids, pa.array((nearest + 1).astype("int32")), pa.array(best)], names)

    return _on_series(series, centres, keys, _keyed(series, keys, "cluster"), work)


def reassign(state: DataFrame, centres: np.ndarray, gamma: float, keys: Sequence[str], numbers: np.ndarray | None = None,
             known: np.ndarray | None = None, was: bool = False) -> DataFrame:
    """``(keys, series, cluster, distance)``: the nearest centre of every series.

    ``state`` has the same columns, if ``numbers`` and ``known`` are given, else keys and series: ``numbers`` holds, for each centre it was made with,
    its place among ``centres`` (-1 if none), and ``known`` says which of ``centres`` are as they were.  A series whose centre is known
    is aligned to the other centres only.  With ``was``, that column holds the place (from 1) of its centre so far, 0 if it has none.
    """
    before = [] if known is None else ["cluster", "distance"]
    passed = [*keys, "series"]
    names = [*passed, "cluster", "distance"]
    schema = T.StructType([state.schema[c] for c in passed] + [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    if was:
        names, schema = [*names, "was"], schema.add("was", T.IntegerType())

    def work(chunks, centres):
        for ids, x in chunks:
            so_far = np.full(len(x), -1)
            if known is None:
                nearest, best, _ = nearest_centres(x, centres, gamma)
            else:
                so_far = numbers[ids[-2].to_numpy() - 1]
                nearest, best = so_far.copy(), np.array(ids[-1].to_numpy(zero_copy_only=False), dtype=float)
                stays = (nearest >= 0) & known[nearest]
                nearest[stays], best[stays], _ = nearest_centres(x[stays], centres, gamma, np.flatnonzero(~known), nearest[stays], best[stays])
                nearest[~stays], best[~stays], _ = nearest_centres(x[~stays], centres, gamma)
            out = [*ids[:len(passed)], pa.array((nearest + 1).astype("int32")), pa.array(best)]
            yield pa.RecordBatch.from_arrays([*out, pa.array((so_far + 1).astype("int32"))] if was else out, names)

    return _on_series(state, centres, [*passed, *before], schema, work)


def _chance(seed: int, salt: str, keys: Sequence[str]) -> Column:
    """A number in [0, 1) for every entity, by hash."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}:{salt}"), *[F.col(c).cast("string") for c in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _fetched(series: DataFrame, at_most: int) -> np.ndarray:
    """A few series as (n, T, m)."""
    rows = series.select("series").limit(at_most + 1).toArrow()
    if rows.num_rows > at_most:
        raise ValueError(f"more than {at_most} series")
    return _matrices(rows)


def _matrices(rows: pa.Table, name: str = "series") -> np.ndarray:
    """A column of series as (n, T, m)."""
    if not rows.num_rows:
        return np.array([])
    column = rows.column(name).combine_chunks()
    return np.asarray(column.flatten().flatten(), dtype=float).reshape(rows.num_rows, len(column[0]), -1)


def seed_centres(series: DataFrame, k: int, gamma: float = 0.01, seed: int = 123, rounds: int = 4, oversampling: float = 0.5,
                 keys: Sequence[str] = KEYS) -> np.ndarray:
    """``k`` series far apart, by oversampling (k-means||).

    Each round adds every series with a chance in proportion to its distance to the candidates so far, about ``oversampling * k`` of them;
    chances are hashes.  The candidates, weighted by how many series are nearest to them, are then thinned out on the driver: some ``rounds *
    oversampling * k`` series and their distances, however many series there are.
    """
    order = _chance(seed, "start", keys)
    some = series.orderBy(order, *keys).limit(max(1, k // 4))
    found = _fetched(some, k)
    chosen = cut_lineage(some.select(*keys))
    wanted = max(1.0, oversampling * k)
    far, seen = series, 0

    def assigned():
        """Every series with its nearest candidate; a round aligns it to the candidates of the round before only."""
        if not seen:
            return reassign(series, found, gamma, keys)
        return reassign(far, found, gamma, keys, np.arange(seen), np.arange(len(found)) < seen)

    for n in range(rounds):
        _check_centres(found)
        state = cut_lineage(assigned())
        far, seen = state, len(found)
        reach = F.greatest("distance", F.lit(0.0))
        total = far.agg(F.sum(reach)).first()[0] or 0.0
        if total <= 0:
            break
        lucky = far.where(_chance(seed, f"round {n}", keys) < reach * (wanted / total)).select(*keys)
        lucky = cut_lineage(lucky.join(chosen, list(keys), "left_anti"))
        more = _fetched(series.join(F.broadcast(lucky), list(keys), "left_semi").orderBy(*keys), int(20 * wanted) + 100)
        if len(more):
            found, chosen = np.concatenate([found, more]), chosen.unionByName(lucky)
    if len(found) < k:
        rest = series.join(chosen, list(keys), "left_anti").orderBy(order, *keys).limit(k - len(found))
        more = _fetched(rest, k)
        found = np.concatenate([found, more]) if len(more) else found
    if len(found) <= k:
        return found
    weight = np.zeros(len(found))
    for row in assigned().groupBy("cluster").count().collect():
        weight[row["cluster"] - 1] = row["count"]
    return found[_spread_out(_all_distances(series.sparkSession, found, gamma), weight, k)]


def _all_distances(spark: SparkSession, found: np.ndarray, gamma: float) -> np.ndarray:
    """Soft-DTW, not below 0, between a bounded number of series on the driver; a task takes some rows of the matrix."""
    n, steps, m = found.shape
    inner = pa.ListArray.from_arrays(np.arange(0, n * steps * m + 1, m, dtype="int32"), pa.array(found.ravel()))
    table = pa.table({"i": pa.array(np.arange(n, dtype="int32")),
                      "series": pa.ListArray.from_arrays(np.arange(0, n * steps + 1, steps, dtype="int32"), inner)})

    def work(chunks, centres):
        every = np.arange(len(centres))
        for ids, x in chunks:
            for i in range(len(x)):
                d = np.maximum(pair_distances(x, centres, np.full(len(every), i), every, gamma), 0.0)
                yield pa.RecordBatch.from_arrays([ids[0].slice(i, 1), pa.array([d])], ["i", "d"])

    candidates = spread(spark.createDataFrame(table, "i int, series array<array<double>>"), "i", times=2)
    cells = _on_series(candidates, found, ["i"], "i int, d array<double>", work).toArrow()
    apart = np.zeros((n, n))
    apart[cells["i"].to_numpy()] = np.asarray(cells["d"].combine_chunks().flatten()).reshape(n, n)
    return apart


def _spread_out(apart: np.ndarray, weight: np.ndarray, k: int) -> list[int]:
    """``k`` of the candidates one after the other, each time that which takes most off the weighted distances.

    What a candidate takes off never grows, so candidates are valued anew, 32 at a time, only while their last value reaches the best one.
    """
    taken = [int(weight.argmax())]
    least = apart[:, taken[0]].copy()
    gain = np.full(len(apart), np.inf)
    while len(taken) < k:
        gain[taken] = -1
        order, best = np.argsort(-gain, kind="stable"), -1.0
        for lo in range(0, len(order), 32):
            some = order[lo:lo + 32]
            if gain[some[0]] < best:
                break
            gain[some] = (weight[:, None] * np.maximum(least[:, None] - apart[:, some], 0)).sum(axis=0)
            best = max(best, gain[some].max())
        gain[taken] = -1
        taken.append(int(gain.argmax()))
        least = np.minimum(least, apart[:, taken[-1]])
    return taken


def medoids(assigned: DataFrame, k: int, gamma: float = 0.01, seed: int = 123, sample: int = 32, confidence: float = 3.0, keep: int = 8,
            keys: Sequence[str] = KEYS) -> np.ndarray:
    """The member of each cluster with the smallest total distance to all its members, from ``(keys, series, cluster)``.

    Exact for clusters of any size, whatever ``seed``, ``sample``, ``confidence`` and ``keep`` are: they steered a race against samples, which
    could drop the best member, and are still taken for callers that name them.
    """
    return _central(cut_lineage(assigned.select(*keys, "series", "cluster")), gamma, keys)[1]


def _listed(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A short list as a local table."""
    return spark.createDataFrame(pa.table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))), schema)


def _central(everyone: DataFrame, gamma: float, keys: Sequence[str], among: Sequence[int] | None = None) -> tuple[list[int], np.ndarray]:
    """Numbers of the clusters that have members, in order, and their medoids; ``everyone`` is a checkpoint.  Given ``among``, only of these clusters.

    All members of a cluster meet, by pairs of slices of about ``SLICE`` members: no cluster is gathered whole, and a pair is aligned
    once for both.  Clusters smaller than that share a group.
    """
    spark, cluster_type = everyone.sparkSession, T.StructField("cluster", everyone.schema["cluster"].dataType)
    everyone = everyone.select(*keys, "series", "cluster").withColumn("_id", F.monotonically_increasing_id())
    if among is not None:
        if not among:
            return [], np.array([])
        everyone = everyone.join(F.broadcast(_listed(spark, [(c,) for c in among], T.StructType([cluster_type]))), "cluster", "left_semi")
    size = {r["cluster"]: r["count"] for r in everyone.groupBy("cluster").count().collect()}
    if not size:
        return [], np.array([])
    rows, group, held = [], 0, 0
    for c, m in sorted(size.items()):
        if held + m > SLICE // 2:
            group, held = group + 1, 0
        held += m
        rows.append((c, float(m), group, -(-m // SLICE)))
    info = F.broadcast(_listed(spark, rows, T.StructType([
        cluster_type, T.StructField("_size", T.DoubleType()), *[T.StructField(f, T.IntegerType()) for f in ("_g", "_slices")]])))
    at = F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int")
    met = everyone.join(info, "cluster").withColumn("_at", at).select(
        *keys, "_id", "cluster", "series", "_g", "_at", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_other"))
    tiles = met.select(*keys, "_id", "cluster", "series", "_g", "_at", F.least("_at", "_other").alias("_a"), F.greatest("_at", "_other").alias("_b"))
    fields = [everyone.schema[c] for c in (*keys, "_id", "cluster")]
    schema = T.StructType([*fields, T.StructField("total", T.DoubleType())])
    order = [(c, "ascending") for c in (*keys, "_id")]

    def totals(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by(order)
        of, x = tile.column("cluster").to_numpy(), _matrices(tile)
        first = tile.column("_at").to_numpy() == tile.column("_a").to_numpy()
        one = bool(first.all()) and tile.column("_a")[0] == tile.column("_b")[0]
        total, meet = np.zeros(len(of)), []
        for c in np.unique(of):
            i, j = np.flatnonzero((of == c) & first), np.flatnonzero((of == c) & (one | ~first))
            pairs = np.triu_indices(len(i)) if one else tuple(v.ravel() for v in np.indices((len(i), len(j))))
            meet.append((i, j, pairs))
        d = pair_distances(x, x, np.concatenate([i[p] for i, _, (p, _) in meet]), np.concatenate([j[q] for _, j, (_, q) in meet]), gamma)
        lo = 0
        for i, j, (p, q) in meet:
            part = np.empty((len(i), len(j)))
            part[p, q] = d[lo:lo + len(p)]
            lo += len(p)
            if one:
                part[q, p] = part[p, q]
            else:
                total[j] = part.sum(axis=0)
            total[i] = part.sum(axis=1)
        return pa.Table.from_arrays([*tile.select(schema.names[:-1]).columns, pa.array(total)], schema.names)

    by = ["_g", "_a", "_b"]
    summed = spread(tiles, *by, times=2).groupBy(*by).applyInArrow(totals, schema).groupBy(*keys, "_id", "cluster").agg(F.sum("total").alias("total"))
    mean = summed.join(info, "cluster").withColumn("mean", F.col("total") / F.col("_size"))
    best = mean.groupBy("cluster").agg(F.min_by("_id", F.struct("mean", *keys, "_id")).alias("m")).collect()
    chosen = _listed(spark, [(r["m"],) for r in best], T.StructType([T.StructField("_id", T.LongType())]))
    found = everyone.join(F.broadcast(chosen), "_id").select("cluster", "series").toArrow().sort_by("cluster")
    return found.column("cluster").to_pylist(), _matrices(found)


def _fit_medoids(series: DataFrame, k: int, gamma: float, seed: int, max_iter: int, keys: Sequence[str]) -> tuple[np.ndarray, bool, DataFrame]:
    """Medoids, whether they came to rest, and ``(keys, series, cluster, distance)`` to them."""
    centres = seed_centres(series, k, gamma, seed, keys=keys)
    state, changed = cut_lineage(reassign(series, centres, gamma, keys)), None
    for _ in range(max_iter):
        clusters, moved = _central(state.dropna(subset=list(keys)) if keys else state, gamma, keys, changed)
        if changed is not None:
            # A cluster with the members it had keeps its medoid.
            medoid = {c: centres[c - 1] for c in range(1, len(centres) + 1) if c not in set(changed)} | dict(zip(clusters, moved, strict=True))
            clusters = sorted(medoid)
            moved = np.array([medoid[c] for c in clusters])
        if moved.shape == centres.shape and (moved == centres).all():
            return centres, True, state
        numbers = np.full(len(centres), -1)
        numbers[np.array(clusters, dtype=int) - 1] = np.arange(len(clusters))
        known = np.array([(m == centres[c - 1]).all() for c, m in zip(clusters, moved, strict=True)], dtype=bool)
        state = cut_lineage(reassign(state, moved, gamma, keys, numbers, known, was=True))
        changes = state.where("was <> cluster").select(F.explode(F.array("was", "cluster")).alias("c")).distinct()
        changed = sorted(r["c"] for r in changes.collect() if r["c"])  # at most k
        state, centres = state.drop("was"), moved
    return centres, False, state


def fit_medoids(series: DataFrame, k: int, gamma: float = 0.01, seed: int = 123, max_iter: int = 10, keys: Sequence[str] = KEYS) -> tuple[np.ndarray, bool]:
    """Medoids (k, steps, measures) and whether they came to rest: seeds, then assignment and the medoid of each cluster in turn (K2).

    Members are centres, as in partitioning around medoids; a cluster that loses all members is left out.
    """
    return _fit_medoids(series, k, gamma, seed, max_iter, keys)[:2]


def _moved_centres(series: DataFrame, centres: np.ndarray, gamma: float) -> np.ndarray:
    """One barycentre step: every centre step becomes the mean of what is aligned to it.

    Each task reduces its series to one sum per centre and cell; Spark adds the cells up, partially where they are
    made, so neither a crowded cluster nor the number of tasks gathers anything in one place.
    """
    k, steps, m = centres.shape
    _, alignment = soft_dtw_kernel(gamma)

    def work(chunks, centres):
        total, mass = np.zeros((k, steps, m)), np.zeros((k, steps))
        for _, x in chunks:
            nearest, _, _ = nearest_centres(x, centres, gamma)
            for c in np.unique(nearest):
                mine = x[nearest == c]
                e = alignment(mine, centres[c])
                total[c] += np.einsum("nts,ntm->sm", e, mine)
                mass[c] += e.sum((0, 1))
        for c in np.flatnonzero(mass.sum(1) > 0):
            # A centre's cells: steps x measures totals, then a mass per step.
            values_of = np.concatenate([total[c].ravel(), mass[c]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values_of), c, "int32")), pa.array(np.arange(len(values_of), dtype="int32")),
                 pa.array(values_of)], ["c", "cell", "value"])

    parts = _on_series(series, centres, (), "c int, cell int, value double", work)
    sums = np.zeros((k, steps * (m + 1)))
    for row in parts.groupBy("c", "cell").agg(F.sum("value").alias("value")).toArrow().to_pylist():
        sums[row["c"], row["cell"]] = row["value"]
    moved = centres.copy()
    for c in np.flatnonzero(sums.any(1)):
        moved[c] = sums[c, :steps * m].reshape(steps, m) / sums[c, steps * m:, None]
    return moved


def fit_centres(series: DataFrame, k: int, gamma: float = 0.01, seed: int = 123, max_iter: int = 20,
                tol: float = 1e-6, keys: Sequence[str] = KEYS) -> tuple[np.ndarray, bool]:
    """Soft-DTW k-means centres (k, steps, measures) and whether they settled within ``max_iter`` rounds (K2).

    They start from :func:`seed_centres`; settled means that no coordinate moved by more than ``tol``
    times the largest one.
    """
    centres = seed_centres(series, k, gamma, seed, keys=keys)
    _check_centres(centres)
    for _ in range(max_iter):
        moved = _moved_centres(series, centres, gamma)
        step = np.abs(moved - centres).max()
        centres = moved
        if step <= tol * max(1.0, np.abs(centres).max()):
            return centres, True
    return centres, False


def cluster_series(series: DataFrame, k: int, gamma: float = 0.01, seed: int = 123, max_iter: int = 20,
                   keys: Sequence[str] = KEYS, around: str = "means") -> DataFrame:
    """``(keys, cluster, distance, settled)``; ``series`` is written once and read per round (K2).

    Clusters lie around soft-DTW ``means`` or around ``medoids``.  ``settled`` says whether the centres came to rest within ``max_iter`` rounds.
    """
    series = cut_lineage(spread(series, *keys))
    if around == "medoids":
        _, settled, state = _fit_medoids(series, k, gamma, seed, max_iter, keys)
        assigned = state.drop("series")
    else:
        centres, settled = {"means": fit_centres}[around](series, k, gamma, seed, max_iter, keys=keys)
        assigned = assign_clusters(series, centres, gamma, keys)
    return assigned.withColumn("settled", F.lit(settled))


def exemplars(assignment: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The member nearest to each cluster's centre, with the cluster's size."""
    nearest = F.min_by(F.struct(*keys), F.struct("distance", *keys))
    return (assignment.groupBy("cluster").agg(nearest.alias("_e"), F.count(F.lit(1)).alias("cluster_size"))
            .select("cluster", *[F.col(f"_e.{k}").alias(k) for k in keys], "cluster_size"))
