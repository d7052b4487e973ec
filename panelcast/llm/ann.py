"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.vectors import by_width, matrix, unit, usable
from panelcast.operators.sizing import cut_lineage, spread

#: Projected dimensions; even, which gives the chi-square distribution a closed form.
DIMENSIONS = 6
#: Chance with which a true neighbour survives the stopping test.
CONFIDENCE = 0.98
#: Vectors a leaf of the shared tree aims at, and projected rows the tree is fitted on.
LEAF_ROWS = 4096
SAMPLE_ROWS = 65_536
#: Vectors of a bucket of the tree within a leaf.
BUCKET = 512
#: Queries that meet vectors of a leaf in one task.
QUERY_ROWS = 2048
#: By how much a cosine summed in another order may differ.
ROUNDING = 1e-9
SEED = 7


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    if freedom % 2 or not 0 < p < 1:
        raise ValueError("freedom must be even and p lie in (0, 1)")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, freedom // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(width: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Standard normal (2-stable) directions: a squared projected distance over the true one is chi-square."""
    return np.random.default_rng([seed, width]).standard_normal((width, dimensions))


@dataclass(frozen=True)
class Tree:
    """A kd-tree over projected points: inner nodes split one dimension, leaves are numbered from 0."""

    dimension: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dimension[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def fit_tree(points: np.ndarray, depth: int) -> Tree:
    """Median cuts of the dimension that varies most, ``depth`` levels; all leaves hold as many of ``points``."""
    dimension, cut = np.zeros(max(1, (1 << depth) - 1), np.int64), np.zeros(max(1, (1 << depth) - 1))
    level = [points]
    for node in range((1 << depth) - 1):
        mine = level.pop(0)
        if len(mine):
            dimension[node] = int(np.argmax(mine.var(axis=0)))
            cut[node] = np.median(mine[:, dimension[node]])
        right = mine[:, dimension[node]] > cut[node]
        level += [mine[~right], mine[right]]
    return Tree(dimension, cut, depth)


def _buckets(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the buckets of a kd-tree within one leaf."""
    done, left = [], [np.arange(len(points))]
    while left:
        rows = left.pop()
        if len(rows) <= BUCKET:
            done.append(rows)
            continue
        own = points[rows]
        half = len(rows) // 2
        order = np.argpartition(own[:, int(np.argmax(own.var(axis=0)))], half)
        left += [rows[order[:half]], rows[order[half:]]]
    return done


class Leaf:
    """The vectors of one leaf, ready for searches."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray):
        self.buckets = _buckets(points)
        order = np.concatenate(self.buckets)
        self.order, self.points, self.vectors = order, points[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.starts = np.concatenate(([0], np.cumsum([len(b) for b in self.buckets])))
        self.low = np.array([points[b].min(axis=0) for b in self.buckets])
        self.high = np.array([points[b].max(axis=0) for b in self.buckets])

    def search(self, vector: np.ndarray, point: np.ndarray, skip: np.ndarray, k: int, reach: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` best found; ``reach`` is the distance of the k-th best known before.

        Buckets come in the order of their projected distance.  The search stops when the chi-square test holds: what is left lies
        so far out in the projection that a vector nearer than the k-th best would hardly ever be there.
        """
        norm = math.sqrt((vector * vector).sum())
        gaps = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        nearest = (gaps * gaps).sum(axis=1)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(nearest, kind="stable"):
            if nearest[b] > limit * reach * reach:
                break
            span = slice(self.starts[b], self.starts[b + 1])
            away = self.points[span] - point
            near = np.nonzero((away * away).sum(axis=1) <= limit * reach * reach)[0] + self.starts[b]
            near = near[~np.isin(self.order[near], skip)]
            if not len(near):
                continue
            rough = self.vectors[near] @ vector / (self.norms[near] * norm)
            pool = np.concatenate([scores, rough])
            if len(pool) > k:
                near = near[rough >= np.partition(pool, len(pool) - k)[len(pool) - k] - ROUNDING]
            # Sums along rows are the same for equal vectors wherever they stand.
            found = (self.vectors[near] * vector).sum(axis=1) / (self.norms[near] * norm)
            rows, scores = np.concatenate([rows, near]), np.concatenate([scores, found])
            if len(rows) > k:
                best = np.lexsort((self.order[rows], -scores))
                # Ties with the k-th stay, their ids decide later.
                best = best[:max(k, int((scores >= scores[best[k - 1]]).sum()))]
                rows, scores = rows[best], scores[best]
            if len(rows) >= k:
                reach = min(reach, math.sqrt(max(0.0, 2 - 2 * np.partition(scores, len(scores) - k)[len(scores) - k])))
        return self.order[rows], scores


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, leaf_rows: int = LEAF_ROWS,
            sample_rows: int = SAMPLE_ROWS, seed: int = SEED, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest others of each row for which ``queries`` holds, by cosine.

    Null or zero vectors, those with a null or non-finite component and rows without an id take no part; vectors of
    different lengths are never compared.  Of equal vectors the ``k + 1`` smallest ids can be wanted, so no more enter the index; ties go to the
    smaller id.  The tree is fitted on about ``sample_rows`` projected rows chosen by hash, every row is indexed.  A query
    searches its own leaf first and with that bound every leaf the chi-square test cannot rule out.  A leaf of more than ``2 * leaf_rows``
    vectors is dealt by hash to several tasks, and so are the queries that meet it, about ``query_rows`` to a task.  Repeated rows are
    copies; an empty table or one without queries gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col).where("id is not null").distinct()
    asked = usable(df.where(queries), id_col, vec_col).where("id is not null").distinct()
    element = rows.schema["vec"].dataType.simpleString()
    firsts = Window.partitionBy("vec").orderBy("id")
    index = (rows.withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1)
             .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    limit = chi_square_quantile(confidence, dimensions)

    trees: dict[int, Tree] = {}
    for width, total in [(r.width, r["count"]) for r in rows.groupBy(F.size("vec").alias("width")).count().collect()]:
        share = min(1.0, sample_rows / total)
        sample = rows.where((F.size("vec") == width) & (F.abs(F.xxhash64("id", F.lit(seed)) % 1_000_003) < share * 1_000_003))
        vectors = [np.empty((0, width)), *(matrix(b.column(0)) for b in sample.select("vec").toArrow().to_batches())]
        points = np.concatenate(vectors)
        points = unit(points) @ projection(width, dimensions, seed) if len(points) else np.empty((0, dimensions))
        leaves = min(max(1, total // leaf_rows), max(1, len(points) // 16))
        trees[width] = fit_tree(points, max(0, math.ceil(math.log2(leaves))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch, 1):
                points = unit(matrix(part.column(1))) @ projection(width, dimensions, seed)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(part), width), pa.int32()), pa.array(trees[width].leaf(points)),
                     pa.array(points.tolist(), pa.list_(pa.float64()))], ["key", "vec", "width", "leaf", "point"])

    def placed(what: DataFrame, key: str) -> DataFrame:
        return what.mapInArrow(place, f"key {key}, vec {element}, width int, leaf long, point array<double>")

    held = placed(index.select(F.col("ids").alias("key"), "vec"), "array<bigint>")
    homes = placed(asked.select(F.col("id").alias("key"), "vec"), "long").withColumn("reach", F.lit(2.0))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries that meet one share of a leaf; a share without vectors answers a query with an empty list."""
        out = {"query_id": [], "reach": [], "ids": [], "scores": []}
        if len(right):
            ids = left["key"].to_pylist()
            if ids:
                vectors, points = matrix(left["vec"].combine_chunks()), matrix(left["point"].combine_chunks())
                leaf = Leaf(vectors, points)
                alone = {v[0]: n for n, v in enumerate(ids) if len(v) == 1}
            for q, vector, point, reach in zip(right["key"].to_pylist(), matrix(right["vec"].combine_chunks()),
                                               matrix(right["point"].combine_chunks()), right["reach"].to_pylist()):
                found: list[tuple[float, int]] = []
                if ids:
                    skip = np.array([alone[q]] if q in alone else [], np.int64)
                    hits, scores = leaf.search(vector, point, skip, k, reach, limit)
                    found = sorted((-s, i) for n, s in zip(hits.tolist(), scores.tolist()) for i in ids[n] if i != q)[:k]
                bound = min(reach, math.sqrt(max(0.0, 2 + 2 * found[k - 1][0]))) if len(found) == k else reach
                out["query_id"].append(q)
                out["reach"].append(bound)
                out["ids"].append([i for _, i in found])
                out["scores"].append([-s for s, _ in found])
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("reach", pa.float64()), ("ids", pa.list_(pa.int64())),
                                        ("scores", pa.list_(pa.float64()))]))

    answer = "query_id long, reach double, ids array<long>, scores array<double>"
    key = ["width", "leaf"]
    group = [*key, "part", "turn"]
    held = cut_lineage(held.select("key", "vec", "point", *key))
    ends = held.groupBy(*key).agg(F.count("*").alias("rows"), *(F.min(F.col("point")[d]).alias(f"low{d}") for d in range(dimensions)),
                                  *(F.max(F.col("point")[d]).alias(f"high{d}") for d in range(dimensions))).toArrow()
    sizes = spark.createDataFrame(ends.select([*key, "rows"]))
    own_part = F.pmod(F.xxhash64("vec"), F.col("parts"))

    def meet(wanted: DataFrame, counts: DataFrame, part: Column) -> DataFrame:
        """Answers of ``wanted`` from the parts of their leaves that ``part`` lists; leaves nobody asks stay where they are."""
        asked_of = spark.createDataFrame(counts.toArrow())  # a row per leaf
        shares = F.broadcast(asked_of.join(sizes, key, "left").select(
            *key, F.expr(f"greatest(ceil(coalesce(rows, 0) / {2 * leaf_rows}), 1)").alias("parts"),
            F.ceil(F.col("asked") / query_rows).alias("turns")))
        left = held.join(shares, key).select("key", "vec", "point", *key, own_part.alias("part"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))
        right = (wanted.join(shares, key).withColumn("part", F.explode(part))
                 .withColumn("turn", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("turns"))))
        if "home" in right.columns:
            right = right.where((F.col("leaf") != F.col("home")) | (F.col("part") != own_part))
        right = right.select("key", "vec", "point", "reach", *group)
        return spread(left, *group).groupBy(*group).cogroup(spread(right, *group).groupBy(*group)).applyInArrow(search, answer)

    homes = homes.select("key", "vec", "point", "reach", *key)
    first = cut_lineage(meet(homes, homes.groupBy(*key).agg(F.count("*").alias("asked")), F.array(own_part)))

    boxes = {}
    for width in trees:
        mine = ends.filter(pa.array(ends["width"].to_numpy() == width))
        boxes[width] = tuple(np.stack([mine[f"{side}{d}"].to_numpy() for d in range(dimensions)], axis=1)
                             for side in ("low", "high")) + (mine["leaf"].to_numpy(),)
    sent = spark.sparkContext.broadcast(boxes)  # a box per leaf: at most 2 * SAMPLE_ROWS / 16

    def visits(part: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
        """For each query the leaves that the chi-square test can't rule out."""
        low, high, leaves = sent.value[width]
        for point, reach in zip(matrix(part.column(2)), part.column(3).to_pylist()):
            gaps = np.maximum(np.maximum(low - point, point - high), 0)
            yield leaves[(gaps * gaps).sum(axis=1) <= limit * reach * reach]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch, 1):
                for n, near in enumerate(visits(part, width)):
                    row = part.slice(n, 1).take(pa.array(np.zeros(len(near), np.int64)))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array(np.full(len(near), width), pa.int32()), pa.array(near)],
                                                     ["key", "vec", "point", "reach", "home", "width", "leaf"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch, 1):
                leaves, times = np.unique(np.concatenate(list(visits(part, width))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), width), pa.int32()), pa.array(leaves), pa.array(times)],
                                                 ["width", "leaf", "asked"])

    bounds = cut_lineage(homes.drop("reach").join(first.groupBy(F.col("query_id").alias("key")).agg(F.max("reach").alias("reach")), "key")
                         .select("key", "vec", "point", "reach", F.col("leaf").alias("home")))
    routed = bounds.mapInArrow(route, f"key long, vec {element}, point array<double>, reach double, home long, width int, leaf long")
    counts = bounds.mapInArrow(count, "width int, leaf long, asked long").groupBy(*key).agg(F.sum("asked").alias("asked"))
    second = meet(routed, counts, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(second).select("query_id", F.expr("inline(arrays_zip(ids, scores))"))
            .select("query_id", F.col("ids").alias("vec_id"), F.col("scores").alias("score")).distinct()
            .withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
