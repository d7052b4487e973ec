"""Vector helpers, and near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.graph import components
from panelcast.operators.sizing import cut_lineage

#: Bytes of vectors in one block; a task holds those of one stripe and one more.
BLOCK_BYTES = 1 << 21
#: Most blocks in a stripe.
STRIPE = 8
#: Rows and columns of the products computed at once.
TILE = 1024
#: Leading dimensions of the first pass; each later one doubles them.
LEAD = 16
#: Principal directions in the boxes by which blocks are told apart.
BOX = 8
#: True for a vector that has a direction, false for every other, null included.
USABLE = ("coalesce(size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
          " and exists(vec, x -> x <> 0), false)")


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that have a direction: not null, not zero, every component finite."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(USABLE)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps tiny and huge ones in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    widths = np.diff(batch.column(column).offsets.to_numpy())
    for width in np.unique(widths):
        yield int(width), batch.filter(pa.array(widths == width))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the principal axes of all unit vectors, as columns, the largest first.

    The second moments are summed by Spark; the driver gets one square matrix for each length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, rows in by_width(batch, 0):
                x = unit(matrix(rows.column(0)))
                total[width] = total.get(width, 0) + x.T @ x
        for width, m in total.items():
            cells = np.arange(width * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width * width, width), pa.int32()), pa.array(cells, pa.int64()), pa.array(m.ravel())],
                ["width", "cell", "total"])

    sums = (vectors.select("vec").mapInArrow(moments, "width int, cell long, total double")
            .groupBy("width", "cell").agg(F.sum("total").alias("total")).toArrow())
    axes = {}
    widths = sums["width"].to_numpy()
    for width in np.unique(widths):
        mine = widths == width
        m = np.zeros(int(width) ** 2)
        m[sums["cell"].to_numpy()[mine]] = sums["total"].to_numpy()[mine]
        axes[int(width)] = np.linalg.eigh(m.reshape(width, width))[1][:, ::-1].copy()
    return axes


def _blocks(groups: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Runs of vectors along the first principal axis, one row per run of at most ``BLOCK_BYTES``.

    The runs are cut at quantiles of that axis, so a dense stretch gets as many blocks as its vectors need.
    """
    kind = np.dtype("f4" if groups.schema["vec"].dataType.elementType.typeName() == "float" else "f8")
    element = groups.schema["vec"].dataType.simpleString()

    def most(width: int) -> int:
        return max(1, BLOCK_BYTES // (kind.itemsize * width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in by_width(batch, 0):
                first = unit(matrix(rows.column(0))) @ axes[width][:, 0]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(rows), width), pa.int32()), pa.array(first)],
                    ["vec", "id", "copies", "width", "first"])

    placed = groups.select("vec", "id", "copies").mapInArrow(
        place, f"vec {element}, id long, copies long, width int, first double")
    cuts: dict[int, np.ndarray] = {}
    for width, rows in ((r.width, r["count"]) for r in groups.groupBy(F.size("vec").alias("width")).count().collect()):
        wanted = -(-rows // most(width))
        shares = [k / wanted for k in range(1, wanted)]
        found = placed.where(F.col("width") == width).agg(
            F.percentile_approx("first", shares, 20 * wanted).alias("c")).first().c if shares else []
        cuts[width] = np.array(found, float)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in place(batches):
            width = batch.column(3)[0].as_py()
            run = np.searchsorted(cuts[width], batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(run.astype(np.int64))],
                                             ["vec", "id", "copies", "width", "run"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, made, nth, key = TaskContext.get().partitionId(), 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, nth
            if held:
                x = np.concatenate([matrix(b.column(0)) for b in held])
                ids = np.concatenate([b.column(1).to_numpy() for b in held])
                copies = np.concatenate([b.column(2).to_numpy() for b in held])
                spots = unit(x) @ axes[x.shape[1]][:, :BOX]
                row = {"block": part << 32 | made, "width": x.shape[1], "run": int(key[1]), "nth": nth, "low": spots.min(axis=0).tolist(),
                       "high": spots.max(axis=0).tolist(), "ids": ids.astype("i8").tobytes(),
                       "copies": copies.astype("i8").tobytes(), "vecs": x.astype(kind).tobytes()}
                made, nth = made + 1, nth + 1
                held.clear()
                yield pa.RecordBatch.from_pylist([row], pa.schema(
                    [("block", pa.int64()), ("width", pa.int32()), ("run", pa.int64()), ("nth", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                     ("ids", pa.binary()), ("copies", pa.binary()), ("vecs", pa.binary())]))

        for batch in batches:
            keys = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if (new := tuple(keys[a])) != key:
                    yield from flush()
                    key, nth = new, 0
                while a < b:
                    room = most(int(key[0])) - sum(map(len, held))
                    if not room:
                        yield from flush()
                        continue
                    held.append(batch.slice(a, min(room, b - a)))
                    a += len(held[-1])
        yield from flush()

    numbered = groups.select("vec", "id", "copies").mapInArrow(
        number, f"vec {element}, id long, copies long, width int, run long")
    return cut_lineage(numbered.repartition("width", "run").sortWithinPartitions("width", "run").mapInArrow(
        pack, "block long, width int, run long, nth long, low array<double>, high array<double>, ids binary, copies binary, vecs binary"))


def _block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks (i, j) whose boxes come within ``reach`` of one another, each block with itself too.

    Blocks meet in cells of length ``reach`` along the first axis; no pair is made outside them.
    """
    boxes = blocks.select("block", "width", "low", "high")
    cell = lambda x: f"cast(floor(({x}) / {reach!r}D) as long)"
    left = boxes.withColumn("cell", F.expr(f"explode(sequence({cell('low[0]')}, {cell(f'high[0] + {reach!r}D')}))"))
    right = boxes.select(F.col("block").alias("other"), "width", F.col("low").alias("low2"), F.col("high").alias("high2"),
                         F.expr(f"explode(sequence({cell('low[0]')}, {cell(f'high[0] + {reach!r}D')}))").alias("cell"))
    gap = ("aggregate(zip_with(zip_with(low, high, (l, h) -> struct(l, h)), zip_with(low2, high2, (l, h) -> struct(l, h)),"
           " (p, q) -> pow(greatest(p.l - q.h, q.l - p.h, 0D), 2)), 0D, (s, x) -> s + x)")
    return (left.join(right, ["width", "cell"]).where("block <= other").where(F.expr(gap) <= reach * reach)
            .select("block", "other").distinct())


def _join_up(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the classes of i and j; ``parent`` points to smaller numbers only."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (above := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = above


def tile_links(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of ``x`` and ``y`` with cosine >= ``threshold``; i < j within ``x`` if ``y`` is None.

    Along the principal axes a leading product plus the product of the norms of what is left bounds the cosine from above; a tile or
    pair goes on to more dimensions only while that bound reaches the threshold.  The bound is computed in single
    precision with room for its error, the cosine that decides in double on the vectors themselves.
    """
    own = y is None
    ux = unit(x)
    uy = ux if own else unit(y)
    px, py = (ux @ axes).astype(np.float32), (uy @ axes).astype(np.float32)
    width = x.shape[1]
    slack = threshold - (1e-5 + 2e-7 * width)

    def suffix(p: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((p[:, k:] * p[:, k:]).sum(axis=1, keepdims=True))

    first = min(LEAD, width)
    ax = np.ascontiguousarray(np.hstack([px[:, :first], suffix(px, first)]))
    ay = np.ascontiguousarray(np.hstack([py[:, :first], suffix(py, first)]))
    for r in range(0, len(ax), TILE):
        for c in range(r if own else 0, len(ay), TILE):
            bound = ax[r:r + TILE] @ ay[c:c + TILE].T
            if bound.max() < slack:
                continue
            i, j = np.nonzero(bound >= slack)
            if own and r == c:
                i, j = i[i < j], j[i < j]
            if len(i) > TILE * 16:
                # Many are left: finish the tile densely, decide only what lies at the threshold pair by pair.
                dense = ux[r:r + TILE] @ uy[c:c + TILE].T
                value = dense[i, j]
                i, j = i + r, j + c
                sure, near = value >= threshold + 1e-12, np.abs(value - threshold) < 1e-12
                near[near] = (ux[i[near]] * uy[j[near]]).sum(axis=1) >= threshold
                hit = sure | near
                yield i[hit], j[hit]
                continue
            i, j = i + r, j + c
            lead, total = first, None
            while len(i) and lead < width:
                more = min(width, 2 * lead)
                part = (px[i, :more] * py[j, :more]).sum(axis=1)
                rest = suffix(px[i], more)[:, 0] * suffix(py[j], more)[:, 0]
                keep = part + rest >= slack
                i, j, lead = i[keep], j[keep], more
            if len(i):
                total = (ux[i] * uy[j]).sum(axis=1)
                yield i[total >= threshold], j[total >= threshold]


def _tiles(pairs: DataFrame, blocks: DataFrame, span: int) -> DataFrame:
    """Rows (s, t, block, partners, payload) of pairs of stripes: the blocks of s, partners null, before those of t with theirs in s.

    A stripe is up to ``span`` blocks that follow one another along the first axis; further blocks of a run with more rows than
    one holds make stripes of their own.  A block is sent once to each pair of stripes in which it has a partner, not once for each partner.
    Within one stripe every block comes once, after those of its partners that are smaller.
    """
    stripe = (f"concat_ws('/', width, CASE WHEN nth = 0 THEN CAST(run div {span} AS STRING) "
              f"ELSE concat(run, '+', (nth - 1) div {span}) END)")
    place = blocks.select("block", F.expr(stripe).alias("stripe"))
    at = (pairs.join(place.withColumnRenamed("stripe", "s"), "block")
          .join(place.select(F.col("block").alias("other"), F.col("stripe").alias("t")), "other"))
    turned = at.selectExpr("least(s, t) AS s", "greatest(s, t) AS t", "if(s <= t, block, other) AS block", "if(s <= t, other, block) AS other")
    first = turned.where("s <> t").select("s", "t", "block").distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    alone = turned.where("s = t").selectExpr("s", "t", "block AS o", "CAST(NULL AS LONG) AS partner")
    second = turned.selectExpr("s", "t", "other AS o", "block AS partner").unionByName(alone).groupBy("s", "t", "o").agg(
        F.collect_list("partner").alias("partners"))
    rows = first.unionByName(second.withColumnRenamed("o", "block"))
    return (rows.join(blocks.select("block", "width", "ids", "copies", "vecs"), "block")
            .select("s", "t", "block", "partners", "width", "ids", "copies", "vecs")
            .repartition("s", "t").sortWithinPartitions("s", "t", F.col("partners").isNotNull(), "block"))


def _compare(tiles: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(id, links, root): per pair of blocks, for each linked vector, its number of links there and a class mate.

    A task holds the blocks of one stripe and lets those of the other pass.
    """

    def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        size = len(row["vecs"]) // (row["width"] * len(ids))
        x = np.frombuffer(row["vecs"], f"f{size}").astype(np.float64).reshape(len(ids), -1)
        return ids, np.frombuffer(row["copies"], np.int64), x

    def linked(left: dict, right: dict) -> pa.RecordBatch:
        ids, copies, x = unpack(left)
        y, shift = None, 0
        if left["block"] != right["block"]:
            ids2, copies2, y = unpack(right)
            shift, ids, copies = len(x), np.concatenate([ids, ids2]), np.concatenate([copies, copies2])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in tile_links(x, y, axes[x.shape[1]], threshold):
            j = j + shift
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64)
            links += np.bincount(j, copies[i], len(ids)).astype(np.int64)
            _join_up(parent, rank[i], rank[j])
        hit = np.nonzero(links)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[order][parent[rank[hit]]])], ["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["s"], row["t"]) != tile:
                    tile, held = (row["s"], row["t"]), {}
                if row["partners"] is None:
                    held[row["block"]] = row
                    continue
                if row["s"] == row["t"]:
                    held[row["block"]] = row
                for partner in row["partners"]:
                    yield linked(held[partner], row)

    return tiles.mapInArrow(run, "id long, links long, root long")


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row: direct links, smallest id reachable, and whether that is its own.

    Vectors link if their cosine in double precision is at least ``threshold``; those of different lengths never do, nor do null or zero ones
    or those with a null or non-finite component (no links, own class).  Equal vectors are compared once and
    counted as often as they occur.  Blocks of all other vectors meet unless their boxes along the principal axes are too
    far apart; a pair of blocks gives one row for each linked vector, never one for each pair.
    Repeated ids are one node each with their rows kept; a row without an id links with nothing; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = usable(df, id_col, vec_col).where("id is not null")
    groups = cut_lineage(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    axes = principal_axes(groups)
    blocks = _blocks(groups, axes)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    pairs = cut_lineage(_block_pairs(blocks, reach))
    # Wider stripes send fewer bytes, but there must be tiles enough for every core; the result is the same.
    span = min(STRIPE, max(1, isqrt(pairs.count() // df.sparkSession.sparkContext.defaultParallelism)))
    found = cut_lineage(_compare(_tiles(pairs, blocks, span), axes, threshold))
    joined = components(found.where("id <> root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = (groups.join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
               .select("vec", F.coalesce("links", F.lit(0)).alias("links"), "copies",
                       F.coalesce("component", "id").alias("component_id")))
    # The vector itself is the key, so the join finds every copy; a crowded one is split by the adaptive skew join.
    linked = rows.join(classes, "vec").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        f"id is null or not {USABLE}").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
