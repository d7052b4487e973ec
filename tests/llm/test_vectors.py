import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelcast.llm import ann, vectors


def planted(rng, n, d, groups):
    x = rng.standard_normal((n, d)).astype(np.float32)
    at = 0
    for size, noise in groups:
        x[at:at + size] = x[at] + noise * rng.standard_normal((size, d)).astype(np.float32)
        at += size
    return x


def table(spark, x, extra=(), kind="float"):
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, links string").repartition(5)


def brute(x, threshold):
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label, len(x)).min(axis=1))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


ODD = [(1001, None, ""), (1002, [0.0] * 16, ""), (1003, [float("nan")] + [1.0] * 15, ""), (1004, [None] + [1.0] * 15, ""),
       (1005, [float("inf")] + [1.0] * 15, ""), (1006, [], ""), (1007, [1.0, 2.0], ""), (1008, [2.0, 4.0], "")]


@pytest.mark.parametrize("block_bytes,tile,kind", [(1 << 21, 1024, "float"), (16 * 4 * 50, 16, "float"), (16 * 8 * 64, 32, "double")])
def test_links_match_brute_force(spark, monkeypatch, block_bytes, tile, kind):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(3)
    x = planted(rng, 400, 16, [(60, 0.0), (80, 0.15), (30, 0.2), (5, 0.3)])
    x[300] = 3 * x[299]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table(spark, x, ODD, kind), 0.95).collect()}
    links, label = brute(x, 0.95)
    for i in range(len(x)):
        assert got[i] == (links[i], label[i], label[i] == i)
    for i in range(1001, 1007):
        assert got[i] == (0, i, True)
    assert got[1007] == (1, 1007, True) and got[1008] == (1, 1007, False)
    assert len(got) == len(x) + len(ODD)


@pytest.mark.parametrize("span", [1, 2, 8])
def test_stripes_compare_every_pair_of_blocks_once(spark, span):
    """Pairs are those asked for, whichever way the stripes turn them, a crowded run of blocks included."""
    places = [(b, 3, b % 7 if b < 14 else 4, b // 7 if b < 14 else b - 12) for b in range(40)]
    blocks = spark.createDataFrame([(b, w, r, n, bytes([b]), b"", b"") for b, w, r, n in places],
                                   "block long, width int, run long, nth long, ids binary, copies binary, vecs binary")
    asked = [(a, b) for a in range(40) for b in range(a, 40) if (a * b) % 3 != 1]
    tiles = vectors._tiles(spark.createDataFrame(asked, "block long, other long"), blocks, span).collect()
    held = {}
    for r in tiles:
        if r.partners is None or r.s == r.t:
            assert r.block not in held.setdefault((r.s, r.t), set())
            held[r.s, r.t].add(r.block)
            assert all(p in held[r.s, r.t] for p in r.partners or [])
    assert max(map(len, held.values())) <= span
    met = [tuple(sorted((p, r.block))) for r in tiles if r.partners is not None for p in r.partners]
    assert all(p in held[r.s, r.t] for r in tiles if r.partners is not None for p in r.partners)
    assert sorted(met) == asked
    assert all(r.ids == bytes([r.block]) for r in tiles)


def test_stripes_send_blocks_less_often(spark):
    blocks = spark.createDataFrame([(b, 3, b, 0, b"", b"", b"") for b in range(64)],
                                   "block long, width int, run long, nth long, ids binary, copies binary, vecs binary")
    pairs = spark.range(64).crossJoin(spark.range(64).withColumnRenamed("id", "other")).where("id <= other").withColumnRenamed("id", "block")
    sent = {span: vectors._tiles(pairs, blocks, span).count() for span in (1, 8)}
    assert sent[1] == 64 * 64 and sent[8] == 64 * 64 / 8


@pytest.mark.parametrize("stripe", [1, 8])
def test_wide_stripes_give_the_same_links(spark, monkeypatch, stripe):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 16 * 4 * 10)
    monkeypatch.setattr(vectors, "STRIPE", stripe)
    x = planted(np.random.default_rng(9), 600, 16, [(60, 0.0), (200, 0.15), (30, 0.2)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table(spark, x), 0.95).collect()}
    links, label = brute(x, 0.95)
    assert got == {i: (links[i], label[i]) for i in range(len(x))}


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (2, [1.0, 0.01], ""), (None, [1.0, 0.0], "")]
    got = sorted(map(tuple, vectors.near_duplicates(table(spark, [], rows), 0.95).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, None)], key=str)
    assert vectors.near_duplicates(table(spark, [], []), 0.95).collect() == []
    assert ann.nearest(table(spark, [], []), F.col("vec_id") % 2 == 0).collect() == []


def exact(x, ids, query, k):
    u = x.astype(np.float64)
    n = np.sqrt((u * u).sum(axis=1))
    s = (u * u[query]).sum(axis=1) / (n * n[query])
    order = sorted((-v, i) for i, v in zip(ids, s.tolist()) if i != ids[query])
    return [(i, -v) for v, i in order[:k]]


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 40}, {"leaf_rows": 40, "sample_rows": 40, "query_rows": 7}])
def test_neighbours_and_recall(spark, sizes):
    rng = np.random.default_rng(5)
    x = planted(rng, 900, 16, [(40, 0.0), (200, 0.3), (50, 0.05)])
    got = {}
    for r in ann.nearest(table(spark, x, ODD), F.col("vec_id") % 10 == 0, **sizes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = wanted = 0
    for q in range(0, 900, 10):
        want = exact(x, list(range(900)), q, 5)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in want} & {m[1] for m in mine})
        wanted += 5
        for _, i, score in mine:
            assert score == pytest.approx(dict(exact(x, list(range(900)), q, 899))[i], abs=1e-12)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
    assert hits >= 0.95 * wanted
    # Copies: the smallest ids first, never the query itself.
    assert [m[1] for m in sorted(got[0])] == [1, 2, 3, 4, 5] and [m[1] for m in sorted(got[30])] == [0, 1, 2, 3, 4]


def test_groups_of_a_search_are_bounded(spark, monkeypatch):
    """However many vectors and queries one leaf gets, no task sees more than a share of them."""
    rng = np.random.default_rng(6)
    rows = [(i, v, "") for i, v in enumerate(rng.standard_normal((600, 8)).tolist())]
    seen, crowded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    inside = ann.Leaf.__init__

    def watched(self, vectors, points):
        seen.add(1)
        crowded.add(int(len(vectors) > 100))
        inside(self, vectors, points)

    monkeypatch.setattr(ann.Leaf, "__init__", watched)
    cloudpickle.register_pickle_by_value(ann)  # workers get the watched class
    try:
        found = ann.nearest(table(spark, [], rows), F.col("vec_id") >= 0, leaf_rows=25, sample_rows=16, query_rows=50).collect()
        assert len(found) == 600 * 5 and seen.value > 600 / 50 and crowded.value == 0
        ann.nearest(table(spark, [], rows), F.col("vec_id") >= 0, sample_rows=16).collect()
        assert crowded.value > 0
    finally:
        cloudpickle.unregister_pickle_by_value(ann)


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0, 1.0], ""), (2, [1.0, 1.0], ""), (10, [1.0, 2.0, 3.0], ""), (None, [1.0, 0.0], "")]
    got = sorted(map(tuple, ann.nearest(table(spark, [], rows), F.col("vec_id") % 10 == 0).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 2), (0, 2, 1)]


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 6) == pytest.approx(12.591587, abs=1e-5)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-6)
