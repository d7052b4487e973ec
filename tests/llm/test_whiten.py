import math
import os

import numpy as np
import pytest

from panelcast.llm import whiten
from panelcast.llm.queries import op13_whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def spd(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T, q


def test_polar_factor():
    for seed, values in enumerate([[5, 3, -1, -4], [1e-9, 1, -1e-7, 100, 3], list(range(-20, 0)) + list(range(1, 21))]):
        a, q = spd(values, seed)
        u = whiten.polar_factor(a)
        assert np.abs(u - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-6
        assert np.abs(u @ u - np.eye(len(u))).max() < 1e-12
    assert (whiten.polar_factor(np.zeros((3, 3))) == np.eye(3)).all()


@pytest.mark.parametrize("values", [
    [9, 4, 1], [7], list(np.geomspace(1, 1e6, 40)), list(np.linspace(1, 2, 64)), [3] * 6, [5, 5, 5, 2, 2, 1e-3], [4, 0, 0, 0], [1e12, 1, 1, 1e-3],
    [0, 0], list(np.random.default_rng(1).uniform(0.9, 1.1, 100))])
def test_components(values):
    a, _ = spd(values, 3)
    for wanted in (None, 2):
        got, vectors = whiten.components_of(a, wanted)
        k = len(got)
        want = np.sort(values)[::-1][:k]
        assert k == min(len(values), wanted or len(values))
        assert np.abs(got - want).max() <= 1e-13 * max(1, max(values)) * len(values)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * max(1, max(values)) * len(values)


def test_eigenvectors_match_a_dense_solver():
    x = np.random.default_rng(2).standard_normal((3000, 64)) * np.geomspace(1, 3, 64)
    v = np.cov(x.T, bias=True)
    _, vectors = whiten.components_of(v, 8)
    want = np.linalg.eigh(v)[1][:, ::-1][:, :8]
    assert np.abs(np.abs((vectors * want).sum(axis=0)) - 1).max() < 1e-13
    assert np.abs(vectors * np.sign((vectors * want).sum(axis=0)) - want).max() < 1e-10


def brute(vectors):
    """Integers, deviations, whitened components, explained shares by numpy; ``vectors`` of one length."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    return n, dev, z @ q[:, ::-1], e[::-1], np.trace(v)


def check(rows, ids, vectors, wanted=8):
    n, dev, spots, e, trace = brute(vectors)
    k = min(wanted, len(e))
    assert len(rows) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in rows}
    signs = [0] * k
    for j in range(k):
        for i, name in enumerate(ids):
            r = by[name, j + 1]
            assert (r.n, int(r.deviation)) == (n, dev[i])
            assert abs(r.explained - e[j] / trace) <= 1e-10
            assert r.identity_error < 1e-8
            w = spots[i, j] / np.sqrt(e[j])
            if abs(w) > 1e-6:
                signs[j] = signs[j] or np.sign(w * r.whitened)
                assert abs(r.whitened * signs[j] - w) < 1e-6


def test_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((200, 12)) * np.geomspace(3, 0.2, 12)).astype("f4")
    bad = [None, [], [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900 + i, v, "") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(7)
    check(whiten.whiten(df).collect(), range(200), x)


def test_query_on_the_test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = op13_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double",
                                "identity_error": "double"}
    check(got.collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_degenerate_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    same = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in same) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same} == {(3, 0, None, 0.0, 0.0)}
    # Two lengths, rank one each.
    two = whiten.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0]), (4, [7.0]), (5, [6.0])], kind)).collect()
    found = {(r.vec_id, r.component): r for r in two}
    assert len(two) == 7 and found[1, 1].n == 2 and found[3, 1].n == 3
    assert abs(found[1, 1].whitened) == pytest.approx(1) and found[1, 2].whitened is None and found[1, 1].explained == pytest.approx(1)
    assert sorted(round(found[i, 1].whitened ** 2, 9) for i in (3, 4, 5)) == [0, 1.5, 1.5]


def test_exact_deviations_beyond_a_long(spark):
    rows = [(1, [3e5, -2e5]), (2, [1e13, 5.0]), (3, [1e300, -1e300])]
    got = {(r.vec_id, r.component): r for r in whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    big = 1 << 53
    x = [[min(max(math.floor(1024 * c), -big), big) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for (i, _), row in zip(rows, x):
        assert int(got[i, 1].deviation) == sum((3 * a - s) ** 2 for a, s in zip(row, sums))
