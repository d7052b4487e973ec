"""Clustering of many series: pruned, incremental and sliced ways give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import cluster
from tests.test_models import as_series, soft_dtw, walks


@pytest.mark.parametrize("gamma", [0.01, 2.0])
@pytest.mark.parametrize("steps,width", [(1, 1), (1, 4), (5, 1), (6, 3), (3, 6)])
def test_swept_pairs_equal_the_recursion(steps, width, gamma, monkeypatch):
    rng = np.random.default_rng(steps * 10 + width)
    x, c = rng.normal(size=(40, steps, 2)), rng.normal(size=(3, width, 2))
    i, j = np.divmod(np.arange(120), 3)
    monkeypatch.setattr(cluster, "TABLE_CELLS", 1)
    assert cluster.pair_distances(x, c, i, j, gamma) == pytest.approx([soft_dtw(x[a], c[b], gamma) for a, b in zip(i, j)], abs=1e-9)


def test_few_soft_alignments_where_nothing_lies_apart():
    x = np.random.default_rng(3).normal(size=(300, 12, 8))
    centres = np.concatenate([x[::6], x[6:7]])
    values, _ = cluster.soft_dtw_kernel(0.01)
    d = np.stack([values(x, c) for c in centres], axis=1)
    nearest, best, made = cluster.nearest_centres(x, centres, 0.01)
    assert nearest.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()
    assert made < 3 * len(x)


def test_series_far_apart_and_copies_find_their_centres():
    x = np.repeat(walks(40), 3, axis=0) * 50
    centres = np.concatenate([x[::3], x[:1]])
    nearest, best, made = cluster.nearest_centres(x, centres, 0.01)
    assert nearest.tolist() == np.repeat(np.arange(40), 3).tolist() and made <= 2 * len(x)
    assert cluster.nearest_centres(x[:0], centres, 0.01)[0].tolist() == []


def test_reassignment_equals_assignment(spark):
    x, gamma = walks(80), 0.1
    df, first, moved = as_series(spark, x), x[:9], np.concatenate([x[1:5], x[30:36]])
    state = cluster.reassign(df, first, gamma, ["place"])
    numbers = np.array([-1, 0, 1, 2, 3, 4, 5, -1, 6])
    got = cluster.reassign(state, moved, gamma, ["place"], numbers, np.arange(10) < 4)
    want = cluster.assign_clusters(df, moved, gamma, ["place"])
    assert sorted(got.drop("series").collect()) == sorted(want.collect())


def test_spread_out_equals_the_plain_greedy():
    rng = np.random.default_rng(5)
    apart = np.abs(rng.normal(size=(90, 90)))
    np.fill_diagonal(apart, 0)
    apart[7], apart[:, 7] = apart[3], apart[:, 3]
    weight = rng.integers(0, 9, 90).astype(float)
    taken = [int(weight.argmax())]
    while len(taken) < 60:
        least = apart[:, taken].min(axis=1)
        gain = (weight[:, None] * np.maximum(least[:, None] - apart, 0)).sum(axis=0)
        gain[taken] = -1
        taken.append(int(gain.argmax()))
    assert cluster._spread_out(apart, weight, 60) == taken


def test_medoids_of_clusters_larger_than_a_task_may_hold(spark, monkeypatch):
    x, gamma = walks(70), 0.1
    x[40:52] = x[39]
    label = np.where(np.arange(70) < 60, 1, np.arange(70))
    df = as_series(spark, x).withColumn("cluster", F.element_at(F.array(*[F.lit(int(v)) for v in label]), F.substring("place", 2, 3).cast("int") + 1))
    d = np.array([[soft_dtw(a, b, gamma) for b in x[:60]] for a in x[:60]])
    want = np.concatenate([x[d.mean(axis=1).argmin()][None], x[60:]])
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 400)
    monkeypatch.setattr(cluster, "SLICE", 16)
    for sample in (100, 12):
        assert cluster.medoids(df, 11, gamma, sample=sample, confidence=6.0, keys=["place"]) == pytest.approx(want)


def test_medoids_are_exact_whatever_the_sample(spark, monkeypatch):
    x, gamma = walks(64), 0.1
    df = as_series(spark, x).withColumn("cluster", F.when(F.col("place") < "p050", 1).otherwise(2))
    d = np.array([[soft_dtw(a, b, gamma) for b in x] for a in x])
    want = np.stack([x[d[:50, :50].sum(axis=1).argmin()], x[50 + d[50:, 50:].sum(axis=1).argmin()]])
    for size in (256, 9):
        monkeypatch.setattr(cluster, "SLICE", size)
        assert (cluster.medoids(df, 2, gamma, sample=1, confidence=0.0, keep=60, keys=["place"]) == want).all()


def test_a_cluster_whose_members_stay_keeps_its_medoid(spark, monkeypatch):
    x, gamma, asked, central = walks(90), 0.1, [], cluster._central

    def noted(everyone, gamma, keys, among=None):
        asked.append(among)
        return central(everyone, gamma, keys, among)

    monkeypatch.setattr(cluster, "_central", noted)
    some, settled, state = cluster._fit_medoids(as_series(spark, x).cache(), 12, gamma, 123, 8, ["place"])
    assert settled and asked[0] is None and all(len(a) < 12 for a in asked[1:])
    assert (central(cluster.cut_lineage(state), gamma, ["place"])[1] == some).all()
