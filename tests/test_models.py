import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import cluster, conformal, features, forest, project, trees
from panelcast.plans.train import fit_forests, quantile_predictions, train_and_project


def soft_dtw(a, b, gamma):
    r = np.full((len(a) + 1, len(b) + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            before = np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]])
            low = before.min()
            r[i, j] = ((a[i - 1] - b[j - 1]) ** 2).sum() + low - gamma * np.log(np.exp(-(before - low) / gamma).sum())
    return r[-1, -1]


@pytest.mark.parametrize("gamma", [0.01, 1.0])
def test_soft_dtw_distance_and_alignment(gamma):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(3, 4, 2)), rng.normal(size=(5, 2))
    values, alignment = cluster.soft_dtw_kernel(gamma)
    assert values(x, c) == pytest.approx([soft_dtw(s, c, gamma) for s in x])
    e = alignment(x, c)
    step = 1e-5
    for s, j in ((0, 0), (2, 1), (4, 0)):
        up, down = c.copy(), c.copy()
        up[s, j] += step
        down[s, j] -= step
        slope = (values(x, up) - values(x, down)) / (2 * step)
        assert slope == pytest.approx((e[:, :, s] * 2 * (c[s, j] - x[:, :, j])).sum(1), rel=1e-3, abs=1e-3)


def test_large_counts_stay_finite():
    values, _ = cluster.soft_dtw_kernel(0.01)
    x = np.array([[[1e9], [2e9], [4e9]]])
    assert values(x, np.array([[1e9], [2e9], [4e9]]))[0] == pytest.approx(0.0)


def test_clustering_separates_two_shapes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        level = 0.0 if i % 3 else 50.0
        rows += [(y, "06", f"p{i:02d}", float(level + y + rng.normal() * 0.1)) for y in range(6)]
    df = spark.createDataFrame(rows, "year int, state string, place string, v double")
    series = cluster.entity_series(df, 6)
    assert series.count() == 30
    out = cluster.cluster_series(series, k=2, gamma=1.0)
    by_shape = out.withColumn("shape", F.substring("place", 2, 2).cast("int") % 3 == 0)
    assert by_shape.groupBy("shape").agg(F.count_distinct("cluster").alias("n")).where("n <> 1").count() == 0
    assert out.select("cluster").distinct().count() == 2
    assert {r["cluster_size"] for r in cluster.exemplars(out).collect()} == {10, 20}
    far = cluster.series_distances(series, np.zeros((3, 6, 1)), gamma=1.0)
    assert far.count() == 90


def test_too_many_centres_are_refused(spark):
    with pytest.raises(ValueError):
        cluster._check_centres(np.zeros((1000, 200, 101)))


def regression_rows(spark, n=1200):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, (n, 3))
    y = x[:, 0] * 2 + rng.normal(size=n)
    return spark.createDataFrame([(str(i), [float(v) for v in x[i]], float(y[i])) for i in range(n)],
                                 "id string, features array<double>, y double").repartition(3)


def test_forest_quantiles_cover_and_are_ordered(spark, tmp_path):
    df = regression_rows(spark).cache()
    train, test = df.where("cast(id as int) % 4 <> 0"), df.where("cast(id as int) % 4 = 0")
    model = forest.QuantileForest(num_trees=20, max_depth=8).fit(train, ["id"])
    levels = [0.1, 0.5, 0.9]
    scored = model.predict(test, levels).cache()
    assert scored.where("pred[0] > pred[1] or pred[1] > pred[2]").count() == 0
    inside = scored.where("y between pred[0] and pred[2]").count() / test.count()
    assert 0.65 < inside < 0.98

    a = {r["id"]: r["pred"] for r in scored.collect()}
    model.save(str(tmp_path / "m"))
    again = forest.QuantileForestModel.load(spark, str(tmp_path / "m")).predict(test, levels)
    assert {r["id"]: r["pred"] for r in again.collect()} == a


def wide_panel(spark, places=24):
    rows = [(y, "06", f"p{i:02d}", float(10 * i + y), float(i + 2 * y)) for i in range(places) for y in range(12)]
    return spark.createDataFrame(rows, "year int, state string, place string, a double, dn double")


def test_sequence_scorer_matches_linear_projection(spark):
    panel = wide_panel(spark, 6)
    scorer = project.LinearScorer([0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 1.9], spread=0.2)
    cells = panel.unpivot(["state", "place", "year"], ["a", "dn"], "metric", "value")
    lazy = project.project_linear(cells, scorer, 11, 9, [0.4, 0.6])
    weights = np.array(scorer.weights)

    def batch(windows, q):
        return np.einsum("w,nwm->nm", weights, windows) * (1 + 0.2 * (q - 0.5))

    windows = features.latest_window(panel, ["a", "dn"], 11)
    eager = project.project_sequences(windows, batch, ["a", "dn"], 11, 9, [0.4, 0.6])
    keys = ["state", "place", "metric", "q", "year"]
    both = lazy.join(eager.withColumnRenamed("value", "v2"), keys)
    assert both.count() == lazy.count() == 6 * 2 * 2 * 9
    assert both.where("abs(value - v2) > 1e-6").count() == 0
    assert lazy.where("metric = 'a' and value < 0").count() == 0
    assert lazy.where("metric = 'dn' and value < 0").count() > 0


def test_backtest_uses_only_the_past(spark):
    cells = wide_panel(spark, 2).unpivot(["state", "place", "year"], ["a"], "metric", "value")
    steady = project.LinearScorer([0.0] * 6 + [1.0])
    out = project.backtest(cells, steady, [8, 9, 10])
    assert out.count() == 6
    assert out.where("actual - pred <> 1").count() == 0


def test_forest_projection_end_to_end(spark):
    panel = wide_panel(spark)
    calib = F.substring("place", 3, 1) == "0"
    trained, out = train_and_project(
        panel.where(~calib), panel.where(calib), panel, ["a", "dn"], at=11, steps=3, quantiles=[0.4, 0.5, 0.6],
        anchors=range(6, 11), forest=forest.QuantileForest(num_trees=8, max_depth=5, min_leaf=2),
        levels=(0.4, 0.5, 0.6))
    assert trained.model.targets == ("a", "dn") and trained.metrics.count() == 2
    assert out.count() == 24 * 3 * 2 * 3
    assert {r["year"] for r in out.select("year").distinct().collect()} == {12, 13, 14}
    assert out.where("value is null or isnan(value)").count() == 0
    wide = out.groupBy("place", "year", "metric").pivot("q", [0.4, 0.5, 0.6]).agg(F.first("value"))
    assert wide.where("`0.4` > `0.6` + 1e-9").count() == 0


def two_targets(samples, **how):
    forests = forest.QuantileForest(**{"num_trees": 5, "max_depth": 4, "min_leaf": 2, **how})
    return fit_forests(samples, ["a", "dn"], forests)


def test_projection_in_slices_is_the_same(spark, monkeypatch):
    panel = wide_panel(spark, 8)
    model = two_targets(features.window_samples(panel, ["a", "dn"]))
    windows = features.latest_window(panel, ["a", "dn"], 11)
    args = (windows, model, {("a", 0.4): 1.0, ("dn", 0.4): 0.0}, 11, 3, [0.4, 0.6])
    with pytest.raises(KeyError, match="no qhat"):
        project.project_forest(windows, model, {("a", 0.4): 1.0}, 11, 2, [0.4, 0.6])
    local = project.project_forest(*args).cache()
    assert local.count() == 8 * 2 * 2 * 3
    monkeypatch.setattr(forest, "MAX_FOREST_BYTES", 400)
    sliced = forest.QuantileForestModel(model.targets, model.cuts, model.trees)
    assert len(sliced.slices()) > 2
    both = local.join(project.project_forest(windows, sliced, *args[2:]).withColumnRenamed("value", "v2"), ["place", "metric", "q", "year"])
    assert both.count() == 8 * 2 * 2 * 3
    assert both.where("abs(value - v2) > 1e-9").count() == 0


def slow_value(tree, row):
    at = 0
    while tree["child"][at] != at:
        at = tree["child"][at] + (row[tree["column"][at]] > tree["cut"][at])
    return tree["value"][at]


def test_one_pass_projection_against_single_steps(spark):
    panel = wide_panel(spark, 5)
    model = two_targets(features.window_samples(panel, ["a", "dn"]), num_trees=7)
    qhat = {("a", 0.25): 0.5, ("dn", 0.25): 0.25}
    windows = features.latest_window(panel, ["a", "dn"], 11)
    got = {(r["place"], r["metric"], r["q"], r["year"]): r["value"] for r in project.project_forest(
        windows, model, qhat, 11, 4, [0.25, 0.5, 0.75]).collect()}
    grown = [[t for t in model.trees.orderBy("tree").collect() if t["target"] == i] for i in range(2)]
    for w in windows.collect():
        for q in (0.25, 0.5, 0.75):
            path = [list(x) for x in w["x"]]
            for year in range(12, 16):
                row = trees_row(np.array(path[-7:]), model.cuts)
                new = [np.quantile([slow_value(t, row) for t in grown[i]], q) + {0.25: -1, 0.5: 0, 0.75: 1}[q] * qhat[m, 0.25]
                       for i, m in enumerate(("a", "dn"))]
                new[0] = max(new[0], 0.0)
                path.append(new)
                assert [got[w["place"], m, q, year] for m in ("a", "dn")] == pytest.approx(new)


def trees_row(window, cuts):
    """Bins of the features of one window, by the SQL definition."""
    block = []
    for i in range(window.shape[1]):
        own, ema = window[:, i], [window[0, i]]
        for v in own[1:]:
            ema.append(2 / 3 * v + 1 / 3 * ema[-1])
        block += [*own[::-1], *ema[-5:]]
    return [int(np.searchsorted(c, v, side="left")) for c, v in zip(cuts, block)]


def test_window_features_agree(spark):
    samples = features.window_samples(wide_panel(spark, 4), ["a", "dn"])
    rows = features.window_features(samples, 2, out="all").withColumn("one", features.target_vector("x", 1, 2)).collect()
    for r in rows:
        assert [r["all"][k] for k in features.target_positions(1, 2)] == r["one"]


def stored(model):
    return sorted((r["target"], r["tree"], tuple(r["column"]), tuple(r["cut"]), tuple(r["child"]), tuple(map(str, r["value"]))) for r in model.trees.collect())


def paths_of(model):
    """Every tree as nested tuples, whatever the order of its nodes."""
    def below(t, at):
        if t["child"][at] == at:
            return t["value"][at]
        return t["column"][at], t["cut"][at], below(t, t["child"][at]), below(t, t["child"][at] + 1)
    return {(t["target"], t["tree"]): below(t, 0) for t in model.trees.collect()}


@pytest.mark.parametrize("local_rows", [0, 60, 10_000])
def test_growing_by_level_gives_the_same_trees(spark, monkeypatch, local_rows):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, (400, 6))
    x[:, 4] = 3
    rows = [(i, [float(v) if v < 8 else None for v in x[i]], [float(x[i, 0] * 5 + rng.integers(0, 4)), float(x[i, 1] % 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, features array<double>, y array<double>").repartition(3)
    how = forest.QuantileForest(num_trees=4, min_leaf=8, max_depth=7)
    uses = {"p": [0, 2, 3, 4], "q": [1, 5, 4, 0]}
    whole = how.fit_all(df, ["id"], uses)
    assert stored(whole) == stored(how.fit_all(df.repartition(7), ["id"], uses))
    monkeypatch.setattr(forest, "MAX_TABLE_BYTES", 0)
    monkeypatch.setattr(forest, "LOCAL_ROWS", max(1, local_rows))
    monkeypatch.setattr(forest, "MAX_STATISTICS_BYTES", 5 * 2 * 64 * 16)
    monkeypatch.setattr(forest, "MAX_TOP_NODES", 4000)
    assert paths_of(how.fit_all(df, ["id"], uses)) == paths_of(whole)


def test_splits_against_brute_force(spark):
    rng = np.random.default_rng(12)
    for _ in range(30):
        n = 60
        x, y, w = rng.integers(0, 6, (n, 3)).astype(np.uint8), rng.integers(0, 9, n).astype(float), rng.integers(0, 3, n).astype(float)
        columns = np.array([[2, 0]])
        stats = trees.histograms(x, columns, np.arange(n), np.zeros(n, int), w, w * y)
        column, cut, left = trees.best_splits(stats, columns, 5)
        best = None
        for c in (2, 0):
            for b in range(6):
                low = x[:, c] <= b
                if w[low].sum() >= 5 and w[~low].sum() >= 5:
                    score = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum()
                    best = max(best or (-1,), (score, -c, -b))
        if best is None:
            assert column[0] == -1
        else:
            low = x[:, column[0]] <= cut[0]
            score = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum()
            assert score == pytest.approx(best[0]) and left[0] == w[low].sum()


def test_forest_edges(spark):
    how = forest.QuantileForest(num_trees=3, min_leaf=2)
    one = how.fit(spark.createDataFrame([("a", [1.0, None], 5.0)], "id string, features array<double>, y double"), ["id"])
    assert one.predict(spark.createDataFrame([([9.0, 9.0],)], "features array<double>"), [0.1, 0.9]).first()["pred"] == [5.0, 5.0]
    assert one.predict(spark.createDataFrame([], "features array<double>"), [0.5]).collect() == []
    with pytest.raises(Exception, match="missing"):
        how.fit(spark.createDataFrame([("a", [1.0], None)], "id string, features array<double>, y double"), ["id"])
    with pytest.raises(ValueError, match="nothing"):
        how.fit_all(spark.createDataFrame([], "id string, features array<double>, y array<double>"), ["id"], {"y": [0]})


def test_centre_step_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x, centres, gamma = rng.normal(size=(20, 4, 2)), rng.normal(size=(3, 4, 2)), 0.5
    df = spark.createDataFrame([(f"p{i}", s.tolist()) for i, s in enumerate(x)], "place string, series array<array<double>>")
    d = np.array([[soft_dtw(s, c, gamma) for c in centres] for s in x])
    got = {(r["place"], r["centre"]): r["distance"] for r in
           cluster.series_distances(df, centres, gamma, keys=["place"]).collect()}
    assert all(got[f"p{i}", c + 1] == pytest.approx(d[i, c]) for i in range(20) for c in range(3))
    assigned = {r["place"]: r["cluster"] for r in cluster.assign_clusters(df, centres, gamma, ["place"]).collect()}
    assert assigned == {f"p{i}": int(d[i].argmin()) + 1 for i in range(20)}

    _, alignment = cluster.soft_dtw_kernel(gamma)
    want = centres.copy()
    for c in range(3):
        members = [i for i in range(20) if d[i].argmin() == c]
        e = {i: alignment(x[i:i + 1], centres[c])[0] for i in members}
        for s in range(4):
            weight = sum(e[i][t, s] for i in members for t in range(4))
            if members:
                want[c, s] = sum(e[i][t, s] * x[i, t] for i in members for t in range(4)) / weight
    for parts in (1, 6):
        assert cluster._moved_centres(df.repartition(parts), centres, gamma) == pytest.approx(want)


def walks(n, t=6, m=2, seed=21):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=(n, t, m)), axis=1) + 6 * rng.integers(0, 6, (n, 1, 1))


def as_series(spark, x):
    return spark.createDataFrame([(f"p{i:03d}", s.tolist()) for i, s in enumerate(x)], "place string, series array<array<double>>").repartition(4)


def test_pruned_assignment_is_the_full_one():
    x = walks(120)
    for gamma in (0.01, 0.5):
        centres = np.concatenate([x[::7], x[3:4], x[3:4]])
        values, _ = cluster.soft_dtw_kernel(gamma)
        d = np.stack([values(x, c) for c in centres], axis=1)
        nearest, best, made = cluster.nearest_centres(x, centres, gamma)
        assert nearest.tolist() == d.argmin(1).tolist() and best == pytest.approx(d.min(1))
        assert made < 0.7 * d.size


def test_medoids_equal_exhaustive_ones(spark):
    x, gamma = walks(90), 0.1
    d = np.array([[soft_dtw(a, b, gamma) for b in x] for a in x])
    label = np.arange(90) % 3 + 1
    label[:40] = 1
    df = as_series(spark, x).withColumn("cluster", F.element_at(F.array(*[F.lit(int(v)) for v in label]), F.substring("place", 2, 3).cast("int") + 1))
    want = []
    for c in (1, 2, 3):
        mine = np.flatnonzero(label == c)
        want.append(x[mine[d[np.ix_(mine, mine)].mean(axis=1).argmin()]])
    for sample in (100, 12):
        got = cluster.medoids(df, 3, gamma, sample=sample, confidence=6.0, keys=["place"])
        assert got == pytest.approx(np.array(want))


def test_seeds_lie_better_than_hashed_ones(spark):
    x, gamma, k = walks(200), 0.1, 12
    df = as_series(spark, x)
    centres = cluster.seed_centres(df, k, gamma, keys=["place"])
    assert len(np.unique(centres.reshape(k, -1), axis=0)) == k
    hashed = np.array([r["series"] for r in df.orderBy(F.md5("place")).limit(k).collect()])

    def cost(c):
        return cluster.nearest_centres(x, c, gamma)[1].sum()
    assert cost(centres) < 0.7 * cost(hashed)
    assert len(cluster.seed_centres(df.where("place < 'p005'"), 9, gamma, keys=["place"])) == 5


def test_clusters_around_medoids(spark):
    x = walks(60)
    out = cluster.cluster_series(as_series(spark, x), 6, 0.1, max_iter=8, keys=["place"], around="medoids").collect()
    assert len(out) == 60 and {r["cluster"] for r in out} == set(range(1, 7)) and all(r["settled"] for r in out)
    assert sum(r["distance"] <= cluster.soft_dtw_kernel(0.1)[0](x[:1], x[0])[0] + 1e-9 or r["distance"] < 0 for r in out) >= 6


def test_sequence_scores_feed_calibration(spark):
    samples = features.window_samples(wide_panel(spark, 6), ["a", "dn"])

    def steady(windows, q):
        return windows[:, -1, :] + (q - 0.5)

    scored = project.score_sequences(samples, steady, ["a", "dn"], [0.49, 0.51])
    qhat = conformal.cqr_calibrate(scored, ids=["state", "place", "year"])
    got = {r["target"]: r["qhat"] for r in qhat.collect()}
    assert got == {"a": pytest.approx(1 - 0.01), "dn": pytest.approx(2 - 0.01)}
    windows = features.latest_window(wide_panel(spark, 6), ["a", "dn"], 11)
    with pytest.raises(KeyError, match="no qhat"):
        project.project_sequences(windows, steady, ["a", "dn"], 11, 1, [0.49, 0.51], qhat={("a", 0.49): 5.0})
    shifted = project.project_sequences(windows, steady, ["a", "dn"], 11, 1, [0.49, 0.51],
                                        qhat={("a", 0.49): 5.0, ("dn", 0.49): 0.0}, floor={"a": 8.0, "dn": 1e9})
    first = {(r["metric"], r["q"]): r["value"] for r in shifted.where("place = 'p00'").collect()}
    assert first["a", 0.49] == 8.0 and first["a", 0.51] == pytest.approx(11 + 0.01 + 5)
    assert first["dn", 0.51] == pytest.approx(22.01)


def test_forest_backtest_matches_prediction(spark):
    samples = features.window_samples(wide_panel(spark, 12), ["a", "dn"])
    model = two_targets(samples)
    out = project.backtest_forest(samples, model)
    assert out.count() == samples.count() * 2
    assert out.join(samples.withColumn("year", F.col("year") + 1), ["state", "place", "year"]).where(
        "actual <> y[CASE metric WHEN 'a' THEN 0 ELSE 1 END]").count() == 0
    direct = quantile_predictions(model, samples, [0.5]).withColumn("year", F.col("year") + 1)
    both = out.join(direct.withColumnsRenamed({"target": "metric", "pred": "direct"}), ["state", "place", "year", "metric"])
    assert both.count() == samples.count() * 2
    assert both.where("abs(pred - CASE metric WHEN 'a' THEN greatest(direct, 0) ELSE direct END) > 1e-9").count() == 0


def test_leaf_values_come_from_the_leaf(spark):
    rows = regression_rows(spark, 300).collect()
    model = forest.QuantileForest(num_trees=3, max_depth=4).fit(spark.createDataFrame(rows), ["id"])
    for tree in model.trees.collect():
        met = {}
        for r in rows:
            bins = [int(np.searchsorted(c, v, side="left")) for c, v in zip(model.cuts, r["features"])]
            met.setdefault(slow_value(tree, bins), set()).add(r["y"])
        assert all(drawn in found for drawn, found in met.items())
        assert len(met) == sum(c == i for i, c in enumerate(tree["child"])) > 4
