import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import aggregate, conformal, metrics, quantiles


def skewed(spark):
    """One group with most rows, a value repeated in a third of them, and small groups."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    data = {"hot": hot, "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "flat": np.full(50, 2.0)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    return data, spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize("small_group", [0, 200_000])
def test_exact_quantiles_both_ways(spark, small_group):
    data, df = skewed(spark)
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, "x", levels, ["g"], small_group=small_group).collect()
    assert len(got) == len(levels) * len(data)
    for r in got:
        assert r["value"] == pytest.approx(np.quantile(data[r["g"]], r["level"]), abs=1e-12)
        assert r["n"] == len(data[r["g"]])


@pytest.mark.parametrize("small_group", [0, 200_000])
def test_weighted_quantiles_both_ways(spark, small_group):
    rng = np.random.default_rng(6)
    x, w = rng.integers(0, 400, 3000).astype(float), rng.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double")
    order = np.argsort(x, kind="stable")
    cum = np.cumsum(w[order])
    got = {r["level"]: r["value"] for r in quantiles.weighted_quantiles(
        df, "x", "w", [0.001, 0.3, 0.5, 1.0], small_group=small_group).collect()}
    assert got == {q: x[order][np.searchsorted(cum, q * cum[-1])] for q in (0.001, 0.3, 0.5, 1.0)}


def test_quantiles_ignore_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    assert quantiles.exact_quantiles(df, "x", [0.5]).first()["value"] == 1.5
    assert quantiles.exact_quantiles(df.where("x > 9"), "x", [0.5]).count() == 0


def test_conformal_level_is_clamped(spark):
    df = spark.createDataFrame([("t", 0.05, float(s)) for s in range(5)] + [("t", 0.4, float(s)) for s in range(5)],
                               "target string, alpha double, score double")
    got = {r["alpha"]: (r["qhat"], r["clamped"]) for r in quantiles.conformal_qhat(df).collect()}
    assert got[0.05] == (4.0, True)
    assert got[0.4][0] == pytest.approx(np.quantile(np.arange(5.0), 6 * 0.6 / 5)) and not got[0.4][1]


def test_cqr_covers_exchangeable_data(spark):
    rng = np.random.default_rng(11)
    n, levels = 4000, (0.1, 0.5, 0.9)
    y = rng.normal(size=n)
    rows = [("t", str(i), i % 2, float(v), q, 0.5 * (q - 0.5)) for i, v in enumerate(y) for q in levels]
    df = spark.createDataFrame(rows, "target string, id string, half int, y double, q double, pred double")
    qhat = conformal.cqr_calibrate(df.where("half = 0"), ["id"])
    moved = conformal.cqr_adjust(df.where("half = 1"), qhat)
    bands = moved.groupBy("id", "y").pivot("q", list(levels)).agg(F.first("pred"))
    covered = bands.where("`0.1` <= y and y <= `0.9`").count() / (n / 2)
    assert covered == pytest.approx(0.9, abs=0.03)
    assert bands.where("`0.5` <> 0").count() == 0


def aligned(spark):
    return spark.createDataFrame([("m", 1.0, 2.0), ("m", 5.0, 4.0), ("m", 30.0, 9.0)], "metric string, pred double, actual double")


def test_accuracy_metrics(spark):
    got = metrics.accuracy(aligned(spark)).first()
    e = np.array([1 / 3, 1 / 5, 21 / 10])
    assert got["mae"] == pytest.approx((1 + 1 + 21) / 3)
    assert got["mape"] == pytest.approx(100 * e[e <= np.quantile(e, 0.95)].mean())
    fit = metrics.regression_metrics(aligned(spark), ["metric"], y="actual").first()
    assert fit["rmse"] == pytest.approx(math.sqrt((1 + 1 + 441) / 3))
    assert fit["r2"] == pytest.approx(np.corrcoef([1, 5, 30], [2, 4, 9])[0, 1] ** 2)


def test_losses_against_numpy(spark):
    y, p, q = np.array([2.0, 4.0, 9.0]), np.array([1.0, 5.0, 30.0]), 0.4
    e = y - p
    signed = np.where(e >= 0, np.sqrt(q**2 * e**2 + 1) - 1, -(np.sqrt((1 - q) ** 2 * e**2 + 1) - 1))
    cov = ((p - p.mean()) * (y - y.mean())).mean()
    contrast = (2 * p.std() * y.std() + 1e-8) / (p.std() ** 2 + y.std() ** 2 + 1e-8)
    s_loss = 1 - contrast * (cov + 1e-8) / (p.std() * y.std() + 1e-8)
    got = metrics.combined_loss(aligned(spark), F.lit(q), ["metric"]).first()
    assert got["q_loss"] == pytest.approx(np.abs(signed).mean())
    assert got["m_loss"] == pytest.approx(abs(signed.mean()))
    assert got["s_loss"] == pytest.approx(s_loss)
    assert got["loss"] == pytest.approx(np.abs(signed).mean() + abs(signed.mean()) * s_loss)


def test_mean_row_sits_before_total(spark):
    table = spark.createDataFrame([(1, "a", 2.0), (2, "b", 4.0), (3, "Total", 9.0)], "sort int, label string, v double")
    got = metrics.with_mean_row(table, "label", ["v"]).orderBy("sort").collect()
    assert [(r["label"], r["v"]) for r in got] == [("a", 2.0), ("b", 4.0), ("Mean", 3.0), ("Total", 9.0)]


def test_totals_equal_sum_of_parts(spark):
    df = spark.createDataFrame([(2010, "06", "a", 1.0), (2010, "07", "b", 2.0), (2011, "06", "a", 5.0)],
                               "year int, state string, place string, v double")
    out = {r["year"]: r["v"] for r in aggregate.with_totals(df).where("place = '0'").collect()}
    assert out == {2010: 3.0, 2011: 5.0}
    assert aggregate.without_totals(aggregate.with_totals(df)).count() == 3


def test_densities_integrate_to_one(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(1, 0.5, 500)], "g string, x double")
    curve = aggregate.kde(df, "x", ["g"], -8, 10).orderBy("i").collect()
    ys = np.array([r["density"] for r in curve])
    assert len(ys) == 512 and np.trapezoid(ys, [r["x"] for r in curve]) == pytest.approx(1, abs=1e-3)
    x = np.array([r["x"] for r in df.collect()])
    bw = 0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2
    at = curve[256]["x"]
    exact = np.exp(-0.5 * ((at - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
    assert curve[256]["density"] == pytest.approx(exact, rel=2e-2)
    bars = aggregate.histogram_density(df, "x", -8, 10, 30).collect()
    assert sum(r["density"] for r in bars) * (18 / 30) == pytest.approx(1)
    assert sum(r["n"] for r in bars) == 500


def test_many_groups_stay_lazy_and_leave_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(24_000).selectExpr("id % 6000 AS g", "CAST(id AS DOUBLE) AS x")
    got = quantiles.exact_quantiles(df, "x", [0.5], ["g"])
    assert got.count() == 6000
    assert got.where("value <> g + 9000").count() == 0
    curves = aggregate.kde(df.where("g < 600"), "x", ["g"], -10.0, 30_000.0, points=8)
    assert curves.count() == 600 * 8
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_one_group_over_many_buckets(spark):
    df = spark.range(20_000).selectExpr("CAST((id * 7919) % 20000 AS DOUBLE) AS x")
    got = {r["level"]: r["value"] for r in quantiles.exact_quantiles(df, "x", [0.1, 0.5], small_group=1000).collect()}
    assert got == {0.1: pytest.approx(1999.9), 0.5: pytest.approx(9999.5)}


def test_a_group_of_one_value_has_no_curve_and_empty_bins_are_listed(spark):
    df = spark.createDataFrame([("one", 1.0), ("two", 1.0), ("two", 2.0)], "g string, x double")
    assert {r["g"] for r in aggregate.kde(df, "x", ["g"], 0.0, 3.0).collect()} == {"two"}
    bars = aggregate.histogram_density(df, "x", 0.0, 4.0, bins=4, by=["g"]).orderBy("g", "bin").collect()
    assert [(b["g"], b["n"]) for b in bars] == [("one", n) for n in (0, 1, 0, 0)] + [("two", n) for n in (0, 1, 1, 0)]


def test_a_missing_qhat_is_an_error(spark):
    preds = spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.5, 2.0)], "target string, q double, pred double")
    qhat = spark.createDataFrame([("a", 0.1, 0.5)], "target string, alpha double, qhat double")
    assert sorted(r["pred"] for r in conformal.cqr_adjust(preds, qhat).collect()) == [0.5, 2.0]
    with pytest.raises(Exception, match="no qhat"):
        conformal.cqr_adjust(preds, qhat.withColumn("alpha", F.lit(0.2))).collect()
