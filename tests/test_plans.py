import numpy as np
import pytest

from panelcast.functions.codes import AGE_LABELS, AGE_METRICS, POPULATION
from panelcast.plans import describe, evaluate, report


def ages(spark, places, years=(2010, 2021)):
    cols = ", ".join(f"{c} double" for c in (POPULATION, *AGE_METRICS))
    rows = [(y, "06", p, *[18.0 * n * k, *[float(n * k)] * 18]) for p, n in places.items() for k, y in enumerate(years, 1)]
    return spark.createDataFrame(rows, f"year int, state string, place string, {cols}")


def test_descriptive_report(spark):
    out = describe.descriptive_report(ages(spark, {"a": 1, "b": 2}), ages(spark, {"held": 4}).drop("nothing"), 2010, 2021, 2)
    total = out.panel.where("place = '0' and year = 2010").first()
    assert (total[POPULATION], total["youth"], total["working"], total["senior"]) == (126.0, 35.0, 56.0, 35.0)
    assert total["working_senior_ratio"] == pytest.approx(8 / 5)
    growth = {r["place"]: r["growth_rate"] for r in out.growth().collect()}
    assert growth == {"a": 100.0, "b": 100.0, "held": 100.0}
    assert out.composition().count() == 2 * 3 * 2
    assert out.axis().first()[0] == 252.0
    assert sorted((r["bin"], r["n"]) for r in out.growth_histogram().collect()) == [(b, 3 if b == 21 else 0) for b in range(30)]
    assert out.ratio_density().count() == 2 * 512


def test_evaluation_table_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(y, "06", p, m, float(rng.integers(1, 50)), float(rng.integers(1, 50)))
            for y in (2018, 2019) for p in "abcdefgh" for m in AGE_METRICS]
    df = spark.createDataFrame(rows, "year int, state string, place string, metric string, pred double, actual double")
    got = evaluate.evaluation_table({"m": df}).orderBy("sort").collect()
    assert [r["label"] for r in got] == [*AGE_LABELS, "Mean", "Total"]
    assert got[18]["mae_m"] == pytest.approx(np.mean([r["mae_m"] for r in got[:18]]), abs=0.01)
    pred, actual = (np.array([r[i] for r in rows]).reshape(16, 18).sum(1) for i in (4, 5))
    e = np.abs(pred - actual) / (1 + actual)
    assert got[19]["mae_m"] == pytest.approx(np.abs(pred - actual).mean(), abs=0.01)
    assert got[19]["mape_m"] == pytest.approx(100 * e[e <= np.quantile(e, 0.95)].mean(), abs=0.01)


def test_projection_series(spark):
    rows = [(model, q, 2060, "06", p, m, v * (1 + q)) for model in ("rf", "nn") for q in (0.4, 0.5, 0.6)
            for p, v in (("a", 1.0), ("b", 2.0)) for m in AGE_METRICS]
    paths = spark.createDataFrame(rows, "model string, q double, year int, state string, place string, metric string, value double")
    series = report.projection_series(paths, {0.4: "Lower", 0.5: "Middle", 0.6: "Upper"})
    assert series.count() == 2 * 3 * 3
    total = series.where("model = 'rf' and quantile = 'Upper' and place = '0'").first()
    assert total["total"] == pytest.approx(18 * 3 * 1.6) and total["working_senior_ratio"] == pytest.approx(1.6)
    table = report.total_comparison(series, [("rf", "Middle"), ("nn", "Upper")])
    assert table.count() == 3 and set(table.columns) >= {"total_middle_rf", "total_upper_nn"}
    order = {r["quantile"]: r["quantile_order"] for r in report.tagged_series(series).collect()}
    assert order == {"Upper": 1, "Middle": 2, "Lower": 3}
    assert report.ratio_distribution(series, [2060]).select("type").distinct().count() == 2


def test_history_stands_in_front_of_every_path(spark):
    schema = "year int, state string, place string, metric string, value double"
    observed = spark.createDataFrame([(y, "06", p, m, float(i)) for y in (2020, 2021) for p in "ab" for i, m in enumerate(AGE_METRICS)], schema)
    paths = observed.where("year = 2021").selectExpr("explode(array('rf', 'nn')) AS model", "0.5D AS q", "2060 AS year", "state", "place",
                                                     "metric", "value * 2 AS value")
    whole = report.with_history(paths, observed, ("rf", "nn"), (0.5,))
    assert whole.count() == paths.count() + 2 * observed.count()
    series = report.projection_series(whole, {0.5: "Middle"}).cache()
    assert series.where("place = 'a'").count() == 2 * 3
    kinds = report.ratio_distribution(series, [2021, 2060], last_observed=2021, model="rf").select("type").distinct().collect()
    assert sorted(r["type"] for r in kinds) == ["2021", "2060_nn", "2060_rf"]
