import pytest
from pyspark.sql import functions as F

from panelcast.operators import features, relate, scale, split

SERIES_SCHEMA = "state string, place string, metric string, year int, value double"


def series(spark, values, years=None, place="a"):
    years = years or range(2011, 2011 + len(values))
    return spark.createDataFrame([("06", place, "m", y, float(v)) for y, v in zip(years, values)], SERIES_SCHEMA)


def test_lags_are_row_based_unless_gap_aware(spark, rows):
    df = series(spark, [1, 2, 3], [2010, 2012, 2013])
    assert rows(features.lag_features(df, 1), "year", "lag_1") == [(2010, None), (2012, 1.0), (2013, 2.0)]
    gaps = features.lag_features(df, 2, gap_aware=True)
    assert rows(gaps, "year", "lag_1", "lag_2") == [(2010, None, None), (2012, None, 1.0), (2013, 2.0, None)]


def test_lead_undoes_lag(spark):
    df = features.lead_target(features.lag_features(series(spark, range(10)), 1))
    shifted = df.withColumn("back", F.expr("lag(y) over (partition by place order by year)"))
    assert shifted.where("lag_1 is not null and back <> value").count() == 0


def test_ema_of_one_to_seven(spark):
    out = features.panel_features(series(spark, range(1, 8))).where("year = 2017").first()
    assert [round(out[f"ema_{i}"], 6) for i in range(5, 0, -1)] == [2.555556, 3.518519, 4.506173, 5.502058, 6.500686]


def test_history_keeps_order(spark):
    out = features.history(series(spark, range(10)), 7).where("year = 2020").first()
    assert out["history"] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_samples_need_full_windows(spark):
    wide = spark.createDataFrame([(y, "06", "a", float(y), -float(y)) for y in range(2010, 2022)]
                                 + [(y, "06", "gap", 1.0, 1.0) for y in range(2010, 2022) if y != 2015],
                                 "year int, state string, place string, p double, q double")
    out = features.window_samples(wide, ["p", "q"])
    got = {(r["place"], r["year"]): r for r in out.collect()}
    assert sorted(got) == [("a", y) for y in range(2016, 2021)]
    assert got["a", 2018]["x"][0] == [2012.0, -2012.0] and got["a", 2018]["y"] == [2019.0, -2019.0]
    assert features.window_samples(wide, ["p"], anchors=[2017, 2019]).count() == 2
    latest = features.latest_window(wide, ["p"], 2021).collect()
    assert [r["place"] for r in latest] == ["a"]
    assert latest[0]["x"][-1] == [2021.0]


def test_target_vector_has_33_features(spark):
    x = [[float(10 * step + j) for j in range(22)] for step in range(7)]
    df = spark.createDataFrame([(x,)], "x array<array<double>>")
    vector = df.select(features.target_vector("x", 3, 22).alias("v")).first()["v"]
    assert len(vector) == 33
    assert vector[:7] == [63.0, 53.0, 43.0, 33.0, 23.0, 13.0, 3.0]
    assert vector[12:] == [float(60 + j) for j in range(22) if j != 3]


def test_scaler_round_trip_and_constant_measure(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 10.0), ("c", 5.0), ("c", 5.0)], "metric string, value double")
    stats = scale.fit_scaler(df)
    scaled = scale.standardize(df, stats)
    assert rows(scaled.where("metric = 'c'"), "value") == [(0.0,), (0.0,)]
    back = scale.unstandardize(scaled, stats)
    assert [round(r[0], 9) for r in rows(back.where("metric = 'a'"), "value")] == [1.0, 10.0, 4.0]
    sd = scale.fit_global_sd(df)
    again = scale.unscale_global(scale.scale_global(df, sd), sd)
    assert [round(r[0], 9) for r in rows(again, "value")] == [1.0, 10.0, 4.0, 5.0, 5.0]


def test_holdout_splits_everything_once(spark, rows):
    df = spark.createDataFrame([("06", "1"), ("06", "2"), ("07", "1"), ("07", "3")], "state string, place string")
    held, rest = relate.split_by_list(df, df.where("state = '06' and place = '1'"))
    assert rows(held, "state", "place") == [("06", "1")]
    assert rows(rest, "state", "place") == [("06", "2"), ("07", "1"), ("07", "3")]


def test_same_place_code_in_two_states(spark, rows):
    df = spark.createDataFrame([(y, "06", "1") for y in range(3)] + [(0, "07", "1")],
                               "year int, state string, place string")
    assert relate.require_history(df, 3).select("state").distinct().collect()[0][0] == "06"
    assert relate.require_history(df, 1, at_least=True, present_at=2).count() == 3


def test_decode_rejects_ambiguous_lookup(spark, rows):
    df = spark.createDataFrame([("1", 1.0)], "place string, v double")
    good = spark.createDataFrame([("1", "One")], "FIPS string, Name string")
    assert rows(relate.decode(df, good, "FIPS", "Name", "place"), "place", "v") == [("One", 1.0)]
    with pytest.raises(ValueError):
        relate.decode(df, good.unionByName(good.withColumn("Name", F.lit("Uno"))), "FIPS", "Name", "place")


def test_holdout_sizes(spark):
    entities = [(c, "06", f"{c}-{i}") for c, n in ((1, 1), (2, 9), (3, 10), (4, 14), (5, 15), (6, 3000)) for i in range(n)]
    df = spark.createDataFrame(entities, "cluster int, state string, place string")
    out = split.stratified_holdout(df.unionByName(df))
    got = {r["cluster"]: (r["n"], r["s"]) for r in out.groupBy("cluster").agg(
        F.sum("calib").alias("n"), F.max("cluster_size").alias("s")).collect()}
    assert got == {1: (1, 1), 2: (1, 9), 3: (2, 10), 4: (2, 14), 5: (3, 15), 6: (600, 3000)}
    again = split.stratified_holdout(df.repartition(7))
    assert out.exceptAll(again).count() == 0
    assert split.stratified_holdout(df, seed=7).exceptAll(out).count() > 0


def test_compare_projections_follows_first_series(spark, rows):
    a = spark.createDataFrame([(2022, "06", "1", 1.0), (2023, "06", "1", 2.0)], "year int, state string, place string, v double")
    b = spark.createDataFrame([(2022, "06", "1", 5.0), (2022, "06", "2", 6.0)], a.schema)
    assert rows(relate.compare_projections({"a": a, "b": b}, "v"), "year", "a", "b") == [(2022, 1.0, 5.0), (2023, 2.0, None)]
