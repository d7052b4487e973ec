import os

import pytest
from pyspark.sql import functions as F

from panelcast.functions.codes import KEYS, TIME, code
from panelcast.operators import clean, features
from panelcast.sources import quality
from panelcast.sources.releases import read_release, stack_all
from panelcast.sources.stages import Stages

M = code("S0101", 1, 1)


def panel(spark, years=range(2010, 2016), places=40, shift=0.0):
    rows = [(y, "06", f"{i:05d}", i * 10.0 + y + shift) for y in years for i in range(places)]
    return spark.createDataFrame(rows, f"year int, state string, place string, {M} double")


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_windows_joins_and_aggregates_over_a_bucketed_stage_have_no_exchange(spark, tmp_path):
    df = panel(spark)
    stages = Stages(spark, str(tmp_path))
    a, b = stages.save_bucketed(df, "panel", 4), stages.save_bucketed(panel(spark, shift=1.0), "other", 4)
    lags = features.lag_features(a, 2, M, KEYS)
    assert exchanges(lags) == 0 and exchanges(features.lag_features(df, 2, M, KEYS)) > 0
    assert sorted(map(repr, lags.select(TIME, *KEYS, M, "lag_1").collect())) == sorted(
        map(repr, features.lag_features(df, 2, M, KEYS).select(TIME, *KEYS, M, "lag_1").collect()))
    ends = b.groupBy(*KEYS).agg(F.max(M).alias("m"))
    assert exchanges(a.hint("merge").join(ends, list(KEYS))) == 0
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        both = a.hint("merge").join(b.withColumnRenamed(M, "m"), [*KEYS, TIME])
        assert exchanges(both) == 0 and both.where(F.col("m") == F.col(M) + 1).count() == 240
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert exchanges(a.groupBy(*KEYS).agg(F.max(M))) == 0


def test_a_release_rewrites_its_own_partition(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    stages.save_bucketed(panel(spark), "panel", 4)
    before = files(tmp_path)
    out = stages.replace_partitions(panel(spark, [2013], shift=0.5).unionByName(panel(spark, [2016])), "panel")
    after = files(tmp_path)
    kept = {f for f in before if "year=2013" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not {f for f in before if "year=2013" in f} & set(after)
    got = {r[TIME]: (r["n"], r["s"]) for r in out.groupBy(TIME).agg(F.count(F.lit(1)).alias("n"), F.sum(M).alias("s")).collect()}
    base = sum(i * 10.0 for i in range(40))
    assert got == {y: (40, base + 40 * (y + (0.5 if y == 2013 else 0))) for y in range(2010, 2017)}
    assert exchanges(features.lag_features(out, 1, M, KEYS)) == 0


def test_a_later_session_opens_the_stage(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    first = stages.save_bucketed(panel(spark), "panel", 4)
    schema = first.schema
    spark.sql(f"DROP TABLE {stages._table('panel')}")
    again = Stages(spark, str(tmp_path)).open_bucketed("panel", schema, 4)
    assert again.count() == 240 and exchanges(features.lag_features(again, 1, M, KEYS)) == 0


def test_an_empty_release_changes_nothing(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    stages.save_bucketed(panel(spark), "panel", 2)
    assert stages.replace_partitions(panel(spark).where("1 = 0"), "panel").count() == 240


RELEASE = """state,place,S0101_C01_001E,S0101_C01_002E,S0701_C01_001E,note
06,00001,(X),1,-888888888,
06,00002,-,,5,7
06,00003,12.5,-222222222.0,N,8
06,00004,,NaN,3,x
"""


def test_cells_are_counted_while_they_are_read(spark, tmp_path):
    (tmp_path / "2018.csv").write_text(RELEASE)
    (tmp_path / "2019.csv").write_text(RELEASE.split("\n")[0] + "\n")
    path = {y: str(tmp_path / f"{y}.csv") for y in (2018, 2019)}
    observed = {y: quality.read_observed_release(spark, path[y], y) for y in path}
    stacked = clean.fill_missing(stack_all({y: df for y, (df, _) in observed.items()}))
    plain = clean.fill_missing(stack_all({y: read_release(spark, path[y], y) for y in path}))
    assert sorted(map(repr, stacked.collect())) == sorted(map(repr, plain.collect()))
    got = {(r[TIME], r["tbl"]): tuple(r)[2:] for r in quality.quality_report(spark, observed).collect()}
    assert got == {(2018, "S0101"): (4, 8, 2, 2, 1), (2018, "S0701"): (4, 4, 0, 1, 1), (2018, "other"): (4, 4, 1, 1, 0),
                   (2019, "S0101"): (0, 0, 0, 0, 0), (2019, "S0701"): (0, 0, 0, 0, 0), (2019, "other"): (0, 0, 0, 0, 0)}


def test_counts_do_not_depend_on_what_is_read_after(spark, tmp_path):
    (tmp_path / "2018.csv").write_text(RELEASE)
    df, seen = quality.read_observed_release(spark, str(tmp_path / "2018.csv"), 2018)
    assert df.where("place = '00001'").select("place").count() == 1
    assert seen.get["n_rows"] == 4 and seen.get["S0101_no_number"] == 2
