import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions.codes import AGE_GROUPS, AGE_METRICS, RELEASE_TABLES_NEW, code, matching
from panelcast.functions.numeric import ratio
from panelcast.operators import clean, derive, shape
from panelcast.plans.collect import collect_panels
from panelcast.plans.prepare import prepare_panel


def panel(spark, rows, cols):
    return spark.createDataFrame(rows, "year int, state string, place string, " + ", ".join(f"{c} double" for c in cols))


def test_sentinel_and_fill(spark, rows):
    df = panel(spark, [(2010, "-111111111", "1", -111111111.0), (2010, "06", "2", -111111110.0),
                       (2010, "06", "3", -888888888.0), (2010, "06", "4", None), (2010, "06", "5", math.nan),
                       (2010, "06", "6", math.inf)], ["m"])
    out = dict(rows(clean.clean_sentinel(clean.fill_missing(df)), "place", "m"))
    assert out == {"1": 0.0, "2": -111111110.0, "3": 0.0, "4": 0.0, "5": 0.0, "6": math.inf}
    assert clean.clean_sentinel(df).where("place = '1'").first()["state"] == "-111111111"


def test_half_even_counts(spark, rows):
    base, pct = code("S0101", 1, 1), code("S0101", 1, 2)
    df = panel(spark, [(2010, "06", str(i), 100.0, v) for i, v in enumerate([0.5, 1.5, 2.5, -0.5])]
               + [(2018, "06", "9", 100.0, 0.5)], [base, pct])
    out = dict(rows(derive.pct_to_count(df), "place", pct))
    assert out == {"0": 0.0, "1": 2.0, "2": 2.0, "3": 0.0, "9": 0.5}


def test_small_total_with_sentinel_percentage(spark):
    base, pct = code("S0101", 1, 1), code("S0101", 1, 2)
    old = spark.createDataFrame([(2010, "06", "1", 1.0, -888888888.0)],
                                f"year int, state string, place string, {base} double, {pct} double")
    new = spark.createDataFrame([(2018, "06", "1", 1.0, 1.0)], old.schema)
    clean_first, _ = collect_panels({2010: old, 2018: new})
    assert clean_first.where("year = 2010").first()[pct] == 0.0
    legacy, _ = collect_panels({2010: old, 2018: new}, legacy_order=True)
    assert legacy.where("year = 2010").first()[pct] == -8888889.0


def test_align_vintage_is_simultaneous(spark):
    df = panel(spark, [(2010, "06", "1", 1.0, 2.0, 3.0)], [code("S0101", c, 1) for c in (1, 2, 3)])
    renames = {"S0101": {"C02": "C03", "C03": "C05"}}
    out = shape.align_vintage(df, renames).first()
    assert (out[code("S0101", 3, 1)], out[code("S0101", 5, 1)]) == (2.0, 3.0)
    cells = shape.align_vintage_long(shape.to_long(df), renames, before=2017)
    assert {r["metric"]: r["value"] for r in cells.collect()} == {
        code("S0101", 1, 1): 1.0, code("S0101", 3, 1): 2.0, code("S0101", 5, 1): 3.0}


def test_ratio_by_zero(spark):
    got = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (-5.0, 0.0), (6.0, 3.0)], "a double, b double").select(
        ratio(F.col("a"), F.col("b"), 10.0).alias("x")).collect()
    assert [r["x"] for r in got] == [math.inf, 0.0, -math.inf, 20.0]


def test_age_groups_cover_all_bins():
    assert sorted(c for cols in AGE_GROUPS.values() for c in cols) == sorted(AGE_METRICS)
    assert sum(len(cols) * len(rows) for cols, rows in RELEASE_TABLES_NEW.values()) == 482


def test_long_wide_round_trip(spark, rows):
    df = panel(spark, [(y, "06", p, float(y), float(y * 2)) for y in (2010, 2011) for p in "ab"], ["m1", "m2"])
    back = shape.to_wide(shape.to_long(df), ["m1", "m2"])
    assert rows(back, *df.columns) == rows(df, *df.columns)


def test_total_order_of_columns_and_drops(spark):
    df = panel(spark, [(2010, "06", "1", 1.0, 0.0, 2.0, 3.0)],
               ["dn", code("S1301", 1, 1), code("S0101", 1, 2), code("S0101", 1, 1)])
    assert shape.canonical_order(df).columns[3:] == [code("S0101", 1, 1), code("S0101", 1, 2), code("S1301", 1, 1), "dn"]
    assert clean.zero_metrics(df) == [code("S1301", 1, 1)]
    assert matching(df.columns, ["^S0101"], ["_002E"]) == [code("S0101", 1, 1)]


def test_clip_floor_leaves_residual(spark, rows):
    df = spark.createDataFrame([("a", -1.0), ("dn", -1.0), ("b", 5.0)], "metric string, value double")
    assert rows(clean.clip_floor(df), "metric", "value") == [("a", 0.0), ("b", 5.0), ("dn", -1.0)]
    floors = spark.createDataFrame([("a", -0.5), ("b", None)], "metric string, floor double")
    assert rows(clean.clip_floor(df, floors), "metric", "value") == [("a", -0.5), ("b", 5.0), ("dn", -1.0)]


def test_growth_of_complete_entities(spark, rows):
    df = panel(spark, [(2010, "06", "a", 10.0), (2021, "06", "a", 15.0), (2021, "06", "b", 3.0)], ["p"])
    assert rows(derive.growth_rate(df, "p", 2010, 2021, n=2), "place", "growth_rate") == [("a", 50.0)]


def test_late_entry_and_residual(spark, rows):
    names = [code("S0101", 1, 1), *[code("S0701", c, 1) for c in range(1, 6)],
             *[code("S1301", c, 1) for c in range(1, 6)]]

    def row(year, place, pop):
        return (year, "06", place, pop, 200.0, 10.0, 5.0, 0.0, 0.0, 50.0, 20.0, 1.0, 1.0, 50.0)

    df = panel(spark, [row(2010, "a", 100.0), row(2011, "a", 160.0), row(2013, "b", 70.0), row(2014, "b", 70.0)], names)
    out = prepare_panel(df, first=2010)
    got = {(r["year"], r["place"]): (r["S0701_C06_001E"], r["S1301_C05_001E"], r["dn"]) for r in out.collect()}
    assert got == {(2011, "a"): (30.0, 10.0, 60.0 - 30.0 - 20.0), (2013, "b"): (30.0, 10.0, 0.0),
                   (2014, "b"): (30.0, 10.0, -50.0)}
    assert code("S1301", 3, 1) not in out.columns


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_partition_count_does_not_matter(spark, rows, partitions):
    df = panel(spark, [(y, "06", p, float(i * y)) for y in range(2010, 2014) for i, p in enumerate("abc")],
               [code("S0101", 1, 1)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = derive.residual_change(df, parts=())
        assert rows(out.where("year = 2013"), "place", "dn") == [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
