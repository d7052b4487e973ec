import math
import random

import pytest
from pyspark.sql import functions as F

from panelcast.functions.codes import KEYS, RELEASE_TABLES_NEW, TIME, VINTAGE_RENAMES, code, measures
from panelcast.operators import clean, derive, features, packed, scale, shape, state
from panelcast.plans.prepare import prepare_packed, prepare_panel
from panelcast.sources.releases import panel_schema, release_codes

YEARLY = (TIME, *KEYS)


def release_rows(names, years=(2017, 2018, 2019), places=4, seed=3, gaps=True):
    """Rows of the full width with nulls, NaN and sentinels; the last place misses a year."""
    rng = random.Random(seed)
    out = []
    for y in years:
        for i in range(places):
            if gaps and i == places - 1 and y == years[1]:
                continue
            cells = [rng.choice([None, float("nan"), -888888888.0, 0.0, *[round(rng.uniform(0, 100), 1)] * 6]) for _ in names]
            out.append((y, "06", f"{i:05d}", *cells))
    return out


def same(a, b):
    """Equal rows, NaN and null each equal to itself."""
    return [tuple(map(repr, r)) for r in a] == [tuple(map(repr, r)) for r in b]


def ordered(df):
    return df.orderBy(*YEARLY).collect()


@pytest.fixture(scope="module")
def full(spark):
    names = release_codes(2019)
    return spark.createDataFrame(release_rows(names), panel_schema(names)).cache()


def test_full_width_prepares_as_the_wide_panel_does(full):
    wide = prepare_panel(clean.clean_sentinel(clean.fill_missing(full)), first=2017)
    p = prepare_packed(packed.clean_sentinel(packed.fill_missing(packed.pack(full))), first=2017)
    assert len(measures(full)) == 482 and list(p.names) == measures(wide)
    assert same(ordered(packed.unpack(p)), ordered(wide))


def test_unfilled_cells_prepare_alike_too(full):
    assert same(ordered(packed.unpack(prepare_packed(packed.pack(full), first=2017))), ordered(prepare_panel(full, first=2017)))


def test_long_form(full):
    wide = shape.to_long(full).orderBy(*YEARLY, "metric").collect()
    assert same(packed.to_long(packed.pack(full)).orderBy(*YEARLY, "metric").select(*YEARLY, "metric", "value").collect(), wide)


def test_old_layout(spark):
    names = release_codes(2010)
    df = spark.createDataFrame(release_rows(names, (2010, 2011)), panel_schema(names))
    counts = derive.pct_to_count(clean.clean_sentinel(clean.fill_missing(df)), before=2011)
    wide = shape.align_vintage(counts, VINTAGE_RENAMES)
    p = packed.pct_to_count(packed.clean_sentinel(packed.fill_missing(packed.pack(df))), before=2011)
    p = packed.align_vintage(p, VINTAGE_RENAMES)
    assert same(ordered(packed.unpack(p).select(*wide.columns)), ordered(wide))


def test_stack_take_and_drop(spark):
    a = packed.pack(spark.createDataFrame([(2010, "06", "1", 1.0, 2.0)], panel_schema(["S0101_C01_001E", "b"])))
    b = packed.pack(spark.createDataFrame([(2011, "06", "1", 3.0, 4.0)], panel_schema(["c", "S0101_C01_001E"])))
    both = packed.stack([a, b])
    assert both.names == ("S0101_C01_001E", "b", "c")
    assert [r["v"] for r in ordered(both.df)] == [[1.0, 2.0, None], [4.0, None, 3.0]]
    assert packed.drop(both, "^b$").names == ("S0101_C01_001E", "c")
    assert [r["v"] for r in ordered(packed.take(both, ["c", "nowhere"]).df)] == [[None, None], [3.0, None]]
    assert packed.drop_zero_metrics(packed.fill_missing(packed.pack(spark.createDataFrame(
        [(2010, "06", "1", 0.0, 2.0), (2011, "06", "1", None, 1.0)], panel_schema(["x", "y"]))))).names == ("y",)


def test_no_rows_and_no_measures(spark, full):
    empty = packed.pack(full.where("1 = 0"))
    assert packed.unpack(prepare_packed(empty, first=2017)).count() == 0
    bare = packed.pack(full.select(*YEARLY))
    assert bare.names == () and packed.fill_missing(packed.drop(bare, "x")).df.count() == full.count()


def test_a_missing_base_is_an_error(spark):
    p = packed.pack(spark.createDataFrame([(2010, "06", "1", 1.0)], panel_schema([code("S0701", 2, 1)])))
    with pytest.raises(ValueError):
        packed.scale_by_sibling(p, "S0701", "C01", ("C02",))


def test_packed_plans_stay_short(full):
    """482 measures take no more plan nodes than two do."""
    def nodes(p):
        return p.df._jdf.queryExecution().optimizedPlan().toString().count("\n")

    few = [code("S0701", c, 1) for c in range(1, 6)] + [code(t, c, 1) for t, cs in (("S0101", (1,)), ("S1301", (1, 2, 5))) for c in cs]
    assert nodes(prepare_packed(packed.pack(full), first=2017)) == nodes(prepare_packed(packed.pack(full.select(*YEARLY, *few)), first=2017))
    assert sum(len(c) * len(list(r)) for c, r in RELEASE_TABLES_NEW.values()) == 482


# Feature state


def series(spark, gaps=True, seed=5):
    rng = random.Random(seed)
    rows = [(y, "06", f"{i}", m, rng.choice([None, rng.uniform(-5, 100)]) if i == 1 else rng.uniform(-5, 100))
            for y in range(2000, 2012) for i in range(5) for m in ("a", "b") if not (gaps and (i * 7 + y) % 5 == 0)]
    rows += [(2010, "06", "late", "a", 1.0), (2011, "06", "late", "a", 2.0), (2003, "06", "gone", "a", 9.0)]
    return spark.createDataFrame(rows, "year int, state string, place string, metric string, value double")


def test_state_gives_the_features_of_a_full_run(spark):
    df = series(spark)
    now = state.build_state(df.where("year < 2009"))
    wanted = features.ema_features(features.lag_features(df), window=7)
    columns = [*YEARLY, "metric", "value", *[f"lag_{i}" for i in range(1, 7)], *[f"ema_{i}" for i in range(1, 6)]]
    for year in (2009, 2010, 2011):
        release = df.where(F.col("year") == year)
        got = state.release_features(now, release).select(*columns).orderBy(*YEARLY, "metric").collect()
        assert same(got, wanted.where(F.col("year") == year).select(*columns).orderBy(*YEARLY, "metric").collect())
        now = state.advance(now, release)
    assert same(now.orderBy(*KEYS, "metric").collect(), state.build_state(df).orderBy(*KEYS, "metric").collect())


def test_state_histories(spark):
    df = series(spark).where("value IS NOT NULL")
    got = state.release_features(state.build_state(df.where("year < 2011")), df.where("year = 2011"))
    wanted = features.history(df).where("year = 2011")
    assert same(got.select(*YEARLY, "metric", "history").orderBy(*YEARLY, "metric").collect(),
                wanted.select(*YEARLY, "metric", "history").orderBy(*YEARLY, "metric").collect())


def test_an_earlier_release_is_refused(spark):
    df = series(spark, gaps=False)
    now = state.build_state(df)
    with pytest.raises(Exception, match="not later than the state"):
        state.advance(now, df.where("year = 2011")).collect()
    with pytest.raises(Exception, match="not later than the state"):
        state.release_features(now, df.where("year = 2005")).collect()


def test_empty_states_and_releases(spark):
    df = series(spark, gaps=False)
    none = state.build_state(df.where("1 = 0"))
    first = state.advance(none, df.where("year = 2000"))
    assert sorted(tuple(r["times"]) for r in first.collect()) == [(2000,)] * 10
    assert same(state.advance(first, df.where("1 = 0")).orderBy(*KEYS, "metric").collect(), first.orderBy(*KEYS, "metric").collect())
    assert state.release_features(first, df.where("1 = 0")).count() == 0


def test_state_completes_window_samples(spark):
    df = series(spark).where("value IS NOT NULL AND place <> 'late'")
    wide = shape.to_wide(df, ["a", "b"]).where("a IS NOT NULL AND b IS NOT NULL")
    wanted = features.window_samples(wide, ["a", "b"], lookback=2)
    p = packed.pack(wide)
    now, got = state.build_state(p.df.where("year < 2006"), 3, "v", KEYS), []
    for year in range(2006, 2012):
        release = p.df.where(F.col("year") == year)
        got += state.release_samples(now, release, lookback=2).select(*YEARLY, "x", "y").collect()
        now = state.advance(now, release, 3, "v", KEYS)
    expected = wanted.where("year >= 2005").select(*YEARLY, "x", "y").collect()
    assert expected and sorted(map(repr, got)) == sorted(map(repr, expected))


# Moments


@pytest.mark.parametrize("center, spread, close", [(0.0, 1.0, 1e-12), (1e9, 1e8, 1e-12), (1e9, 40.0, 1e-8)])
def test_moments_by_release_equal_a_full_fit(spark, center, spread, close):
    """The spread is as exact as the mean: where it is tiny beside the mean, both ways lose the same digits."""
    rng = random.Random(11)
    rows = [(2000 + i % 9, m, center + rng.gauss(0, 1) * s * spread) for i in range(900) for m, s in (("a", 1.0), ("b", 3.0))]
    rows += [(2000, "one", 5.0), (2001, "none", None), (2002, "none", None), (2003, "flat", 2.0), (2004, "flat", 2.0)]
    df = spark.createDataFrame(rows, "year int, metric string, value double")
    by_year = scale.fit_moments(df, ("year", "metric"))
    got = {r["metric"]: r for r in scale.scaler_from_moments(scale.merge_moments(by_year)).collect()}
    for w in scale.fit_scaler(df).collect():
        for c in ("mean", "sd", "zero_value"):
            g = got[w["metric"]][c]
            assert (g is None) == (w[c] is None), (w["metric"], c)
            if g is not None:
                assert math.isclose(g, w[c], rel_tol=close, abs_tol=1e-12)
    want = scale.fit_global_sd(df).first()["sd_all"]
    assert math.isclose(scale.global_sd_from_moments(by_year).first()["sd_all"], want, rel_tol=close)
    assert scale.global_sd_from_moments(by_year.where("1 = 0")).first()["sd_all"] is None
