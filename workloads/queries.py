"""One query per operator family, each over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import (
    AGE_LABELS, AGE_METRICS, BIRTHS, KEYS, MODEL_METRICS, POPULATION, RELEASE_TABLES_NEW, RELEASE_TABLES_OLD, RESIDUAL,
    VINTAGE_RENAMES, WOMEN, code, matching, measures,
)
from panelcast.operators import aggregate, clean, cluster, conformal, derive, features, metrics, project, quantiles
from panelcast.operators import packed, relate, scale, shape, split, state
from panelcast.operators.sizing import cut_lineage, spread
from panelcast.plans import describe, evaluate, report, train
from panelcast.plans.collect import collect_packed, collect_panels, sorted_panel
from panelcast.plans.prepare import MOBILITY_NON_COUNT_ROWS, MOBILITY_PARTS, NON_COUNT_PATTERNS, REDUNDANT_PATTERN
from panelcast.plans.prepare import prepare_packed
from panelcast.plans.prepare import prepare_panel as run_prepare
from panelcast.sources import quality
from panelcast.sources.releases import codebook, read_lookup, read_panel, read_releases, stack_all, write_csv
from panelcast.sources.stages import Stages
from workloads import panels as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEARLY = ("year", *KEYS)
QUARTERLY = ("period", *KEYS)
LAST_QUARTER = 27
BACKTEST_PERIODS = range(8, 28)
SMOOTH = project.LinearScorer([k / 21 for k in (1, 1, 2, 2, 3, 4, 8)], spread=0.1)
STEADY = project.LinearScorer((0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), spread=0.1)
PATHS = {"Lower": 0.4, "Middle": 0.5, "Upper": 0.6}
HOLDOUT_EXCLUDED = ("0000000001", "0000000005")
ALPHAS = (0.05, 0.1, 0.2, 0.45)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(x: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)


def quarterly_model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly modelling measures with the residual, from the second quarter on."""
    panel = spread(P.components_panel(spark, sf, "period"), *KEYS, per_core=4)
    wide = derive.residual_change(panel, t="period").where("period <> 0")
    return clean.fill_missing(wide.select(*QUARTERLY, *MODEL_METRICS), cols=MODEL_METRICS)


def quarterly_series(spark: SparkSession, sf: str, cols=MODEL_METRICS) -> DataFrame:
    return shape.to_long(quarterly_model_panel(spark, sf), QUARTERLY, cols)


def yearly_model_series(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly long panel of population, modelling measures and residual, from the second year on."""
    wide = derive.residual_change(P.components_panel(spark, sf)).where(F.col("year") != P.FIRST_YEAR)
    return shape.to_long(clean.fill_missing(wide), YEARLY)


def backtested(spark: SparkSession, sf: str, scorer=SMOOTH, cols=AGE_METRICS) -> DataFrame:
    return project.backtest(quarterly_series(spark, sf, cols), scorer, BACKTEST_PERIODS, t="period")


def customer_series(spark: SparkSession, sf: str) -> DataFrame:
    return shape.to_long(clean.fill_missing(P.customer_panel(spark, sf)), YEARLY)


def holdout_places(spark: SparkSession, sf: str) -> DataFrame:
    """Codes and names of suppliers with a low balance, from two stacked lookups."""
    places = P.supplier_places(spark, sf).select(F.col("place").alias("FIPS"), F.col("s_name").alias("Name"),
                                                 "s_nationkey", "s_acctbal")
    wanted = places.where("s_acctbal < 2000").select("Name")
    return relate.build_holdout([places.where("s_nationkey < 12"), places.where("s_nationkey >= 12")], wanted,
                                exclude=HOLDOUT_EXCLUDED)


def split_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    listed = holdout_places(spark, sf).select(F.col("FIPS").alias("place"))
    return relate.split_by_list(P.age_panel(spark, sf), listed, ["place"])


# Sources and schema


@query
def codebook_grid(spark, sf):
    grid = codebook(spark, {"S0101": ((1, 3, 5), range(1, 20))})
    seen = shape.to_long(P.census(spark, sf, P.S0101), YEARLY).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grid.join(seen, "metric", "left").select("metric", "tbl", "col", "row", "n", "total")


@query
def typed_reread(spark, sf):
    schema = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                           T.StructField("o_totalprice", T.DoubleType())])
    orders = read_panel(spark, f"{sf}/orders.parquet", schema, fmt="parquet")
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_custkey").alias("last_customer"),
                                               r(money).alias("total"))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, where every executor can read and write."""
    cut_lineage(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def release_file(spark: SparkSession, sf: str, year: int, folder: str) -> str:
    """A release of two measures by customer as CSV, with the cells real releases have where no number is."""
    balance = F.col("c_acctbal").cast("string")
    nation = F.when(F.col("c_nationkey") % 3 == 0, "-").when(F.col("c_nationkey") % 5 == 0, "N").otherwise(
        (F.col("c_nationkey") + year).cast("string"))
    rows = P.table(spark, sf, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("place"),
        F.when(F.col("c_acctbal") < 0, "(X)").otherwise(balance).alias(code("S0101", 1, 1)), nation.alias(code("S0101", 1, 2)))
    write_csv(rows, f"{folder}/{year}.csv")
    return f"{folder}/{year}.csv"


@query
def read_release_files(spark, sf):
    """Releases written as files, read back and stacked; what is no number counts as 0."""
    folder = scratch(spark)
    releases = read_releases(spark, {year: release_file(spark, sf, year, folder) for year in (2016, 2018)})
    cells = shape.to_long(clean.fill_missing(stack_all(releases)), YEARLY)
    return cells.groupBy("year", "metric").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"),
                                               F.min("place").alias("first_place"), F.max("state").alias("last_state"))


@query
def read_lookup_file(spark, sf):
    """Nations written as a pipe-delimited file with carriage returns, read back by position, joined to customers."""
    path = f"{scratch(spark)}/nations.txt"
    line = F.concat_ws("|", F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.col("n_regionkey").cast("string"), F.col("n_name"))
    P.table(spark, sf, "nation").select(line).write.option("lineSep", "\r\n").text(path)
    names = read_lookup(spark, path, ("FIPS", "Name"), sep="|", columns=(0, 2))
    places = P.table(spark, sf, "customer").select(F.lit(2018).alias("year"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state"))
    return relate.decode(places, names, "FIPS", "Name", "state").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def stage_tables(spark, sf):
    """A stage written and read back, then totally ordered."""
    panel = sorted_panel(Stages(spark, scratch(spark)).save(P.segment_panel(spark, sf), "segments"))
    return panel.select(*YEARLY, *[r(c).alias(c) for c in measures(panel)])


@query
def scaler_artefact(spark, sf):
    """A scaler fitted on the later years, kept, loaded and applied to the earlier ones."""
    stages = Stages(spark, scratch(spark))
    cells = yearly_model_series(spark, sf)
    stages.save_stats(scale.fit_scaler(cells.where("year >= 1998")), "later")
    earlier = scale.standardize(cells.where("year < 1998"), stages.load_stats("later"))
    return earlier.groupBy("metric").agg(F.count("value").alias("n"), r(F.sum("value")).alias("total"))


@query
def predicate_filter(spark, sf):
    orders = P.table(spark, sf, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority")
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1999-01-01"))
    inside = orders.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)
                          & F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW"))
    return inside.groupBy(F.year("o_orderdate").cast("int").alias("year"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query
def vintage_union(spark, sf):
    old, new = P.releases(spark, sf)
    stacked = shape.stack_releases([shape.tag(old, layout="old"), shape.tag(new, layout="new")])
    cells = shape.to_long(stacked, ("layout", *YEARLY))
    return cells.groupBy("layout", "year", "metric").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"),
        r(F.sum(F.when(F.col("value") > -1e8, F.col("value")))).alias("total"))


@query
def align_vintage(spark, sf):
    old, new = P.releases(spark, sf)
    panel = shape.stack_releases([shape.align_vintage(old, VINTAGE_RENAMES), new])
    return shape.to_long(panel, YEARLY, matching(measures(panel), ["_002E$"]))


@query
def align_vintage_long(spark, sf):
    old, new = P.releases(spark, sf)
    cells = shape.to_long(old, YEARLY).unionByName(shape.to_long(new, YEARLY))
    aligned = shape.align_vintage_long(cells, VINTAGE_RENAMES, before=P.LAYOUT_CHANGE)
    return aligned.groupBy("year", "metric").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.when(F.col("value") > -1e8, F.col("value")))).alias("total"))


@query
def metric_parse(spark, sf):
    chosen = shape.select_metrics(P.census(spark, sf, P.S0101), include=["^S0101_C0[15]_01"], exclude=["_019E$"])
    return shape.parse_metric(shape.to_long(chosen, YEARLY)).groupBy("tbl", "col", "row").agg(
        F.sum("value").alias("total"))


@query
def drop_families(spark, sf):
    kept = shape.canonical_order(shape.drop_metrics(P.census(spark, sf, P.ALL_CODES), REDUNDANT_PATTERN,
                                                    *NON_COUNT_PATTERNS))
    order = "CASE metric " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(measures(kept))) + " END"
    return shape.to_long(kept, YEARLY).groupBy("metric").agg(r(F.sum("value")).alias("total")).selectExpr(
        "metric", f"{order} AS position", "total")


@query
def common_schema(spark, sf):
    a = P.census(spark, sf, [POPULATION, *AGE_METRICS, code("S1301", 1, 1)])
    b = P.census(spark, sf, [POPULATION, *AGE_METRICS, code("S0701", 1, 1)])
    left, right = shape.intersect_schema(a, b)
    return shape.to_long(left.unionByName(right), YEARLY).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def unpivot(spark, sf):
    return shape.to_long(P.census(spark, sf, [POPULATION, WOMEN, BIRTHS]), YEARLY)


@query
def pivot_wide(spark, sf):
    return shape.to_wide(customer_series(spark, sf), P.PRIORITY_BINS, YEARLY)


@query
def double_unpivot(spark, sf):
    shaped = derive.add_ratios(derive.add_age_groups(P.age_panel(spark, sf)))
    cells = describe.stacked_series(shaped.select(*YEARLY, "youth", "working", "senior", "working_total_ratio",
                                                  "senior_total_ratio"), list(YEARLY))
    return cells.withColumn("ratio", r("ratio"))


@query
def transpose_report(spark, sf):
    grouped = derive.add_age_groups(P.age_panel(spark, sf))
    by_year = grouped.groupBy(F.concat(F.lit("y"), "year").alias("year")).agg(
        *[F.sum(c).alias(c) for c in ("youth", "working", "senior", "total")])
    return shape.transpose(by_year, "year", ["youth", "working", "senior", "total"], to="age_group")


@query
def quantile_dim(spark, sf):
    copies = shape.with_quantile_dim(shape.to_long(P.age_panel(spark, sf), YEARLY), (0.4, 0.5, 0.6))
    widened = copies.withColumn("value", F.col("value") * (F.col("q") + 0.5))
    upper = shape.take_quantile(widened, 0.6).withColumn("path", F.lit("upper"))
    every = widened.drop("q").withColumn("path", F.lit("all"))
    return upper.unionByName(every).groupBy("path", "year", "metric").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))


@query
def label_metrics(spark, sf):
    labelled = shape.label_metrics(shape.to_long(P.age_panel(spark, sf), YEARLY), dict(zip(AGE_METRICS, AGE_LABELS)))
    return labelled.groupBy("year", F.col("metric").alias("label")).agg(F.sum("value").alias("total"))


# Cleaning and derived measures


@query
def fill_missing(spark, sf):
    return clean.fill_missing(P.customer_panel(spark, sf))


@query
def clean_sentinel(spark, sf):
    old, _ = P.releases(spark, sf)
    return shape.to_long(clean.clean_sentinel(old), YEARLY).groupBy("year", "metric").agg(
        r(F.sum("value")).alias("total"), F.min("value").alias("lowest"),
        F.count_if(F.col("value") == 0).alias("n_zero"))


@query
def drop_zero_metrics(spark, sf):
    kept = clean.drop_zero_metrics(P.census(spark, sf, P.S1301))
    return shape.to_long(clean.metric_means(kept), (), None, value="mean").select("metric", r("mean").alias("mean"))


@query
def pct_to_count(spark, sf):
    old, _ = P.releases(spark, sf)
    counts = derive.pct_to_count(clean.clean_sentinel(old), before=P.LAYOUT_CHANGE)
    return shape.to_long(shape.align_vintage(counts, VINTAGE_RENAMES), YEARLY)


@query
def sibling_scale(spark, sf):
    scaled = derive.scale_by_sibling(P.census(spark, sf, P.S0701), "S0701", "C01", MOBILITY_PARTS,
                                     MOBILITY_NON_COUNT_ROWS)
    cols = matching(measures(scaled), ["_C0[2-5]_"], ["_(011|048)E$"])
    return shape.to_long(scaled, YEARLY, cols).withColumn("value", r("value"))


@query
def sibling_product(spark, sf):
    scaled = derive.scale_by_sibling(P.census(spark, sf, P.S1301), "S1301", "C02", ("C05",))
    return shape.to_long(scaled, YEARLY, matching(measures(scaled), ["_C05_"])).withColumn("value", r("value"))


@query
def migration_sum(spark, sf):
    counted = derive.scale_by_sibling(P.census(spark, sf, P.S0701), "S0701", "C01", MOBILITY_PARTS,
                                      MOBILITY_NON_COUNT_ROWS)
    summed = derive.sum_columns(counted, "S0701", MOBILITY_PARTS, "C06", MOBILITY_NON_COUNT_ROWS)
    return shape.to_long(summed, YEARLY, matching(measures(summed), ["_C06_"])).withColumn("value", r("value"))


@query
def family_sum(spark, sf):
    return derive.add_age_groups(P.age_panel(spark, sf)).select(*YEARLY, "youth", "working", "senior", "total")


@query
def ratios(spark, sf):
    shaped = derive.add_ratios(derive.add_age_groups(P.age_panel(spark, sf)))
    return shaped.select(*YEARLY, *[r(c).alias(c) for c in ("working_senior_ratio", "working_total_ratio",
                                                            "senior_total_ratio")])


@query
def growth_rate(spark, sf):
    grown = derive.growth_rate(P.age_panel(spark, sf), POPULATION, 1995, 2001, n=7)
    return grown.withColumn("growth_rate", r("growth_rate"))


@query
def residual_change(spark, sf):
    return derive.residual_change(P.components_panel(spark, sf)).select(*YEARLY, r(RESIDUAL).alias(RESIDUAL))


@query
def clip_floor(spark, sf):
    cells = yearly_model_series(spark, sf)
    floors = scale.fit_scaler(cells).select("metric", r(F.col("mean") / 2).alias("floor"))
    clipped = clean.clip_floor(cells.withColumn("value", F.col("value") - 2), floors)
    return clipped.withColumn("value", r("value"))


# Joins


@query
def holdout_semi(spark, sf):
    return split_panel(spark, sf)[0].select(*YEARLY, POPULATION)


@query
def holdout_anti(spark, sf):
    return split_panel(spark, sf)[1].select(*YEARLY, POPULATION)


@query
def decode_lookup(spark, sf):
    lookup = P.supplier_places(spark, sf).select(F.col("place").alias("FIPS"), F.col("s_name").alias("Name"))
    return relate.decode(P.age_panel(spark, sf).select(*YEARLY, POPULATION), lookup, "FIPS", "Name", "place")


@query
def attach_cluster(spark, sf):
    return relate.attach(P.age_panel(spark, sf).select(*YEARLY, POPULATION), P.supplier_clusters(spark, sf))


@query
def history_counts(spark, sf):
    return relate.history_counts(P.customer_panel(spark, sf))


@query
def complete_history(spark, sf):
    return relate.require_history(clean.fill_missing(P.customer_panel(spark, sf)), 7)


@query
def recent_history(spark, sf):
    return relate.require_history(clean.fill_missing(P.customer_panel(spark, sf)), 5, at_least=True, present_at=2000)


@query
def entity_labels(spark, sf):
    panel = split.cluster_split(P.age_panel(spark, sf), P.supplier_clusters(spark, sf))
    listed = relate.require_history(panel, 7).select(*KEYS).distinct()
    return relate.entity_labels(listed, panel, 2001, ["cluster", "calib"])


@query
def align_pred(spark, sf):
    actual = shape.to_long(P.age_panel(spark, sf), YEARLY)
    before = actual.select(*KEYS, "metric", (F.col("year") + 1).alias("year"), "value")
    return relate.align(before, actual).select(*YEARLY, "metric", "pred", "actual")


# Windows


@query
def lags(spark, sf):
    return features.lag_features(customer_series(spark, sf), 6)


@query
def lags_gap_aware(spark, sf):
    return features.lag_features(customer_series(spark, sf), 6, gap_aware=True)


@query
def lead_target(spark, sf):
    return features.lead_target(customer_series(spark, sf))


@query
def ema(spark, sf):
    cells = features.panel_features(quarterly_series(spark, sf, MODEL_METRICS), t="period")
    return cells.select(*QUARTERLY, "metric", *[r(f"ema_{i}").alias(f"ema_{i}") for i in range(5, 0, -1)])


@query
def history_vector(spark, sf):
    cells = features.history(quarterly_series(spark, sf, MODEL_METRICS), t="period")
    text = F.array_join(F.transform("history", lambda x: F.round(x).cast("long").cast("string")), ",")
    return cells.select(*QUARTERLY, "metric", text.alias("history"))


@query
def window_samples(spark, sf):
    samples = features.window_samples(quarterly_model_panel(spark, sf), MODEL_METRICS, t="period")

    def total(rows: Column) -> Column:
        return F.aggregate(F.flatten(rows), F.lit(0.0), lambda acc, x: acc + x)

    return samples.select(
        *QUARTERLY, F.size("x").alias("steps"), r(total(F.col("x"))).alias("x_total"),
        r(F.col("x")[0][0]).alias("x_first"), r(F.col("x")[6][21]).alias("x_last"),
        r(total(F.array("y"))).alias("y_total"))


@query
def target_features(spark, sf):
    cells = features.panel_features(quarterly_series(spark, sf), t="period")
    table = features.target_features(cells, code("S0101", 1, 10), MODEL_METRICS, t="period")
    return table.selectExpr(*QUARTERLY, *[f"round({c}, 6) + 0D AS {c}" for c in table.columns if c not in QUARTERLY])


# Scaling


@query
def fit_scaler(spark, sf):
    stats = scale.fit_scaler(yearly_model_series(spark, sf))
    return stats.select("metric", *[r(c).alias(c) for c in ("mean", "sd", "zero_value")])


@query
def standardize(spark, sf):
    cells = yearly_model_series(spark, sf)
    return scale.standardize(cells, scale.fit_scaler(cells)).withColumn("value", r("value"))


@query
def unstandardize(spark, sf):
    cells = yearly_model_series(spark, sf)
    stats = scale.fit_scaler(cells)
    lowered = scale.standardize(cells, stats).withColumn("value", F.col("value") - 0.5)
    clipped = clean.clip_floor(lowered, stats.select("metric", F.col("zero_value").alias("floor")))
    return scale.unstandardize(clipped, stats).withColumn("value", r("value"))


@query
def global_scale(spark, sf):
    cells = yearly_model_series(spark, sf)
    sd = scale.fit_global_sd(cells)
    scaled = scale.scale_global(cells.withColumn("scaled", F.col("value")), sd, "scaled")
    back = scale.unscale_global(scaled.withColumn("value", F.col("scaled") / 2), sd)
    return back.groupBy("metric").agg(r(F.sum("scaled")).alias("scaled_total"), r(F.sum("value")).alias("halved_total"))


# Split and clusters


def split_entities(spark, sf):
    """Suppliers by nation as small clusters, embeddings by label as large ones."""
    vectors = P.table(spark, sf, "embeddings").select(
        F.lit("vec").alias("state"), P.padded("vec_id", 10).alias("place"),
        (F.col("label") + 100).cast("int").alias("cluster"))
    return P.supplier_clusters(spark, sf).unionByName(vectors)


@query
def cluster_sizes(spark, sf):
    return split.cluster_sizes(split_entities(spark, sf))


@query
def distinct_sizes(spark, sf):
    return split.distinct_sizes(split.cluster_sizes(split_entities(spark, sf)))


@query
def stratified_holdout(spark, sf):
    return split.stratified_holdout(split_entities(spark, sf))


@query
def cluster_split(spark, sf):
    panel = split.cluster_split(P.age_panel(spark, sf), P.supplier_clusters(spark, sf))
    parts = split.training_rows(panel).withColumn("part", F.lit("train")).unionByName(
        split.calibration_rows(panel).withColumn("part", F.lit("calib")))
    return parts.groupBy("part", "year", "cluster", "cluster_size").agg(
        F.count(F.lit(1)).alias("n"), F.sum(POPULATION).alias("total"))


def quarterly_entity_series(spark, sf):
    return cluster.entity_series(P.census(spark, sf, [POPULATION, WOMEN, BIRTHS], "period"), 28, t="period")


@query
def series_distances(spark, sf):
    series = cut_lineage(quarterly_entity_series(spark, sf))
    first = series.orderBy(F.md5(F.concat_ws("|", *KEYS))).limit(5).collect()
    centres = np.array([row["series"] for row in first], dtype=float)
    return cluster.series_distances(series, centres).withColumn("distance", r("distance"))


@query
def series_distances_yearly(spark, sf):
    """Yearly series to five of them chosen by hash; short enough for SQL to write the recursion out."""
    series = cut_lineage(cluster.entity_series(P.census(spark, sf, [POPULATION, WOMEN, BIRTHS]), 7))
    first = series.orderBy(F.md5(F.concat_ws("|", *KEYS))).limit(5).collect()
    centres = np.array([row["series"] for row in first], dtype=float)
    return cluster.series_distances(series, centres).withColumn("distance", r("distance"))


@query
def cluster_series(spark, sf):
    assigned = cluster.cluster_series(quarterly_entity_series(spark, sf), k=5, max_iter=8)
    return assigned.withColumn("distance", r("distance"))


@query
def cluster_medoids(spark, sf):
    """Clusters around exact medoids over all modelling measures, each scaled by its standard deviation.

    There are 1,000, as in the original analysis, or one for every five entities if these are fewer than 5,000.
    """
    panel = cut_lineage(quarterly_model_panel(spark, sf))
    stats = panel.agg(*[F.stddev_samp(m).alias(m) for m in MODEL_METRICS]).first()
    scaled = panel.select(*QUARTERLY, *[(F.col(m) / F.lit(stats[m] or 1.0)).alias(m) for m in MODEL_METRICS])
    series = cut_lineage(cluster.entity_series(scaled, LAST_QUARTER, MODEL_METRICS, t="period"))
    assigned = cluster.cluster_series(series, k=max(1, min(1000, series.count() // 5)), max_iter=6, around="medoids")
    return assigned.withColumn("distance", r("distance"))


# Aggregates and distributions


@query
def totals(spark, sf):
    return aggregate.with_totals(P.age_panel(spark, sf))


@query
def report_max(spark, sf):
    everyone = aggregate.with_totals(P.age_panel(spark, sf)).where("place = '0'")
    return aggregate.report_max(everyone, [POPULATION, AGE_METRICS[0]])


@query
def age_profile(spark, sf):
    return aggregate.age_profile(aggregate.with_totals(P.age_panel(spark, sf)), "0")


@query
def exact_quantile(spark, sf):
    q = quantiles.exact_quantiles(P.table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.95],
                                  ["l_returnflag", "l_linestatus"])
    return q.withColumn("value", r("value"))


@query
def weighted_quantile(spark, sf):
    return quantiles.weighted_quantiles(P.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity",
                                        [0.1, 0.5, 0.9], ["l_returnflag"])


def customer_growth(spark, sf):
    people = derive.add_age_groups(clean.fill_missing(P.customer_panel(spark, sf)), P.PRIORITY_GROUPS)
    return derive.growth_rate(people, "total", 1995, 2000)


@query
def histogram_density(spark, sf):
    bars = aggregate.histogram_density(customer_growth(spark, sf), "growth_rate", -250.0, 250.0)
    return bars.select("bin", r("bin_start").alias("bin_start"), "n", r("density").alias("density"))


@query
def kde(spark, sf):
    shaped = derive.add_ratios(derive.add_age_groups(P.age_panel(spark, sf)))
    curve = aggregate.kde(shaped, "working_senior_ratio", ["year"], -8.0, 10.0)
    return curve.select("year", "i", r("x").alias("x"), r("density").alias("density"))


# Accuracy and calibration


@query
def mae(spark, sf):
    return metrics.mae(backtested(spark, sf)).withColumn("mae", r("mae"))


@query
def trimmed_mape(spark, sf):
    return metrics.trimmed_mape(backtested(spark, sf)).withColumn("mape", r("mape"))


@query
def regression_metrics(spark, sf):
    scores = metrics.regression_metrics(backtested(spark, sf), by=["metric"], y="actual")
    return scores.select("metric", *[r(c).alias(c) for c in ("rmse", "r2", "mae")])


@query
def pseudo_huber(spark, sf):
    loss = metrics.quantile_loss(backtested(spark, sf), F.lit(0.6), [*KEYS, "period"])
    return loss.select(*QUARTERLY, r("q_loss").alias("q_loss"), r("m_loss").alias("m_loss"))


@query
def ssim_loss(spark, sf):
    loss = metrics.ssim_loss(backtested(spark, sf), [*KEYS, "period"])
    return loss.select(*QUARTERLY, r("s_loss").alias("s_loss"))


@query
def combined_loss(spark, sf):
    loss = metrics.combined_loss(backtested(spark, sf), F.lit(0.4), [*KEYS, "period"])
    return loss.select(*QUARTERLY, r("loss").alias("loss"))


@query
def conformal_qhat(spark, sf):
    errors = backtested(spark, sf).select(
        F.col("metric").alias("target"), F.abs(F.col("pred") - F.col("actual")).alias("score"),
        F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"))
    return quantiles.conformal_qhat(errors).withColumn("qhat", r("qhat"))


def quantile_preds(spark, sf, levels=(0.05, 0.1, 0.2, 0.45, 0.5, 0.55, 0.8, 0.9, 0.95)):
    """Back-tested predictions widened into quantiles."""
    wide = shape.with_quantile_dim(backtested(spark, sf, cols=MODEL_METRICS), levels)
    return wide.select(*KEYS, "period", F.col("metric").alias("target"), "q",
                       (F.col("pred") * (1 + 0.4 * (F.col("q") - 0.5))).alias("pred"), F.col("actual").alias("y"))


@query
def cqr_calibrate(spark, sf):
    return conformal.cqr_calibrate(quantile_preds(spark, sf), [*KEYS, "period"]).withColumn("qhat", r("qhat"))


@query
def cqr_adjust(spark, sf):
    preds = quantile_preds(spark, sf)
    qhat = conformal.cqr_calibrate(preds, [*KEYS, "period"])
    moved = conformal.cqr_adjust(preds, qhat).withColumnsRenamed({"target": "metric", "pred": "value"})
    clipped = clean.clip_floor(moved, 0.0)
    return clipped.groupBy("metric", "q", "period").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))


# Projection and reports


@query
def project_linear(spark, sf):
    cells = quarterly_series(spark, sf, MODEL_METRICS)
    paths = project.project_linear(cells, SMOOTH, LAST_QUARTER, 39, list(PATHS.values()), t="period")
    return paths.withColumn("value", r("value"))


def window_scorer():
    """SMOOTH as a function of whole windows."""
    weights, spread = np.array(SMOOTH.weights), SMOOTH.spread

    def scorer(windows: np.ndarray, q: float) -> np.ndarray:
        return np.einsum("w,nwm->nm", weights, windows) * (1 + spread * (q - 0.5))

    return scorer


@query
def score_sequences(spark, sf):
    samples = features.window_samples(quarterly_model_panel(spark, sf), MODEL_METRICS, t="period")
    scored = project.score_sequences(samples, window_scorer(), MODEL_METRICS, floor=0.0, t="period")
    return scored.select(*QUARTERLY, F.col("target").alias("metric"), r("pred").alias("pred"), r("y").alias("actual"))


@query
def project_sequences(spark, sf):
    windows = features.latest_window(quarterly_model_panel(spark, sf), MODEL_METRICS, LAST_QUARTER, t="period")
    paths = project.project_sequences(windows, window_scorer(), MODEL_METRICS, LAST_QUARTER, 39, list(PATHS.values()), t="period")
    return paths.withColumn("value", r("value"))


@query
def backtest_linear(spark, sf):
    cells = backtested(spark, sf, cols=MODEL_METRICS)
    return cells.select(*QUARTERLY, "metric", r("pred").alias("pred"), r("actual").alias("actual"))


@query
def evaluation_table(spark, sf):
    models = {name: backtested(spark, sf, scorer).withColumnRenamed("period", "year")
              for name, scorer in (("smooth", SMOOTH), ("steady", STEADY))}
    return evaluate.evaluation_table(models, digits=6)


def projected_series(spark, sf):
    """Report series of two scorers and three quantile paths: the observed quarters, then 39 projected ones."""
    cells = quarterly_series(spark, sf, AGE_METRICS).withColumnRenamed("period", "year")
    paths = [shape.tag(project.project_linear(cells, scorer, LAST_QUARTER, 39, list(PATHS.values())), model=model)
             for model, scorer in (("smooth", SMOOTH), ("steady", STEADY))]
    whole = report.with_history(paths[0].unionByName(paths[1]), cells, ("smooth", "steady"), list(PATHS.values()))
    return report.projection_series(whole, {q: name for name, q in PATHS.items()})


@query
def projection_report(spark, sf):
    rows = report.tagged_series(projected_series(spark, sf))
    return rows.withColumn("working_senior_ratio", r("working_senior_ratio"))


@query
def compare_projections(spark, sf):
    columns = [(model, quantile) for model in ("smooth", "steady") for quantile in PATHS]
    table = report.total_comparison(projected_series(spark, sf), columns)
    return table.select(*YEARLY, *[r(c).alias(c) for c in table.columns if c not in YEARLY])


@query
def ratio_distribution(spark, sf):
    curve = report.ratio_distribution(projected_series(spark, sf), [LAST_QUARTER, 28, 66], last_observed=LAST_QUARTER, model="smooth")
    return curve.select("type", "i", r("x").alias("x"), r("density").alias("density"))


def described(spark, sf):
    held, training = split_panel(spark, sf)
    return describe.descriptive_report(training, held, P.FIRST_YEAR, 2000, 7)


@query
def growth_density(spark, sf):
    curve = described(spark, sf).growth_density()
    return curve.select("kind", "i", r("x").alias("x"), r("density").alias("density"))


@query
def composition(spark, sf):
    report_of = described(spark, sf)
    return report_of.composition().withColumn("ratio", r("ratio"))


@query
def descriptive_report(spark, sf):
    return described(spark, sf).panel.select(*YEARLY, POPULATION, "youth", "working", "senior", r("working_senior_ratio").alias(
        "working_senior_ratio"), r("working_total_ratio").alias("working_total_ratio"), r("senior_total_ratio").alias(
        "senior_total_ratio"))


@query
def segment_report(spark, sf):
    panel = aggregate.with_totals(P.segment_panel(spark, sf))
    shaped = derive.add_ratios(derive.add_age_groups(panel, P.PRIORITY_GROUPS))
    return shaped.select(*YEARLY, "total", "youth", "working", "senior", r("working_senior_ratio").alias(
        "working_senior_ratio"), r("working_total_ratio").alias("working_total_ratio"), r("senior_total_ratio").alias(
        "senior_total_ratio"))


@query
def prepare_panel(spark, sf):
    prepared = run_prepare(P.census(spark, sf, P.ALL_CODES), first=P.FIRST_YEAR)
    return shape.to_long(prepared, YEARLY).groupBy("year", "metric").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))


@query
def collect_stage(spark, sf):
    old, new = (cut_lineage(x) for x in P.releases(spark, sf))
    by_year = {y: (old if y < P.LAYOUT_CHANGE else new).where(F.col("year") == y)
               for y in range(P.FIRST_YEAR, P.LAST_YEAR + 1)}
    names = holdout_places(spark, sf)
    listed = P.supplier_places(spark, sf).join(names, F.col("place") == F.col("FIPS")).select(*KEYS)
    training, held = collect_panels(by_year, listed, names, layout_change=P.LAYOUT_CHANGE)
    both = shape.stack_releases([shape.tag(training, panel="training"), shape.tag(held, panel="held")])
    return shape.to_long(both, ("panel", *YEARLY)).groupBy("panel", "year", "metric").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"), F.max("place").alias("last_place"))


# Forests (no SQL counterpart)


def forest_split(spark, sf):
    panel = quarterly_model_panel(spark, sf)
    return cut_lineage(split.cluster_split(panel, P.region_clusters(spark, sf)))


def forest_samples(spark, sf) -> tuple[DataFrame, DataFrame]:
    panel = forest_split(spark, sf)
    return tuple(features.window_samples(part, MODEL_METRICS, t="period") for part in (split.training_rows(panel), split.calibration_rows(panel)))


@query
def quantile_forest(spark, sf):
    trained = train.train_forests(*forest_samples(spark, sf), MODEL_METRICS, t="period")
    return trained.preds.select("target", *QUARTERLY, "q", r("pred").alias("pred"), "y")


@query
def project_forest(spark, sf):
    panel = forest_split(spark, sf)
    _, paths = train.train_and_project(
        split.training_rows(panel), split.calibration_rows(panel), panel, MODEL_METRICS, LAST_QUARTER, 39,
        list(PATHS.values()), list(range(7, 27)), levels=(0.4, 0.5, 0.6), t="period")
    return paths.withColumn("value", r("value"))


def backtested_forest(spark, sf):
    """Medians on calibration samples by forests that were fitted, saved and loaded again."""
    training, held = forest_samples(spark, sf)
    stages = Stages(spark, scratch(spark))
    stages.save_model("all", train.fit_forests(training, MODEL_METRICS, t="period"))
    return project.backtest_forest(spread(held, *QUARTERLY), stages.load_model("all"), t="period")


@query
def backtest_forest(spark, sf):
    return backtested_forest(spark, sf).select(*QUARTERLY, "metric", r("pred").alias("pred"), r("actual").alias("actual"))


@query
def evaluation_forest(spark, sf):
    """The accuracy table of the age bins: forests beside a linear scorer, on the same rows."""
    held = split.calibration_rows(forest_split(spark, sf))
    forests = backtested_forest(spark, sf).where(F.col("metric").isin(*AGE_METRICS))
    steady = project.backtest(shape.to_long(held, QUARTERLY, AGE_METRICS), STEADY, BACKTEST_PERIODS, t="period")
    models = {name: rows.withColumnRenamed("period", "year") for name, rows in (("forest", forests), ("steady", steady))}
    return evaluate.evaluation_table(models, digits=6)


# Full width, and one release at a time


def by_measure(p: packed.Packed) -> DataFrame:
    return packed.to_long(p).groupBy("year", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != 0).alias("n_filled"), r(F.sum("value")).alias("total"))


def full_releases(spark: SparkSession, sf: str):
    """Files of all years at full width, in the layout of their time, read with their cells counted."""
    folder, panel = scratch(spark), cut_lineage(P.full_census(spark, sf))
    out = {}
    for year in range(P.FIRST_YEAR, P.LAST_YEAR + 1):
        write_csv(P.release_text(panel, year), f"{folder}/{year}.csv")
        out[year] = quality.read_observed_release(spark, f"{folder}/{year}.csv", year)
    return out


@query
def codebook_layouts(spark, sf):
    """All codes of both layouts with the cells the releases hold."""
    grids = [codebook(spark, t).withColumn("layout", F.lit(n)) for n, t in (("old", RELEASE_TABLES_OLD), ("new", RELEASE_TABLES_NEW))]
    cells = P.full_cells(spark, sf)
    later = cells.where(F.col("year") >= P.LAYOUT_CHANGE).withColumn("layout", F.lit("new"))
    moved = {"C03": "C02", "C05": "C03"}
    earlier = shape.align_vintage_long(cells.where(F.col("year") < P.LAYOUT_CHANGE), {"S0101": moved}, before=P.LAYOUT_CHANGE)
    seen = later.unionByName(earlier.withColumn("layout", F.lit("old"))).groupBy("layout", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return shape.stack_releases(grids).join(seen, ["layout", "metric"], "left").select("layout", "metric", "tbl", "col", "row", "n", "total")


@query
def prepare_full_width(spark, sf):
    """All 482 measures from raw cells to the model-ready panel, in one array."""
    return by_measure(prepare_packed(packed.pack(P.full_census(spark, sf)), first=P.FIRST_YEAR))


@query
def collect_full_width(spark, sf):
    """Release files of both layouts at full width, read, cleaned, stacked and prepared."""
    releases = {y: df for y, (df, _) in full_releases(spark, sf).items()}
    return by_measure(prepare_packed(collect_packed(releases, P.LAYOUT_CHANGE), first=P.FIRST_YEAR))


@query
def release_quality(spark, sf):
    """Empty cells, cells that are no number and sentinels, counted by the job that collects the releases."""
    observed = full_releases(spark, sf)
    collect_packed({y: df for y, (df, _) in observed.items()}, P.LAYOUT_CHANGE)
    return quality.quality_report(spark, observed)


@query
def feature_state(spark, sf):
    """Lags and EMA of the last three quarters, each from the state the quarter before left."""
    cells = quarterly_series(spark, sf, MODEL_METRICS)
    now = cut_lineage(state.build_state(cells.where(f"period < {LAST_QUARTER - 2}"), t="period"))
    out = []
    for period in range(LAST_QUARTER - 2, LAST_QUARTER + 1):
        release = cells.where(F.col("period") == period)
        out.append(state.release_features(now, release, t="period"))
        now = cut_lineage(state.advance(now, release, t="period"))
    return shape.stack_releases(out).select(
        *QUARTERLY, "metric", r("value").alias("value"), *[r(f"lag_{i}").alias(f"lag_{i}") for i in range(1, 7)],
        *[r(f"ema_{i}").alias(f"ema_{i}") for i in range(5, 0, -1)])


@query
def scaler_merge(spark, sf):
    """Moments kept by year, the last year's added as a release, and the scaler and global sd of them all."""
    stages = Stages(spark, scratch(spark))
    cells = yearly_model_series(spark, sf)
    old, last = (cells.where(f"year {c} {P.LAST_YEAR}") for c in ("<", "="))
    by = ("year", "metric")
    kept = stages.save(scale.fit_moments(old, by), "moments").unionByName(stages.save(scale.fit_moments(last, by), "release"))
    stats = scale.scaler_from_moments(scale.merge_moments(kept))
    return stats.join(scale.global_sd_from_moments(kept)).select("metric", *[r(c).alias(c) for c in ("mean", "sd", "zero_value", "sd_all")])


@query
def replace_release(spark, sf):
    """A corrected year put in place of the old one in a bucketed stage, and lags over the stage."""
    panel = clean.fill_missing(P.customer_panel(spark, sf))
    stages = Stages(spark, scratch(spark))
    stages.save_bucketed(panel, "customers", 8)
    corrected = panel.where("year = 1999").selectExpr(*YEARLY, *[f"{c} + 1 AS {c}" for c in P.PRIORITY_BINS])
    stage = stages.replace_partitions(corrected, "customers")
    return features.lag_features(stage, 2, P.PRIORITY_BINS[0], KEYS).select(*YEARLY, *P.PRIORITY_BINS, "lag_1", "lag_2")
