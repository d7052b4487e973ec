"""Dear rows are made once, cells of the releases are not shuffled, heavy rows are spread over every core."""

import re
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from panelcast.functions.codes import RELEASE_TABLES_NEW, code
from panelcast.operators import aggregate, metrics, quantiles
from panelcast.operators.sizing import spread
from panelcast.plans import report
from workloads import panels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_errors_scores_and_values_are_made_once(spark, tmp_path):
    path = str(tmp_path / "dear")
    spark.range(60).selectExpr("'m' AS metric", "CAST(id AS DOUBLE) AS pred", "CAST(id % 7 AS DOUBLE) AS actual", "0.1D AS alpha").write.parquet(path)
    rows = spark.read.parquet(path)
    for made in (metrics.accuracy(rows), quantiles.conformal_qhat(rows, ["metric"], score="pred"), aggregate.kde(rows, "pred", ["metric"], 0.0, 60.0)):
        assert "dear" not in plan(made) and made.count()


def test_comparing_totals_reads_the_series_once(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame([("a", "Middle", 2020, "1", "2", 5.0), ("b", "Upper", 2020, "1", "2", 7.0), ("b", "Upper", 2021, "1", "2", 8.0)],
                          "model string, quantile string, year int, state string, place string, total double").write.parquet(path)
    table = report.total_comparison(spark.read.parquet(path), [("a", "Middle"), ("b", "Upper")])
    assert plan(table).count("FileScan parquet") == 1
    assert [tuple(r) for r in table.collect()] == [(2020, "1", "2", 5.0, 7.0)]


def test_heavy_rows_get_several_tasks_for_every_core(spark):
    cores, shuffle = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(10), "id", per_core=4).rdd.getNumPartitions() == max(4 * cores, shuffle)


def facts(spark, folder):
    """Items of a crowded and of other suppliers, with nulls and a negative part; one supplier is listed twice, one in two states."""
    day = [datetime(1996, 2, 1), datetime(1999, 5, 1), None]
    items = [(i, 1 if i % 3 else i % 7, i * 37 if i % 11 else -i, i % 7 + 1, float(i % 50) if i % 13 else None, day[i % 3 if i % 5 else 0]) for i in range(400)]
    items += [(900, None, 5, 1, 2.0, day[0]), (901, 2, None, 1, 2.0, day[0])]
    kinds = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(items, kinds).write.parquet(f"{folder}/lineitem.parquet")
    places = [(1, 3), (1, 3), (2, 4), (2, 5), (3, None), (4, 6), (5, 7), (None, 8)]
    spark.createDataFrame(places, "s_suppkey long, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    return items, places


def plain_sums(items):
    cells = defaultdict(list)
    for _, supplier, part, line, quantity, day in items:
        for tbl, (cols, rows) in RELEASE_TABLES_NEW.items():
            for c in cols:
                n = len(rows) - 1
                left = None if part is None else (abs(part * c + line) % n) * (1 if part * c + line >= 0 else -1)
                for row in (1, None if left is None else 2 + left):
                    name = f"{tbl}_C{c:02d}_nullE" if row is None else f"{tbl}_C{c:02d}_{row:03d}E"
                    cells[supplier, day and day.year, name].append(quantity)
    return {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in cells.items()}


def test_full_cells_are_the_sums_of_items(spark, tmp_path):
    items, places = facts(spark, tmp_path)
    sums = plain_sums(items)
    wanted = Counter((year, "null" if n is None else f"{n:02d}", f"{s:010d}", name, v)
                     for (supplier, year, name), v in sums.items() for s, n in places if s is not None and s == supplier)
    assert Counter(tuple(r) for r in panels.full_cells(spark, str(tmp_path)).collect()) == wanted
    wide = panels.full_census(spark, str(tmp_path))
    rows = wide.collect()
    assert len(rows) == len({(r.year, r.state, r.place) for r in rows}) == len({k[:3] for k in wanted})
    found = {(r.year, r.state, r.place, name, r[name]) for r in rows for name in wide.columns[3:] if r[name] is not None}
    assert found == {k for k in wanted if k[3] in wide.columns and k[4] is not None}
    assert code("S0101", 1, 1) in wide.columns


def test_cells_of_the_releases_are_not_shuffled(spark, tmp_path):
    facts(spark, tmp_path)
    for made in (panels.full_sums(spark, str(tmp_path)), panels.full_cells(spark, str(tmp_path)), panels.full_census(spark, str(tmp_path))):
        assert not [e for e in exchanges(made) if re.search(r"tbl#|metric#|row#", e)]
