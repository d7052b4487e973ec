"""Census-shaped panels derived from the test tables.

``census``: suppliers are places, their nations states, and line items people: quantity gives
the age bin, line status the sex, return flag the mobility row and tax the mobility class.
``orders_by_customer``: customers are places and order priorities five age bins; most
customers miss some years.  Fact tables are aggregated before they meet a dimension, so a
customer or supplier holding a large share of all rows is reduced before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.codes import (
    AGE_METRICS, BIRTHS, LAYOUT_CHANGE_YEAR, MIGRATION, POPULATION, RELEASE_TABLES_NEW, WOMEN, code, measures,
)
from panelcast.operators.derive import sum_columns
from panelcast.operators.shape import to_wide
from panelcast.operators.sizing import spread
from panelcast.plans.prepare import MOBILITY_PARTS, to_counts
from panelcast.sources.releases import release_codes

FIRST_YEAR = 1995
LAST_YEAR = 2001
LAYOUT_CHANGE = 1998
MISSING = -888888888.0

S0101 = [code("S0101", c, r) for c in (1, 3, 5) for r in range(1, 20)]
S0701 = [code("S0701", c, r) for c in range(1, 6) for r in (1, 2, 3, 11, 48)]
S1301 = [code("S1301", 1, r) for r in (1, 2, 31, 32)] + [code("S1301", c, r) for c in range(2, 6) for r in (1, 2)]
ALL_CODES = sorted([*S0101, *S0701, *S1301])
PRIORITY_BINS = [code("S0101", 1, r) for r in range(2, 7)]
PRIORITY_GROUPS = {"youth": PRIORITY_BINS[:2], "working": PRIORITY_BINS[2:4], "senior": PRIORITY_BINS[4:]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def padded(col: str, width: int) -> Column:
    return F.format_string(f"%0{width}d", F.col(col).cast("long"))


def quarter_index(ts: str) -> Column:
    return ((F.year(ts) - FIRST_YEAR) * 4 + F.quarter(ts) - 1).cast("int")


SEX = {1: None, 3: "l_linestatus = 'F'", 5: "l_linestatus = 'O'"}
MOVED = {1: None, 2: "l_returnflag = 'A'", 3: "l_returnflag = 'R'"}
TAX = {1: None, 2: "l_tax < 0.02D", 3: "l_tax BETWEEN 0.02D AND 0.03D", 4: "l_tax BETWEEN 0.04D AND 0.05D",
       5: "l_tax >= 0.06D"}
MOTHER = "l_discount >= 0.08D"
SHARE = {3: "l_returnflag = 'A'", 4: "l_returnflag = 'R'", 5: "l_returnflag = 'N'"}


def _count(*conditions: str | None) -> str:
    used = " AND ".join(c for c in conditions if c)
    return f"CAST(count_if({used}) AS DOUBLE)" if used else "CAST(count(1) AS DOUBLE)"


def _measure(name: str) -> str:
    """Aggregate expression of a code."""
    tbl, col, row = name[:5], int(name[7:9]), int(name[10:13])
    if tbl == "S0101":
        return _count(SEX[col], None if row == 1 else f"floor((l_quantity - 1) * 18 / 50) + 2 = {row}")
    if tbl == "S0701":
        if row in (11, 48):
            value = "l_extendedprice" if row == 11 else "l_discount"
            return f"max({value})" if col == 1 else f"max(CASE WHEN {TAX[col]} THEN {value} END)"
        return _count(MOVED[row]) if col == 1 else _percent(_count(MOVED[row], TAX[col]), _count(MOVED[row]))
    if col == 1:
        women = "l_quantity BETWEEN 15 AND 45"
        return {1: _count(women), 2: _count(women, SEX[5]), 31: "max(l_tax)", 32: "sum(0D)"}[row]
    group = (MOTHER, None if row == 1 else SEX[5])
    return _count(*group) if col == 2 else _percent(_count(*group, SHARE[col]), _count(*group))


def _percent(part: str, base: str) -> str:
    return f"CASE WHEN {base} = 0 THEN 0D ELSE {part} * 100 / {base} END"


def census(spark: SparkSession, sf: str, codes: Sequence[str], t: str = "year") -> DataFrame:
    """Wide panel ``(t, state, place, codes...)`` with ``t`` in years or (``period``) quarters."""
    when = (F.year("l_shipdate") if t == "year" else quarter_index("l_shipdate")).cast("int")
    cells = table(spark, sf, "lineitem").groupBy("l_suppkey", when.alias(t)).agg(
        *[F.expr(f"{_measure(c)} AS {c}") for c in codes])
    places = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return cells.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        t, padded("s_nationkey", 2).alias("state"), padded("l_suppkey", 10).alias("place"), *codes)


#: What a line item's part number counts by in the rows of the releases: the least common multiple of their numbers of rows less one.
PART_CYCLE = lcm(*[len(rows) - 1 for _, rows in RELEASE_TABLES_NEW.values()])


def full_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities ``(l_suppkey, year, metric, value)`` over every code of the releases.

    A line item counts in the first row and in one other row of every column group; most other cells are missing.
    Items meet by supplier before they count in their cells, so narrow rows are shuffled and no cell is; those that count in the
    same cells are added up before, so a supplier with a large share of all items has a bounded number of rows.
    """
    groups = ", ".join(f"struct('{tbl}' AS tbl, {c} AS col, {len(rows)} AS n)"
                       for tbl, (cols, rows) in RELEASE_TABLES_NEW.items() for c in cols)
    part = f"CASE WHEN l_partkey >= 0 THEN l_partkey % {PART_CYCLE} ELSE l_partkey END AS l_partkey"
    items = (table(spark, sf, "lineitem")
             .selectExpr("l_suppkey", "CAST(year(l_shipdate) AS INT) AS year", part, "l_linenumber", "CAST(l_quantity AS DOUBLE) AS l_quantity")
             .groupBy("l_suppkey", "year", "l_partkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity")))
    cells = spread(items, "l_suppkey", per_core=4).selectExpr(
        "l_suppkey", "year", "l_quantity", "l_partkey", "l_linenumber", f"inline(array({groups}))").selectExpr(
        "l_suppkey", "year", "l_quantity", "tbl", "col", "explode(array(1, CAST(2 + (l_partkey * col + l_linenumber) % (n - 1) AS INT))) AS row")
    sums = cells.groupBy("l_suppkey", "year", "tbl", "col", "row").agg(F.sum("l_quantity").alias("value"))
    return sums.select("l_suppkey", "year", F.format_string("%s_C%02d_%03dE", "tbl", "col", "row").alias("metric"), "value")


def full_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Long panel over every code of the releases: quantities by supplier, year and measure."""
    places = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return full_sums(spark, sf).join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "year", padded("s_nationkey", 2).alias("state"), padded("l_suppkey", 10).alias("place"), "metric", "value")


def full_census(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel of all codes of the releases, a row for each place and year; a cell without line items is null."""
    codes = release_codes(LAYOUT_CHANGE_YEAR)
    wide = to_wide(full_sums(spark, sf), codes, ("l_suppkey", "year"))
    places = table(spark, sf, "supplier").select("s_suppkey", padded("s_nationkey", 2).alias("state")).distinct()
    return wide.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select("year", "state", padded("l_suppkey", 10).alias("place"), *codes)


def release_text(panel: DataFrame, year: int) -> DataFrame:
    """One release of a wide panel as the text its file holds; missing cells look as releases have them."""
    empty = {"S0101": "'-888888888'", "S0701": "'(X)'", "S1301": "NULL"}
    one = panel.where(F.col("year") == year).drop("year")
    laid = old_layout(one) if year < LAYOUT_CHANGE else one
    return laid.selectExpr("state", "place", *[f"coalesce(CAST({c} AS STRING), {empty[c[:5]]}) AS {c}" for c in measures(laid)])


def age_panel(spark: SparkSession, sf: str, t: str = "year") -> DataFrame:
    """Population and the 18 age bins."""
    return census(spark, sf, [POPULATION, *AGE_METRICS], t)


def components_panel(spark: SparkSession, sf: str, t: str = "year") -> DataFrame:
    """Population, age bins, migration sum, women and births: what the models need before the residual."""
    mobility = [code("S0701", c, 1) for c in range(1, 6)]
    raw = census(spark, sf, [POPULATION, *AGE_METRICS, *mobility, WOMEN, BIRTHS], t)
    return to_counts(raw).select(t, "state", "place", POPULATION, *AGE_METRICS, MIGRATION, WOMEN, BIRTHS)


def old_layout(panel: DataFrame) -> DataFrame:
    """A release in the old layout: groups C01-C03, rows 002-019 in percent of the group's 001, empty cells -888888888."""
    moved = {"C01": "C01", "C03": "C02", "C05": "C03"}
    cols = []
    for c in panel.columns:
        if not c.startswith("S0101"):
            cols.append(c)
            continue
        new = f"S0101_{moved[c[6:9]]}_{c[10:]}"
        if c.endswith("_001E"):
            cols.append(f"{c} AS {new}")
        else:
            pct = f"round(try_divide({c} * 100, {c[:10]}001E), 1)"
            cols.append(f"CASE WHEN {c} = 0 THEN {MISSING!r}D ELSE {pct} END AS {new}")
    return panel.selectExpr(*cols)


def releases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(releases before the layout change, releases since), from table S0101."""
    panel = census(spark, sf, S0101)
    return old_layout(panel.where(F.col("year") < LAYOUT_CHANGE)), panel.where(F.col("year") >= LAYOUT_CHANGE)


def orders_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel of customers by year; a priority a customer did not use that year is null."""
    used = [F.expr(f"sum(CASE WHEN o_orderpriority LIKE '{i + 1}%' THEN 1D END) AS {m}")
            for i, m in enumerate(PRIORITY_BINS)]
    cells = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("int").alias("year")).agg(*used)
    places = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return cells.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        "year", padded("c_nationkey", 2).alias("state"), padded("o_custkey", 10).alias("place"),
        "c_mktsegment", *PRIORITY_BINS)


def customer_panel(spark: SparkSession, sf: str) -> DataFrame:
    return orders_by_customer(spark, sf).drop("c_mktsegment")


def segment_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel of market segments by nation and year, from the customer panel."""
    return (orders_by_customer(spark, sf)
            .groupBy("year", "state", F.col("c_mktsegment").alias("place"))
            .agg(*[F.expr(f"coalesce(sum({m}), 0D) AS {m}") for m in PRIORITY_BINS]))


def supplier_places(spark: SparkSession, sf: str) -> DataFrame:
    """Entity table: keys, name and balance of every supplier."""
    return table(spark, sf, "supplier").select(
        padded("s_nationkey", 2).alias("state"), padded("s_suppkey", 10).alias("place"), "s_name", "s_acctbal",
        "s_nationkey")


def supplier_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster assignment: the nation of every supplier in credit; the others are unclustered."""
    return (supplier_places(spark, sf).where("s_acctbal > 0")
            .select("state", "place", (F.col("s_nationkey") + 1).cast("int").alias("cluster")))


def region_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster assignment: the region of every supplier."""
    regions = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (supplier_places(spark, sf).join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("state", "place", (F.col("n_regionkey") + 1).cast("int").alias("cluster")))
