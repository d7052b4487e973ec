"""The physical plans the design relies on."""

import os
import re

import pytest

from workloads.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LAZY = ["align_pred", "align_vintage", "attach_cluster", "backtest_linear", "cluster_split", "common_schema",
        "codebook_grid", "complete_history", "composition", "ema", "entity_labels", "family_sum", "fit_scaler", "history_vector",
        "lags", "lead_target", "mae", "migration_sum", "predicate_filter", "prepare_panel", "project_linear",
        "quantile_dim", "ratios", "segment_report", "stratified_holdout", "target_features", "totals", "unpivot",
        "vintage_union", "window_samples"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python_rows(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|SinglePartition", text)


@pytest.mark.parametrize("name", ["ema", "history_vector", "window_samples", "backtest_linear", "target_features"])
def test_one_shuffle_by_entity_serves_every_window(spark, name):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, name))
    assert len([e for e in exchanges if "l_suppkey" in e]) == 1
    assert len([e for e in exchanges if "l_suppkey" not in e]) == 1


def test_row_work_shuffles_nothing_but_the_panel(spark):
    for name in ("migration_sum", "family_sum", "ratios", "unpivot"):
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, name))
        assert len(exchanges) == 1 and "l_suppkey" in exchanges[0]


def test_columns_and_filters_reach_the_scan(spark):
    narrow = plan(spark, "unpivot")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", narrow).group(1)
    assert "l_extendedprice" not in schema and "l_tax" not in schema
    filtered = plan(spark, "predicate_filter")
    assert "PushedFilters" in filtered and "o_orderdate" in filtered.split("PushedFilters")[1]
    assert "o_totalprice" not in filtered
