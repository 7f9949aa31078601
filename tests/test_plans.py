"""Physical-plan properties behind the scale claims."""

import re

import pytest

import __spark_entry__ as E
from attrix.plans.catalog import load_all

from .conftest import SF_SMALL

# queries that train, stream or need the larger scale when they are planned
HEAVY = ("job_4", "job_6", "job_7", "st_retrain", "spl_2", "ml_rf_", "ml_holdout", "ml_confusion_totals", "ml_model_selection", "ml_best_params", "ml_store",
         "ml_decision_tree", "ml_random_search", "ml_dense_network", "ml_network", "ml_fold", "ml_logreg", "ml_documents", "ml_training_history")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, (fn, _sql) in load_all().items():
        if name.startswith(HEAVY):
            continue
        out[name] = plan_text(fn(spark, SF_SMALL))
    return out


def test_no_python_in_any_plan(plans):
    bad = [n for n, p in plans.items() if re.search(r"EvalPython|PythonUDF|MapInPandas|FlatMapGroupsInPandas", p)]
    assert not bad


def test_no_single_task_exact_percentile(plans):
    # exact quantiles / modes come from the bracketed two-pass operator
    bad = [n for n, p in plans.items() if re.search(r"\bpercentile\(|\bmedian\(|\bmode\(", p)]
    assert not bad


def test_filter_and_projection_reach_the_scan(spark):
    p = E.queries()["flt_9_outside_range"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(l_extendedprice,2000.0),GreaterThan(l_extendedprice,95000.0))]" in p
    p = plan_text(E.queries()["agg_16_crosstab_lineitem"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_discount:double,l_returnflag:string,l_linestatus:string>" in p
    p = plan_text(E.queries()["src_read_lineitem_projection"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in p


def test_aggregations_are_partial(plans):
    p = plans["agg_10_segment_two_keys"]
    assert "partial_avg" in p or "partial_count" in p


def test_split_moves_keys_only(plans):
    """No exchange of a split carries the table's columns; folds rank by bucket."""
    p = plans["spl_1_stratified_split"]
    for line in re.findall(r"Window \[.*", p):
        assert "weekly_hours" not in line
    p = plans["spl_3_stratified_folds"]
    assert re.search(r"Window \[.*row_number\(\).*\], \[__stratum#\d+, __p#\d+\]", p)
