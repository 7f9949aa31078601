"""Column-wise quartiles and fences (AGG-21, AGG-22) against numpy, and their plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.operators.fences import fenced_quartiles


def brute(values, factor=1.5):
    v = np.array([x for x in values if x is not None and x == x], dtype=float)
    q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    inside = v[(v >= low) & (v <= high)]
    return len(v), q1, median, q3, low, high, len(v) - len(inside), inside.min(), inside.max()


def rows_of(df, *keys):
    cols = ["n", "q1", "median", "q3", "lower_bound", "upper_bound", "n_outliers", "lower_whisker", "upper_whisker"]
    return {tuple(r[k] for k in keys): tuple(r[c] for c in cols) for r in df.collect()}


def check(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_columns_against_numpy(spark, accuracy):
    """Small and sketched columns: heavy tails, few distinct values, NULL, NaN, nothing at all."""
    rng = np.random.default_rng(3)
    n = 4000
    rows = [(float(a), float(b), None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(c), None)
            for i, (a, b, c) in enumerate(zip(rng.standard_cauchy(n), rng.integers(0, 4, n), rng.normal(size=n), strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, nothing double")
    got = rows_of(fenced_quartiles(df, ["a", "b", "c", "nothing", "absent"], accuracy=accuracy), "column")
    check(got, {(x,): brute([r[i] for r in rows]) for i, x in enumerate("abc")})


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_groups_against_numpy(spark, accuracy):
    """A group of most rows, a group of one row and the NULL group."""
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None, float(x)) for i, x in enumerate(rng.lognormal(sigma=2, size=3000))] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = rows_of(fenced_quartiles(df, ["x"], group_cols=["k"], accuracy=accuracy), "k")
    check(got, {(k,): brute([v for g, v in rows if g == k]) for k in ("hot", None, "one")})


def test_values_on_the_fence_are_inside(spark):
    rows = [(float(x),) for x in [0, 1, 2, 3, 4, 7, 8, -3, -4]]
    df = spark.createDataFrame(rows, "x double")
    check(rows_of(fenced_quartiles(df, ["x"]), "column"), {("x",): brute([r[0] for r in rows])})


def test_no_rows_and_no_columns(spark):
    df = spark.createDataFrame([], "x double, k string")
    assert fenced_quartiles(df, ["x"]).count() == 0
    assert fenced_quartiles(df, ["x"], group_cols=["k"]).count() == 0
    assert fenced_quartiles(df, ["absent"], group_cols=["k"]).count() == 0


def test_wide_rows_are_not_unpivoted(spark):
    df = spark.range(50_000).select(*[(F.col("id") * i % 1009).cast("double").alias(f"c{i}") for i in range(1, 6)])
    plan = fenced_quartiles(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Unpivot" not in plan
