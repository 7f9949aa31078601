"""AGG-24: the density against the kernel sum over all rows, within its stated error; AGG-17, AGG-28 in two scans."""

import math

import numpy as np
import pytest

from attrix.operators import profile as pr
from attrix.operators.density import kde_by_group


def direct(values, x):
    v = np.array(values)
    h = v.std(ddof=1) * len(v) ** -0.2
    z = (x[:, None] - v[None]) / h
    return np.exp(-0.5 * z * z).sum(1) / (len(v) * h * math.sqrt(2 * math.pi)), 1 / (h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4, 1e-6])
def test_error_is_within_the_bound(spark, tolerance):
    """Three shapes, one with a far outlier and one that holds most rows on one value."""
    rng = np.random.default_rng(11)
    data = {"normal": rng.normal(size=3000), "far": np.r_[rng.normal(size=500), 400.0],
            "repeated": np.r_[np.zeros(1000), rng.uniform(-2, 2, 300)]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = kde_by_group(df, "v", "k", grid_points=801, tolerance=tolerance).toPandas()
    assert sorted(set(got["k"])) == sorted(data)
    worst = 0.0
    for k, vs in data.items():
        mine = got[got["k"] == k].sort_values("x")
        assert len(mine) == 801
        want, peak = direct(vs, mine["x"].to_numpy())
        assert mine["max_error"].iloc[0] == pytest.approx(tolerance * peak)
        error = np.abs(mine["density"].to_numpy() - want).max()
        assert error <= tolerance * peak
        worst = max(worst, error / (tolerance * peak))
    assert worst > 0.01         # the bound isn't empty: nodes are no finer than it asks


def test_cells_follow_the_tolerance(spark):
    """Half a million rows at a loose tolerance give as many nodes as the bound asks, not more for more rows."""
    df = spark.range(500_000).selectExpr("'a' as k", "cast(id as double) as v")
    got = kde_by_group(df, "v", "k", grid_points=5, tolerance=1e-2).toPandas()
    v = np.arange(500_000.0)
    h = v.std(ddof=1) * len(v) ** -0.2
    inner = got["density"].to_numpy()[1:-1]
    assert inner == pytest.approx(1 / 500_000, rel=0.02)
    assert (v[-1] / (2 * 0.1 * h)) < 500        # nodes, against 500,000 rows


def test_awkward_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("one", 1.5),
            ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), (None, 7.0)]
    got = kde_by_group(spark.createDataFrame(rows, "k string, v double"), "v", "k", grid_points=3).collect()
    assert [(r["k"], r["x"]) for r in got] == [("a", 1.0), ("a", 1.5), ("a", 2.0)]
    want, _ = direct([1.0, 2.0], np.array([1.0, 1.5, 2.0]))
    assert [r["density"] for r in got] == pytest.approx(list(want), abs=1e-5)
    empty = spark.createDataFrame([], "k string, v double")
    assert kde_by_group(empty, "v", "k").count() == 0
    single = kde_by_group(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), "v", "k", grid_points=1)
    assert [r["x"] for r in single.collect()] == [1.0]
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            kde_by_group(empty, "v", "k", tolerance=bad)



def test_describe_keeps_empty_groups_and_reads_once_more_only(spark, tmp_path):
    """A group of missing values has count 0; the cached first pass serves statistics, keys and brackets."""
    rows = [("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", None), ("b", float("nan")), (None, 5.0), ("c", 4.0)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = pr.describe_by_group(df, "v", "k")
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (3, 4.333, 2.0, 4.933, 1.0, 10.0), "b": (0, None, None, None, None, None),
                   "c": (1, 4.0, 4.0, None, 4.0, 4.0)}
    leaves = out._jdf.queryExecution().withCachedData().collectLeaves()
    kinds = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    # besides the cached first pass, which reads the rows once, they are read once more
    assert kinds.count("LogicalRelation") == 1


def test_profile_is_not_unpivoted(spark):
    rows = [(1.0, 5, None), (2.0, 7, None), (float("nan"), 9, None), (None, 100, None)]
    df = spark.createDataFrame(rows, "x double, y int, z double")
    out = pr.numeric_profile(df, ["x", "y", "z", "absent"])
    assert [tuple(r) for r in out.collect()] == [("x", 1.0, 2.0, 1.5), ("y", 5.0, 100.0, 8.0), ("z", None, None, None)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    default = {r["column"]: r["num_value"] for r in pr.default_profile(df, ["x", "y", "z"], []).collect()}
    assert default == {"x": 1.5, "y": 8.0, "z": 0.0}
