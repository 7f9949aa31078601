"""Forests of small tables: how the work is dealt out, and splits found from siblings' histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.operators import folds, forests, ml


@pytest.fixture(scope="module")
def rows(spark):
    """Ids that repeat and that are missing, a text, a number with gaps."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(400):
        a = float(rng.normal())
        out.append((None if i % 50 == 0 else i // 2, None if i % 9 == 0 else a, float(i % 5), "xyz"[i % 3],
                    int(a + 0.5 * rng.normal() > 0)))
    return spark.createDataFrame(out, "customer_id long, a double, k double, location string, churned long").repartition(3).cache()


@pytest.fixture(scope="module")
def prepared(rows, tmp_path_factory):
    return folds.prepare(rows, ["a", "k"], ["location"], "churned", "customer_id", f"file://{tmp_path_factory.mktemp('folds')}", 3, 7)


def test_few_copies_for_many_pieces_of_work(spark, prepared):
    """A table was copied once for each of 500 pieces; now a few times a core, each copy in a partition of its own."""
    costs = [1 + i % 7 for i in range(500)]
    dealt, groups = forests._dealt(prepared, costs)
    n = forests.GROUPS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sorted(i for g in groups.values() for i in g) == list(range(500)) and len(groups) == min(n, 500)
    load = [sum(costs[i] for i in g) for g in groups.values()]
    assert max(load) - min(load) <= max(costs)
    at = dealt.applyInArrow(_sizes, "task int, n long").withColumn("part", F.spark_partition_id()).collect()
    assert {r.task: r.n for r in at} == dict.fromkeys(groups, 400)
    assert len({r.part for r in at}) == len(at) == len(groups)


def _sizes(table):
    import pyarrow as pa
    return pa.table({"task": pa.array([table.column("task")[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})


@pytest.mark.parametrize("many", [False, True])
def test_every_split_of_a_deep_tree_is_the_best(prepared, monkeypatch, many):
    """Counted or derived from its sibling, a node's histogram gives the best cut of its rows, with class weights."""
    if many:                                                        # as for more rows than one float's digits hold
        monkeypatch.setattr(forests, "_packing", lambda n: ([[0, 1], [2]], 26))
    whole = prepared.matrix.toPandas()
    x, c, y = np.stack(whole.x), np.stack(whole.c).astype(int), whole.y.to_numpy()
    b = forests._Binned(prepared.design, -1, x, c, np.ones(len(y), bool))
    times = np.random.default_rng(1).integers(0, 3, len(y)).astype(float)
    weights = (0.7, 1.9)
    nodes, leaf = forests.grow(b, y, times, np.random.default_rng(2), 6, 3, 2, b.width, weights)
    w = times * np.where(y == 1, weights[1], weights[0])
    inside = {0: np.ones(len(y), bool)}
    checked = 0
    for v in range(len(nodes["cell"])):
        mine = inside[v]
        drawn = mine & (times > 0)
        assert nodes["rows"][v] == drawn.sum() and nodes["weight"][v] == pytest.approx(w[mine].sum())
        costs = {}
        for cell in np.flatnonzero(b.allowed):
            value = b.cells[:, b.column[cell]]
            left = value <= cell if cell < b.numeric_cells else value != cell
            sides = [drawn & left, drawn & ~left]
            if min(s.sum() for s in sides) >= 3:
                costs[cell] = sum(w[s & (y == 1)].sum() * w[s & (y == 0)].sum() / w[s].sum() for s in sides)
        cell = nodes["cell"][v]
        if cell >= 0:
            checked += 1
            assert costs[cell] == pytest.approx(min(costs.values()))
            value = b.cells[:, b.column[cell]]
            right = value > cell if cell < b.numeric_cells else value == cell
            inside[nodes["left"][v]], inside[nodes["left"][v] + 1] = mine & ~right, mine & right
        else:
            assert set(leaf[mine]) <= {v}
    assert checked > 10


def test_final_forest_of_a_small_table_is_grown_in_tasks(rows, monkeypatch):
    """Spark's own forest sends the histograms of all nodes of all trees through a shuffle."""
    class Whole:
        def fit(self, _x):
            raise AssertionError("Spark's forest on a small table")

    original = ml.random_forest
    monkeypatch.setattr(ml, "random_forest", lambda *a, **kw: original(*a, **kw) and Whole())
    bundle = ml.train_final_model(rows, rf_params={"n_estimators": 12})
    forest = bundle["model"].stages[-1]
    assert forest.getNumTrees == 12 and forest.getMaxDepth() == 12
    inner = forests.node_table(forest).where("leftChild >= 0")
    assert inner.agg(F.min("rawCount")).first()[0] >= 10            # min_samples_split
    assert bundle["valid_predictions_df"].count() == 80 and bundle["metrics_df"].first().roc_auc > 0.7
    bundle["data"].unpersist()
    with pytest.raises(ValueError):
        ml.train_final_model(rows, rf_params={"max_depth": 31})


def test_larger_tables_keep_to_the_spark_forest(spark, rows, monkeypatch):
    monkeypatch.setattr(forests, "MAX_CELLS", 0)
    monkeypatch.setattr(forests, "fit_small", None)
    prep, forest = forests.fit_rows(rows, {"n_estimators": 3, "max_depth": 4, "min_samples_split": 60}, "churned", "customer_id")
    assert forest.getNumTrees == 3 and forests.node_table(forest).where("leftChild >= 0 and rawCount < 60").count() == 0
    assert forest.transform(prep.transform(rows)).count() == 400


def test_tables_of_a_final_forest_read_written_predictions(spark, rows):
    """every stage over a cached table of predictions shipped the whole forest."""
    bundle = ml.train_final_model(rows, rf_params={"n_estimators": 3})
    for name in ("metrics_df", "cm_df", "valid_predictions_df"):
        plan = bundle[name]._jdf.queryExecution().analyzed().toString()
        assert "UDF" not in plan and "InMemoryRelation" not in plan and "parquet" in plan, name
    bundle["data"].unpersist()


def test_a_small_forest_reads_its_table_once(spark, prepared, monkeypatch):
    """Spark's stump, whose metadata the forest takes over, was fitted on the whole table."""
    sizes = []
    fit = forests.RandomForestClassifier.fit
    monkeypatch.setattr(forests.RandomForestClassifier, "fit", lambda self, df, *a: sizes.append(df.count()) or fit(self, df, *a))
    model = forests.fit_small(prepared, {"n_estimators": 3, "max_depth": 4}, 5)
    assert sizes == [2] and model.getNumTrees == 3 and model.numFeatures == prepared.design.width and model.numClasses == 2


def test_draws_that_differ_in_where_trees_end_share_them(prepared):
    """every draw grew trees of its own; p is that of draws run alone."""
    draws = [(0, {"n_estimators": 60, "max_depth": 2, "min_samples_leaf": 5, "min_samples_split": 2, "max_features": "sqrt"}),
             (1, {"n_estimators": 110, "max_depth": 6, "min_samples_leaf": 5, "min_samples_split": 10, "max_features": "sqrt"}),
             (2, {"n_estimators": 20, "max_depth": None, "min_samples_leaf": 5, "min_samples_split": 5, "max_features": "sqrt"}),
             (3, {"n_estimators": 10, "max_depth": 2, "min_samples_leaf": 5, "min_samples_split": 11, "max_features": "sqrt"})]
    assert sum(last - first for _, first, last in forests._shared(draws)) == 110 + 10
    keys = ["draw", "fold", "row", "y", "p"]
    order = lambda frame: sorted(map(tuple, frame.select(F.col("row").isNull(), *keys).collect()),
                                 key=lambda r: (*r[1:3], r[0], r[3] or "", *r[4:]))
    together = order(forests.cross_validated(prepared, draws, 4))
    alone = sorted((r for d in draws for r in order(forests.cross_validated(prepared, [d], 4))),
                   key=lambda r: (*r[1:3], r[0], r[3] or "", *r[4:]))
    assert len(together) == len(alone) and [r[:5] for r in together] == [r[:5] for r in alone]
    np.testing.assert_allclose([r[5] for r in together], [r[5] for r in alone], atol=1e-12)


def test_upper_levels_are_the_trees_that_end_there(prepared):
    whole = prepared.matrix.toPandas()
    x, c, y = np.stack(whole.x), np.stack(whole.c).astype(int), whole.y.to_numpy()
    b = forests._Binned(prepared.design, -1, x, c, np.ones(len(y), bool))
    some, by_depth = np.arange(0, len(y), 3), {}
    nodes, leaf = forests.grow(b, y, np.ones(len(y)), np.random.default_rng(3), 9, 1, 2, 2, (1.0, 1.0), some, by_depth)
    for depth in range(10):
        small, all_leaves = forests.grow(b, y, np.ones(len(y)), np.random.default_rng(3), depth, 1, 2, 2)
        at = by_depth.get(depth, leaf)
        np.testing.assert_array_equal(all_leaves[some], at)
        np.testing.assert_array_equal(small["positive"][all_leaves[some]], nodes["positive"][at])
