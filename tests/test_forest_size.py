"""Forests of tables and of node tables that one process should not hold as objects."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from attrix.operators import folds, forests, ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        a, b = float(rng.normal()), float(rng.integers(0, 50))
        out.append((None if i % 60 == 0 else i // 2, None if i % 9 == 0 else a, b, None if i % 11 == 0 else "xyz"[i % 3],
                    int(a + b / 50 + 0.5 * rng.normal() > 0.5)))
    return spark.createDataFrame(out, "customer_id long, a double, k double, location string, churned long").repartition(3).cache()


def test_blocks_of_cells_are_those_of_the_whole_table(rows, tmp_path, monkeypatch):
    """A task got rows of objects, so that larger tables went to Spark's forest."""
    monkeypatch.setattr(forests, "BLOCK", 64)
    monkeypatch.setattr(forests, "PART_ROWS", 200)
    p = folds.prepare(rows, ["a", "k"], ["location"], "churned", "customer_id", f"file://{tmp_path}", 3, 7)
    blocks = forests._blocks(p)
    assert blocks.agg({"part": "max", "place": "max"}).first()[0] > 0 and blocks.count() > 6
    cuts = forests._cuts(blocks, p.design, [-1, 1])
    whole = p.matrix.toPandas()
    x, c, y, fold = np.stack(whole.x), np.stack(whole.c).astype(int), whole.y.to_numpy(), whole.fold.to_numpy()
    missing = whole.row.isna().to_numpy()
    order = np.lexsort((fold, *c.T, *x.T, y, missing, np.unique(whole.row.fillna("").to_numpy(str), return_inverse=True)[1]))
    x, c, y, fold = x[order], c[order], y[order], fold[order]
    dealt, kind = forests._copied(p, blocks, cuts, {-1: [4], 1: [9]})
    seen = {r.task: r for r in dealt.applyInArrow(_whole_of(kind), "task int, codes binary, y binary, fold binary").collect()}
    for task, k in ((4, -1), (9, 1)):
        want = forests._Binned(p.design, k, x, c, fold != k)
        for a, b in zip(want.thresholds, cuts[k], strict=True):
            np.testing.assert_array_equal(a, b)
        np.testing.assert_array_equal(np.frombuffer(seen[task].codes, kind).reshape(3, -1), want.codes)
        np.testing.assert_array_equal(np.frombuffer(seen[task].y, np.float32), y)
        np.testing.assert_array_equal(np.frombuffer(seen[task].fold, np.int32), fold)


def _whole_of(kind):
    def run(table):
        import pyarrow as pa
        from attrix.operators import forests as f
        _, codes, y, fold = f._whole(table, 3, kind)
        return pa.table({"task": pa.array([table.column("task")[0].as_py()], pa.int32()),
                         **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("codes", codes), ("y", y), ("fold", fold))}})
    return run


def test_a_large_forest_scores_from_its_node_table(spark, rows, monkeypatch, tmp_path):
    """Spark's model of two million nodes went to the driver and to every scoring task."""
    params = {"n_estimators": 9, "max_depth": 6, "min_samples_split": 4}
    prep, small = forests.fit_rows(rows, params, "churned", "customer_id")
    monkeypatch.setattr(forests, "MODEL_NODES", 0)
    _, large = forests.fit_rows(rows, params, "churned", "customer_id")
    assert isinstance(large, forests.GrownForest) and not isinstance(small, forests.GrownForest)
    path = f"file://{tmp_path}/model"
    PipelineModel(stages=[*prep.stages, large]).write().save(path)
    read = PipelineModel.load(path)
    assert isinstance(read.stages[-1], forests.GrownForest)
    x = prep.transform(rows)
    assert [f.name for f in small.transform(x).schema] == [f.name for f in large.transform(x).schema]
    at = ["customer_id", "k", "a"]

    def scored(model, df):
        found = model.transform(df).select(*at, vector_to_array("rawPrediction").alias("r"), vector_to_array("probability").alias("p"),
                                           "prediction").toPandas().sort_values(at)
        return [np.stack(found.r), np.stack(found.p), found.prediction.to_numpy()]
    want = scored(small, x)
    for model, df in ((large, x), (read, rows), (large.as_spark(), x)):
        for a, b in zip(want, scored(model, df), strict=True):
            np.testing.assert_allclose(b, a, atol=1e-9)
    np.testing.assert_allclose(large.featureImportances.toArray(), small.featureImportances.toArray(), atol=1e-12)
    assert (large.getNumTrees, large.getMaxDepth(), large.numFeatures) == (small.getNumTrees, small.getMaxDepth(), small.numFeatures)
    bundle = ml.train_final_model(rows, rf_params={"n_estimators": 5})
    assert isinstance(bundle["model"].stages[-1], forests.GrownForest)
    paths = ml.export_training_outputs(bundle, f"file://{tmp_path}/out")
    assert PipelineModel.load(paths["model_path"]).transform(rows).count() == 600
    bundle["data"].unpersist()
