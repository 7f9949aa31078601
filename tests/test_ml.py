"""Model invariants on small forests (rows-only queries)."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from attrix.operators import features as fe
from attrix.operators import ml
from attrix.plans.fixtures import subscribers

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def bundle(spark):
    df = subscribers(spark, SF_SMALL).transform(fe.build_model_ready)
    b = ml.train_final_model(df, rf_params={"n_estimators": 10, "max_depth": 5})
    yield b
    b["data"].unpersist()


def test_bundle_tables(bundle):
    m = bundle["metrics_df"].first()
    assert 0.0 <= m.accuracy <= 1.0 and 0.0 <= m.roc_auc <= 1.0
    imp = bundle["feature_importance_df"].toPandas()
    assert abs(imp.importance.sum() - 1.0) < 1e-6
    assert not imp.feature.str.contains("customer_id").any()          # N17
    assert imp.feature.str.startswith(("num__", "cat__")).all()
    preds = bundle["valid_predictions_df"]
    assert preds.where((F.col("p_churn") < 0) | (F.col("p_churn") > 1)).count() == 0
    cm = bundle["cm_df"].collect()
    assert [r.label for r in cm] == [0, 1]


def test_same_seed_same_importances(spark):
    df = subscribers(spark, SF_SMALL).transform(fe.build_model_ready)
    a = ml.train_final_model(df, rf_params={"n_estimators": 5, "max_depth": 4})
    b = ml.train_final_model(df, rf_params={"n_estimators": 5, "max_depth": 4})
    pa = a["feature_importance_df"].toPandas()
    pb = b["feature_importance_df"].toPandas()
    assert pa.equals(pb)


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([(1.0, "a", 0.0), (2.0, "b", 1.0)], "x double, region string, churned double")
    stages = ml.build_preprocessor(train, ["x"], ["region"])
    model = Pipeline(stages=stages).fit(train)
    new = spark.createDataFrame([(3.0, "zzz", 0.0)], "x double, region string, churned double")
    vec = model.transform(new).first().features.toArray()
    assert list(vec) == [3.0, 0.0, 0.0]
    names = ml.feature_names(model.transform(train))
    assert names == ["num__x", "cat__region_a", "cat__region_b"]


def test_exact_imputation_in_pipeline(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, None), (10.0, "b"), (None, "b")],
                                  "x double, region string")
    stages = ml.build_preprocessor(train, ["x"], ["region"])
    out = Pipeline(stages=stages).fit(train).transform(train).collect()
    assert out[4]["num__x"] == 3.0            # exact median, not the approximate Imputer's 2.0
    assert out[2]["__txt__region"] == "a"     # mode with ties -> smallest


def test_random_params_draw_is_seeded():
    grid = {"maxDepth": [4, 8, 12], "numTrees": [10, 20, 50]}
    assert ml.draw_params(grid, 4, 42) == ml.draw_params(grid, 4, 42)
    assert len({str(d) for d in ml.draw_params(grid, 9, 1)}) == 9


def test_scaling_uses_the_population_deviation(spark):
    train = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (None, 1.0), (2.0, 0.0)], "x double, churned double")
    out = Pipeline(stages=ml.build_preprocessor(train, ["x"], [], scale=True)).fit(train).transform(train)
    got = [r["num__x"] for r in out.collect()]                # filled with the median 2: mean 2, deviation sqrt(1/2)
    assert got == pytest.approx([-(2 ** 0.5), 2 ** 0.5, 0.0, 0.0])


def test_depth_and_penalty(spark):
    with pytest.raises(ValueError, match="depth"):
        ml.random_forest({"max_depth": 40})
    assert ml.random_forest({"max_depth": None}).getMaxDepth() == 30
    assert ml.logistic_regression(C=2.0, n_rows=100).getRegParam() == pytest.approx(0.005)
    with pytest.raises(TypeError):
        ml.logistic_regression(C=1.0)


def test_balanced_weights_reach_the_classifier(spark):
    for family in ("Random Forest", "Logistic Regression"):
        params = {"class_weight": "balanced"} | ({"C": 1.0} if family.startswith("L") else {})
        assert ml.classifier(family, params, 10, 3).getWeightCol() == ml.BALANCED_COL
        plain = ml.classifier(family, params | {"class_weight": None}, 10, 3)
        assert not plain.isSet(plain.weightCol)


def test_search_spaces_are_the_originals():
    assert ml.SEARCH_DRAWS == {"Random Forest": 20, "Logistic Regression": 10, "DNN": 10}
    assert ml.SEARCH_SPACES["Logistic Regression"]["C"][0] == pytest.approx(1e-3)
    assert len(ml.SEARCH_SPACES["Logistic Regression"]["C"]) == 12
    assert ml.SEARCH_SPACES["Logistic Regression"]["C"][-1] == pytest.approx(100)


def test_registered_searches_are_whole(spark, monkeypatch):
    """The registered searches take the operators' own draws, folds and spaces."""
    import inspect

    import __spark_entry__ as E
    from attrix.plans import queries_ml
    calls = []

    class Seen(Exception):
        pass

    def recorder(operator):
        def record(*args, **kw):
            bound = inspect.signature(operator).bind(*args, **kw)
            bound.apply_defaults()
            calls.append(bound.arguments)
            raise Seen
        return record

    for name in ("random_search", "model_comparison"):
        monkeypatch.setattr(queries_ml.ml, name, recorder(getattr(ml, name)))
    monkeypatch.setattr(queries_ml.model_store, "latest", lambda *a: None)
    found = E.queries()
    for name in ("ml_random_search", "ml_random_search_forest", "ml_random_search_network", "job_6_model_comparison",
                 "job_6_comparison_long", "job_6_auc_summary", "job_6_roc_points", "job_6_best_params", "ml_model_selection"):
        with pytest.raises(Seen):
            found[name](spark, SF_SMALL)
    searches, comparisons = calls[:3], calls[3:]
    assert [c["family"] for c in searches] == ["Logistic Regression", "Random Forest", "DNN"]
    assert all((c["grid"], c["n_iter"], c["folds"], c["prepared"], c["fixed"]) == (None, None, 5, None, {}) for c in searches)
    assert len(comparisons) == 6
    assert all((c["draws"], c["grids"], c["folds"]) == (None, None, 5) for c in comparisons)
    assert ml.SEARCH_DRAWS == {"Random Forest": 20, "Logistic Regression": 10, "DNN": 10}


def test_network_stops_early_and_keeps_the_best_epoch(spark):
    """Labels of pure noise: the loss on other rows soon rises, training ends before its last epoch."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(0)
    rows = [(Vectors.dense(rng.normal(size=8).tolist()), float(rng.integers(0, 2))) for _ in range(120)]
    train, valid = (spark.createDataFrame(rows[a:a + 60], ["features", "churned"]) for a in (0, 60))
    model, history = ml.fit_network(train, valid, 8, hidden=(16,), epochs=40, patience=2, steps=5)
    h = [tuple(r) for r in history.orderBy("epoch").collect()]
    best = min(range(len(h)), key=lambda i: h[i][3])
    assert len(h) < 40 and len(h) == best + 3                          # two epochs behind the best one
    assert h[best][1] > h[-1][1]                                       # the training loss went on falling
    assert ml._losses(model, valid, "churned") == pytest.approx((h[best][3], h[best][4]))
