"""Published models: versions, torn writes, selection and parameters read back (ML-19, ML-20, SNK-3)."""

import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from attrix.operators import ml
from attrix.operators import model_store as ms
from attrix.plans.fixtures import scores

from .conftest import SF_SMALL


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_versions_are_whole_and_kept(spark, root):
    one, two = spark.range(5).withColumn("t", F.lit("a")), spark.range(0).withColumn("t", F.lit("b"))
    assert ms.latest(spark, root) is None and ms.versions(spark, root).count() == 0
    assert [ms.publish(spark, root, {"x": d}, tag=t) for d, t in ((one, "p"), (two, "q"), (one.limit(2), "p"))] == [1, 2, 3]
    assert (ms.latest(spark, root), ms.latest(spark, root, "q"), ms.latest(spark, root, "none")) == (3, 2, None)
    assert [ms.load(spark, root, v, verify=True).tables["x"].count() for v in (1, 2, 3)] == [5, 0, 2]
    assert ms.load(spark, root, tag="q").tables["x"].dtypes == two.dtypes       # an empty table keeps its types
    assert [r[0] for r in ms.versions(spark, root).orderBy("version").select("n_rows").collect()] == [5, 0, 2]
    with pytest.raises(FileNotFoundError):
        ms.load(spark, root, 4)


def test_a_torn_write_is_invisible(spark, root):
    ms.publish(spark, root, {"x": spark.range(3)})
    attempt = uuid.uuid4().hex
    spark.range(9).write.parquet(f"{root}/data/{attempt}/tables/x")
    spark.createDataFrame([("", "table", "x", "p", 9, "")], ms.MANIFEST).write.json(f"{root}/staged/{attempt}")
    assert ms.latest(spark, root) == 1 and ms.load(spark, root).tables["x"].count() == 3
    assert ms.publish(spark, root, {"x": spark.range(4)}) == 2


def test_a_taken_number_is_passed_over(spark, root, monkeypatch):
    """A second writer that read the same newest version gets the next free one."""
    ms.publish(spark, root, {"x": spark.range(1)})
    monkeypatch.setattr(ms, "latest", lambda *a: None)
    assert ms.publish(spark, root, {"x": spark.range(2)}) == 2


def test_lost_rows_are_noticed(spark, root, tmp_path):
    ms.publish(spark, root, {"x": spark.range(10).repartition(4)})
    path = ms.versions(spark, root).first()["path"]
    spark.range(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="10 rows"):
        ms.load(spark, root, verify=True)


def test_bad_names(spark, root):
    with pytest.raises(ValueError):
        ms.publish(spark, root, {"a/b": spark.range(1)})
    with pytest.raises(ValueError):
        ms.publish(spark, root, {})


def test_models_weights_and_selection(spark, root):
    """Two models are fitted, published and picked by name; the loaded one scores as the fitted one."""
    df = spark.range(400).select(F.col("id").alias("customer_id"), (F.col("id") % 13).cast("double").alias("x"),
                                 F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("region"),
                                 (F.col("id") % 13 > 6).cast("double").alias("churned"))
    stages = ml.build_preprocessor(df, ["x"], ["region"])
    models = {"Logistic Regression": Pipeline(stages=[*stages, ml.logistic_regression(C=1.0, n_rows=400)]).fit(df),
              "Random Forest": Pipeline(stages=[*stages, ml.random_forest({"n_estimators": 3, "max_depth": 3})]).fit(df)}
    preds = ml.validation_predictions(models["Random Forest"], df).select("y_true", "y_pred", "p_churn")
    both = preds.withColumn("model", F.lit("Random Forest")).unionByName(
        ml.validation_predictions(models["Logistic Regression"], df).select("y_true", "y_pred", "p_churn")
        .withColumn("model", F.lit("Logistic Regression")))
    from attrix.operators import metrics as me
    wide = me.compare_models(both)
    out = dict.fromkeys(ms.COMPARISON_TABLES, wide) | {"predictions": both, "models": models, "data": df}
    tables, named = ms.comparison_parts(out)
    ms.publish(spark, root, tables, named)
    found = ms.load(spark, root, verify=True)
    forest, logistic = (ms.select_published(found, m) for m in ("Random Forest", "Logistic Regression"))
    assert (forest["kind"], logistic["kind"]) == ("importance", "coefficients")
    assert {r["feature"] for r in forest["weights"].collect()} == {"num__x", "cat__region_a", "cat__region_b"}
    assert forest["weights"].agg(F.sum("value")).first()[0] == pytest.approx(1)
    assert forest["metrics"].count() == 1 and forest["predictions"].count() == 400
    again = ml.score(forest["model"], df).select("customer_id", "p_churn").orderBy("customer_id").collect()
    assert again == ml.score(models["Random Forest"], df).select("customer_id", "p_churn").orderBy("customer_id").collect()
    with pytest.raises(ValueError):
        ms.select_published(found, "nobody")


def test_parameters_come_back_with_types(spark, tmp_path):
    """Every draw of every space goes out as text and comes back as it was."""
    for family, space in ml.SEARCH_SPACES.items():
        draws = ml.draw_params(space, 12, 1)
        rows = [(f"{family} {i}", k, str(v)) for i, d in enumerate(draws) for k, v in d.items()]
        best = spark.createDataFrame(rows, "model string, param string, value string")
        typed = ms.read_params(spark, ms.export_params(best, f"file://{tmp_path}/{family.replace(' ', '_')}"))
        assert typed.count() == len(draws)
        for i, d in enumerate(draws):
            assert ms.chosen_params(typed, f"{family} {i}", list(space)) == d


def test_export_of_the_original_layout(spark):
    """Integers as '300.0', blanks for absent parameters, tuples as text, columns with prefixes."""
    cols = ["model", "classifier__solver", "classifier__C", "classifier__n_estimators", "classifier__max_depth",
            "classifier__model__hidden_units", "classifier__model__learning_rate", "other"]
    wide = spark.createDataFrame([("F", None, None, "300.0", "12.0", None, None, "z"), ("N", None, None, None, "None", "(128, 64)", "0.001", "z"),
                                  ("L", "lbfgs", "12.5", None, "", None, None, "z")], ", ".join(f"{c} string" for c in cols))
    typed = {r["model"]: r for r in ms.typed_params(wide).collect()}
    assert (typed["F"]["n_estimators"], typed["F"]["max_depth"], typed["F"]["C"]) == (300, 12, None)
    assert (typed["N"]["hidden"], typed["N"]["learning_rate"], typed["N"]["max_depth"]) == ([128, 64], 0.001, None)
    assert (typed["L"]["solver"], typed["L"]["C"], typed["L"]["max_depth"]) == ("lbfgs", 12.5, None)
    assert "other" not in typed["L"].asDict()


@pytest.mark.parametrize("column,text", [("n_estimators", "many"), ("n_estimators", "2.5"), ("C", "x"), ("hidden_units", "wide")])
def test_text_of_another_type_raises(spark, column, text):
    wide = spark.createDataFrame([("m", text)], f"model string, classifier__{column} string")
    with pytest.raises(Exception, match="parameter"):
        ms.typed_params(wide).collect()


def test_fallback_and_double_rows(spark):
    typed = ms.typed_params(spark.createDataFrame([("m", "1"), ("m", "2")], "model string, classifier__epochs string"))
    assert ms.chosen_params(typed, "absent", ["epochs"], ms.FALLBACK_FOREST) == ms.FALLBACK_FOREST
    for model in ("m", "absent"):
        with pytest.raises(ValueError):
            ms.chosen_params(typed, model, ["epochs"])


def test_published_halves(spark):
    from attrix.plans.queries_ml import ml_versions
    rows = ml_versions(spark, SF_SMALL).groupBy("version").agg(F.sum("n_rows").alias("n")).collect()
    assert sorted(r["version"] for r in rows) == [1, 2]
    assert sum(r["n"] for r in rows) == scores(spark, SF_SMALL).count()


def test_a_searched_comparison_is_published(spark, root):
    """JOB-6 -> store: refitted models of all families, their weights and parameters."""
    df = spark.range(240).select(F.col("id").alias("customer_id"), (F.col("id") % 13).cast("double").alias("x"),
                                 F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("region"),
                                 (F.col("id") % 13 > 6).cast("long").alias("churned"))
    out = ml.model_comparison(df, folds=2, draws={"Random Forest": 1, "Logistic Regression": 1, "DNN": 1},
                              grids={"Random Forest": {"n_estimators": [5], "max_depth": [None], "max_features": ["sqrt"],
                                                       "min_samples_split": [2], "min_samples_leaf": [1], "class_weight": [None]},
                                     "Logistic Regression": {"C": [1.0], "class_weight": ["balanced"]},
                                     "DNN": {"hidden": [(4,)], "batch_size": [32], "epochs": [5]}})
    ms.publish(spark, root, *ms.comparison_parts(out), tag="t")
    ml.release(out)
    found = ms.load(spark, root, tag="t", verify=True)
    kinds = {m: ms.select_published(found, m)["kind"] for m in ml.SEARCH_SPACES}
    assert kinds == {"Random Forest": "importance", "Logistic Regression": "coefficients", "DNN": "none"}
    typed = ms.read_params(spark, ms.export_params(found.tables["best_params"], f"{root}/params"))
    assert ms.chosen_params(typed, "DNN", ["hidden", "epochs"]) == {"hidden": (4,), "epochs": 5}
    assert ms.chosen_params(typed, "Random Forest", ["n_estimators", "max_depth"]) == {"n_estimators": 5, "max_depth": None}
