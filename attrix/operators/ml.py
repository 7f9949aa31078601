"""Machine learning on ``pyspark.ml`` (ML-1 … ML-11, ML-17 … ML-23).

Preprocessing is a ``Pipeline`` so that the fitted model scores new tables
by itself:

* imputation values are computed exactly (distributed median / mode, see
  :mod:`attrix.operators.quantiles`) and baked into a ``SQLTransformer``
  stage — ``ml.Imputer(strategy="median")`` is only approximate;
* numeric inputs are renamed ``num__<col>``, one-hot outputs are
  ``cat__<col>``, so vector metadata yields names like
  ``cat__location_Alabama`` for importances and coefficients;
* ``StringIndexer(handleInvalid="keep")`` + ``OneHotEncoder(dropLast=True)``
  drops exactly the extra "unknown" slot: every seen level has a column and
  an unseen level encodes as all zeros.

Models differ from the original's libraries where Spark has no equal:
trees bin continuous features (``maxBins``), and their ``min_samples_split`` is
applied to the fitted nodes (:func:`.forests.with_min_split`); the dense network is Spark's multilayer perceptron
(sigmoid hidden layers, no dropout; early stopping in :func:`fit_network`) — a
different model, used for the same comparison.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..functions.columns import clean_feature_name, logspace
from . import metrics as me
from .profile import default_profile

MAX_TREE_DEPTH = 30
BALANCED_COL = "__balanced"
HELPER_COLS = ("y_true", "y_pred", "p_churn", "customer_id")


# -- ML-1/2: exact imputation -----------------------------------------------------------

def fill_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per column default: exact median (0.0 if all null) / most frequent text
    ('Unknown' if all null).  Long table (column, kind, num_value, text_value)."""
    return default_profile(df, numeric, categorical)


def _fill_map(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, Any]:
    # one row per feature column: a bounded table, brought to the driver to
    # become literals of the scoring stage
    rows = fill_values(df, numeric, categorical).collect()
    return {r["column"]: (r["num_value"] if r["kind"] == "numeric" else r["text_value"]) for r in rows}


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
           reference: DataFrame | None = None) -> DataFrame:
    """ML-1 / ML-2 as a plan: fill values (from ``reference``, default the
    table itself) joined as one broadcast row.  ML-21 what-if profiles are
    the same operation with the feature table as reference."""
    vals = fill_values(reference if reference is not None else df, numeric, categorical)
    wide = vals.groupBy().pivot("column", [*numeric, *categorical]).agg(
        F.first(F.coalesce(F.col("num_value").cast("string"), F.col("text_value"))))
    wide = wide.select([F.col(f"`{c}`").alias(f"__fill_{i}") for i, c in enumerate([*numeric, *categorical])])
    out = df.crossJoin(F.broadcast(wide))
    for i, c in enumerate([*numeric, *categorical]):
        typ = df.schema[c].dataType
        fill = F.col(f"__fill_{i}").cast("double" if c in numeric else "string")
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double" if c in numeric else "string"), fill)
                             .cast(typ if c in categorical else T.DoubleType()))
    return out.drop(*[f"__fill_{i}" for i in range(len(numeric) + len(categorical))])


# -- ML-3..5: preprocessing ---------------------------------------------------------------

def feature_columns(df: DataFrame, target: str = dims.TARGET,
                    categorical_candidates: Sequence[str] = tuple(dims.CATEGORICAL_FEATURES),
                    drop: Sequence[str] = HELPER_COLS) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features; the target and helper columns
    (including the id, N17) are excluded."""
    cols = [c for c in df.columns if c != target and c not in drop]
    cats = [c for c in categorical_candidates if c in cols]
    nums = [c for c in cols if c not in cats]
    return nums, cats


def _sql_literal(v: Any) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


def _scaling(train: DataFrame, filled: Mapping[str, str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (N10) of each filled column; a constant
    column keeps scale 1.  One aggregate, one row."""
    if not filled:
        return {}
    aggs = [x for i, e in enumerate(filled.values()) for x in
            (F.avg(F.expr(e)).alias(f"m{i}"), F.stddev_pop(F.expr(e)).alias(f"s{i}"))]
    row = train.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(filled)}


def preprocessing_stages(numeric: Sequence[str], categorical: Sequence[str], fills: Mapping[str, Any],
                         scaling: Mapping[str, tuple[float, float]] | None, features_col: str = "features") -> list:
    """ML-5: stages [fill (and standardise), index, one-hot, assemble] from given
    fill values and (mean, deviation); NaN is missing like NULL."""
    filled = {c: _filled(c, fills[c]) for c in numeric}
    if scaling:
        filled = {c: f"(({e}) - {_sql_literal(scaling[c][0])}) / {_sql_literal(scaling[c][1])}" for c, e in filled.items()}
    exprs = [f"CAST({e} AS DOUBLE) AS `num__{c}`" for c, e in filled.items()]
    exprs += [f"coalesce(CAST(`{c}` AS STRING), {_sql_literal(fills[c])}) AS `__txt__{c}`"
              for c in categorical]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if categorical:
        stages.append(StringIndexer(inputCols=[f"__txt__{c}" for c in categorical],
                                    outputCols=[f"__idx__{c}" for c in categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"__idx__{c}" for c in categorical],
                                    outputCols=[f"cat__{c}" for c in categorical], dropLast=True))
    stages.append(VectorAssembler(inputCols=[*[f"num__{c}" for c in numeric], *[f"cat__{c}" for c in categorical]],
                                  outputCol=features_col, handleInvalid="keep"))
    return stages


def _filled(c: str, fill: float) -> str:
    return f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {_sql_literal(fill)})"


def build_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       scale: bool = False, features_col: str = "features") -> list:
    """ML-5: preprocessing stages with fill values (and scaling) learned from ``train``."""
    fills = _fill_map(train, numeric, categorical)
    scaling = _scaling(train, {c: _filled(c, fills[c]) for c in numeric}) if scale else None
    return preprocessing_stages(numeric, categorical, fills, scaling, features_col)


def feature_names(scored: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled vector slots, from the column metadata."""
    attrs = scored.schema[features_col].metadata["ml_attr"]["attrs"]
    slots = []
    for kind in attrs.values():
        slots.extend(kind)
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]


# -- ML-6..9: classifiers ---------------------------------------------------------------------

def random_forest(params: Mapping[str, Any] | None = None, label: str = dims.TARGET,
                  weight_col: str | None = None) -> RandomForestClassifier:
    """ML-6 with the original's defaults mapped to Spark parameters.  Spark's
    trees end at depth 30: no limit (``None``) means 30, a larger one raises."""
    p = dict(dims.DEFAULT_RF_PARAMS, **(params or {}))
    max_depth = p.get("max_depth")
    if max_depth is not None and int(max_depth) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {max_depth}: Spark's trees end at depth {MAX_TREE_DEPTH}")
    kw = dict(labelCol=label, featuresCol="features", numTrees=int(p["n_estimators"]),
              maxDepth=MAX_TREE_DEPTH if max_depth is None else int(max_depth),
              minInstancesPerNode=int(p.get("min_samples_leaf") or 1),
              featureSubsetStrategy="all" if p.get("max_features") in (None, 1.0) else str(p["max_features"]),
              seed=int(p.get("random_state") or 42),
              # deep forests: larger node batches per pass over the data, and
              # node ids cached with the rows instead of shipping trees
              maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    if weight_col:
        kw["weightCol"] = weight_col
    return RandomForestClassifier(**kw)


def logistic_regression(C: float, n_rows: int, label: str = dims.TARGET,
                        weight_col: str | None = None, max_iter: int = 3000) -> LogisticRegression:
    """ML-7: L2 penalty ``1 / C`` on the summed loss = ``regParam = 1 / (C n)``
    on Spark's averaged loss, so the number of training rows is needed;
    features are already scaled."""
    reg = 1.0 / (C * n_rows)
    kw = dict(labelCol=label, featuresCol="features", regParam=reg, elasticNetParam=0.0,
              standardization=False, maxIter=max_iter)
    if weight_col:
        kw["weightCol"] = weight_col
    return LogisticRegression(**kw)


def decision_tree(max_depth: int = 4, min_samples_leaf: int = 1, label: str = dims.TARGET,
                  seed: int = 42) -> DecisionTreeClassifier:
    """ML-8; a minimum split size is applied to the fitted tree by :func:`.forests.with_min_split`."""
    return DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=max_depth,
                                  minInstancesPerNode=min_samples_leaf, seed=seed)


def dense_network(n_features: int, hidden: Sequence[int] = (128, 64), batch_size: int = 32, epochs: int = 20,
                  label: str = dims.TARGET, seed: int = 42) -> MultilayerPerceptronClassifier:
    """ML-9 (re-aimed): Spark's multilayer perceptron, layers
    [n_features, *hidden, 2]; sigmoid hidden units, softmax output.  It is fitted
    by l-bfgs, which has no learning rate and no dropout."""
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[n_features, *hidden, 2],
                                          blockSize=batch_size, maxIter=epochs, seed=seed, solver="l-bfgs")


def _loss_passes(model, df: DataFrame, label: str) -> list[Callable[[], float]]:
    """Mean log loss and AUC of a table, a scoring pass each, still to be run."""
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
    scored = model.transform(df)
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    return [lambda: scored.agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0],
            lambda: evaluator.evaluate(scored)]


def _losses(model, df: DataFrame, label: str) -> tuple[float, float]:
    """(mean log loss, AUC) of a table, from one scoring pass each."""
    loss, auc = (run() for run in _loss_passes(model, df, label))
    return loss, auc


def fit_network(train: DataFrame, valid: DataFrame, n_features: int, hidden: Sequence[int] = (128, 64), epochs: int = 30,
                patience: int = 3, steps: int = 4, batch_size: int = 32, label: str = dims.TARGET, seed: int = 42):
    """ML-9 / ML-23 with early stopping: the perceptron is fitted ``steps`` optimiser
    iterations at a time, each epoch starting from the weights of the last one.  After
    an epoch both tables are scored, beside the fit of the next; when the loss on ``valid`` has not fallen for
    ``patience`` epochs, training ends, and the weights of the best epoch are the
    model.  Tables have ``features`` and the label.  Returns the model and its history
    (epoch, loss, auc, val_loss, val_auc): a row per epoch."""
    from . import networks
    spark = train.sparkSession
    train, valid = train.persist(), valid.persist()
    blocks = networks.table_blocks(train, n_features, batch_size, label)
    weights, best, rows = None, None, []

    def fit() -> tuple:
        network = dense_network(n_features, hidden, batch_size, steps, label, seed)
        if weights is not None:
            network = network.setInitialWeights(weights)
        found = Vectors.dense(networks.fit_many(blocks, [(-1, network)])[0])
        return found, networks.as_model(spark, network, found)

    try:
        # the weights of an epoch are all that the next needs: it is fitted while the epoch is scored, for nothing if it is the last
        with ThreadPoolExecutor(5) as pool:
            def start(work):
                return pool.submit(inheritable_thread_target(spark)(work))

            weights, model = fit()
            for epoch in range(epochs):
                scoring = [start(f) for df in (train, valid) for f in _loss_passes(model, df, label)]
                ahead = start(fit) if epoch + 1 < epochs else None
                loss, auc, val_loss, val_auc = (f.result() for f in scoring)
                rows.append((epoch, loss, auc, val_loss, val_auc))
                if best is None or val_loss < best[0]:
                    best = (val_loss, epoch, model)
                elif epoch - best[1] >= patience:
                    break
                if ahead is not None:
                    weights, model = ahead.result()
    finally:
        blocks.release()
        train.unpersist()
        valid.unpersist()
    history = spark.createDataFrame(rows, "epoch int, loss double, auc double, val_loss double, val_auc double")
    return best[2], history


# -- ML-11, 22: scoring -----------------------------------------------------------------------------

def score(model: PipelineModel, df: DataFrame, proba_col: str = "p_churn",
          pred_col: str = "y_pred") -> DataFrame:
    """ML-11: positive-class probability and 0/1 prediction for every row."""
    out = model.transform(df)
    return (out.withColumn(proba_col, vector_to_array("probability")[1])
               .withColumn(pred_col, F.col("prediction").cast("long")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on a partition a core at least: scoring by hundreds of trees is work, however few the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.  Tables made from it neither score again nor ship the model, which every
    stage over a cached table of predictions does."""
    from ..session import shared_path
    path = shared_path(df.sparkSession, "predictions", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validation_predictions(model: PipelineModel, valid: DataFrame, target: str = dims.TARGET) -> DataFrame:
    """ML-22: input columns + y_true, y_pred, p_churn."""
    base_cols = [c for c in valid.columns if c != target]
    scored = score(model, valid)
    return scored.select(*base_cols, F.col(target).cast("long").alias("y_true"), "y_pred", "p_churn")


# -- ML-17/18/23: model tables --------------------------------------------------------------------------

def importance_table(spark: SparkSession, names: Sequence[str], values: Sequence[float],
                     value_col: str = "importance") -> DataFrame:
    """ML-17 / ML-18: (feature, value, feature_clean), largest first.  One
    row per model feature — model metadata, not data rows."""
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)],
                               f"feature string, {value_col} double")
    return (df.withColumn("feature_clean", clean_feature_name("feature"))
              .orderBy(F.col(value_col).desc(), "feature"))


def training_history(spark: SparkSession, history: Sequence[float]) -> DataFrame:
    """ML-23: (iteration, loss) from a model summary's objective history."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)],
                                 "iteration int, loss double")


# -- ML-10: random search ------------------------------------------------------------------------------

# FIXED VALUES: search spaces and numbers of draws of the original
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "Random Forest": {"n_estimators": [100, 200, 300, 400], "max_depth": [5, 8, 12, 16, None],
                      "min_samples_split": [2, 5, 10, 20], "min_samples_leaf": [1, 2, 5, 10],
                      "max_features": ["sqrt", "log2", None], "class_weight": [None, "balanced"]},
    "Logistic Regression": {"C": logspace(-3, 2, 12), "class_weight": [None, "balanced"]},
    "DNN": {"hidden": [(32,), (64, 32), (128, 64)], "batch_size": [32, 64], "epochs": [20, 30]},
}
SEARCH_DRAWS = {"Random Forest": 20, "Logistic Regression": 10, "DNN": 10}


def draw_params(grid: Mapping[str, Sequence[Any]], n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded draw of ``n_iter`` distinct combinations from a parameter grid."""
    keys = sorted(grid)
    combos = [{}]
    for k in keys:
        combos = [dict(c, **{k: v}) for c in combos for v in grid[k]]
    rng = random.Random(seed)
    return rng.sample(combos, min(n_iter, len(combos)))


def classifier(family: str, params: Mapping[str, Any], n_rows: int, n_features: int, label: str = dims.TARGET,
               **fixed):
    """A classifier of a family with one draw of its search space; a draw with
    ``class_weight='balanced'`` trains with the rows' weights (ML-24)."""
    p = dict(params)
    weight = BALANCED_COL if p.pop("class_weight", None) == "balanced" else None
    if family == "Random Forest":
        return random_forest(p, label=label, weight_col=weight, **fixed)
    if family == "Logistic Regression":
        return logistic_regression(n_rows=n_rows, label=label, weight_col=weight, **p, **fixed)
    return dense_network(n_features, label=label, **p, **fixed)


def random_search(train: DataFrame, family: str, grid: Mapping[str, Sequence[Any]] | None = None,
                  n_iter: int | None = None, folds: int = 5, seed: int = 42, target: str = dims.TARGET,
                  id_col: str = "customer_id", prepared=None, **fixed):
    """ML-10: seeded draws from a family's search space, AUC-scored by exact
    stratified k-fold cross-validation, refit on the best draw.

    Fill values, categories and scaling are fitted on the training folds of each
    split, never on the fold that is scored.  ``prepared`` is the result of
    :func:`.search.prepare_search`, made here if absent.  Returns (fitted PipelineModel,
    table of (draw, params, mean_auc), best draw as a dict)."""
    from . import search
    draws = draw_params(grid or SEARCH_SPACES[family], n_iter or SEARCH_DRAWS[family], seed)
    shared = prepared or search.prepare_search(train, folds, seed, target, id_col)
    aucs = search.search_scores(shared, family, draws, target, seed, **fixed)
    best = max(range(len(draws)), key=lambda i: (aucs[i], -i))
    model = search.refit(shared, family, draws[best], target, seed, **fixed)
    if prepared is None:
        shared.release()
    table = train.sparkSession.createDataFrame([(i, str(d), a) for i, (d, a) in enumerate(zip(draws, aucs, strict=True))],
                                               "draw int, params string, mean_auc double")
    return model, table.orderBy(F.col("mean_auc").desc(), "draw"), draws[best]


# -- ML-6 end to end: the final-model bundle ----------------------------------------------------------------

def train_final_model(df: DataFrame, target: str = dims.TARGET, test_size: float = 0.2, seed: int = 42,
                      rf_params: Mapping[str, Any] | None = None, id_col: str = "customer_id",
                      model_name: str = "RF Tuned") -> dict[str, Any]:
    """Train the forest on an exact stratified split and return the bundle:
    model, metrics, confusion matrix (% by row), importances, validation
    predictions.  Helper columns and the id are never features."""
    from pyspark import StorageLevel
    from .forests import fit_rows
    from .split import stratified_split
    # the split table is read once per tree level and by every output below:
    # keep it (memory, spilling to disk; recomputed from lineage if lost)
    flagged = stratified_split(df, target, id_col, test_size, seed=seed,
                               flag_col="__is_test").persist(StorageLevel.MEMORY_AND_DISK)
    train = flagged.where(F.col("__is_test") == 0).drop("__is_test")
    valid = spread(flagged.where(F.col("__is_test") == 1).drop("__is_test"))
    prep, forest = fit_rows(train, dict(dims.DEFAULT_RF_PARAMS, **(rf_params or {})), target, id_col)
    model = PipelineModel(stages=[*prep.stages, forest])
    preds = written(validation_predictions(model, valid, target))
    spark = df.sparkSession
    names = feature_names(prep.transform(valid.limit(0)))        # without the forest, which a transform ships to all executors
    importances = model.stages[-1].featureImportances.toArray()
    return {
        "model": model,
        "metrics_df": me.classification_metrics(preds, model_name=model_name),
        "cm_df": me.confusion_matrix(preds, normalize=True),
        "feature_importance_df": importance_table(spark, names, importances),
        "valid_predictions_df": preds,
        "data": flagged,
    }


def export_training_outputs(bundle: Mapping[str, Any], root: str, prefix: str = "rf_tuned") -> dict[str, str]:
    """SNK-3: model + four tables under ``root`` (overwrite)."""
    from ..sources.io import write_table
    paths = {"model_path": f"{root}/models/{prefix}_model"}
    bundle["model"].write().overwrite().save(paths["model_path"])
    for key, name in [("metrics_df", "metrics"), ("cm_df", "confusion_matrix_percentage"),
                      ("feature_importance_df", "feature_importance"),
                      ("valid_predictions_df", "validation_predictions")]:
        path = f"{root}/exports/{prefix}_{name}"
        write_table(bundle[key], path, fmt="parquet")
        paths[f"{name}_path"] = path
    return paths


def model_comparison(df: DataFrame, target: str = dims.TARGET, test_size: float = 0.2, seed: int = 42,
                     folds: int = 5, draws: Mapping[str, int] | None = None,
                     grids: Mapping[str, Mapping[str, Sequence[Any]]] | None = None,
                     id_col: str = "customer_id") -> dict[str, DataFrame]:
    """JOB-6: random search per model family on the training part, refit on
    the best draw, then on the exact hold-out: metrics per model (wide and
    long), AUC summary, ROC points and the best-parameter table.  ``draws`` and
    ``grids`` default to the original's; ``release(out)`` frees what is cached."""
    from .reshape import stack, to_long
    from .search import prepare_search
    from .split import stratified_split
    draws = dict(SEARCH_DRAWS, **(draws or {}))
    grids = dict(SEARCH_SPACES, **(grids or {}))
    data = df.withColumn(target, F.col(target).cast("double"))
    flagged = stratified_split(data, target, id_col, test_size, seed=seed, flag_col="__is_test").persist()
    train = flagged.where(F.col("__is_test") == 0).drop("__is_test")
    valid = spread(flagged.where(F.col("__is_test") == 1).drop("__is_test"))
    preds, params, models = [], [], {}
    shared = prepare_search(train, folds, seed, target, id_col)
    for family, n_draws in draws.items():
        best, _table, chosen = random_search(train, family, grids[family], n_draws, seed=seed, target=target,
                                             prepared=shared)
        preds.append(validation_predictions(best, valid, target).select(
            F.lit(family).alias("model"), "y_true", "y_pred", "p_churn"))
        params += [(family, k, str(v)) for k, v in sorted(chosen.items())]
        models[family] = best
    shared.release()
    all_preds = written(stack(preds))
    wide = me.compare_models(all_preds)
    return {
        "comparison": wide,
        "comparison_long": to_long(wide, ["model"], ["accuracy", "precision", "recall", "f1", "roc_auc"]),
        "auc_summary": wide.select("model", "roc_auc"),
        "roc_points": me.roc_curve(all_preds, group_cols=["model"]),
        "best_params": df.sparkSession.createDataFrame(params, "model string, param string, value string"),
        "predictions": all_preds,
        "data": flagged,
        "models": models,
    }


def release(bundle: Mapping[str, Any]) -> None:
    """Free the cached tables of a bundle; later use recomputes them."""
    if "data" in bundle:
        bundle["data"].unpersist()


def export_comparison(out: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """SNK-5: write the five tables of a model comparison."""
    from ..sources.io import write_table
    return {name: write_table(out[name], f"{root}/{name}")
            for name in ("comparison", "comparison_long", "auc_summary", "roc_points", "best_params")}


def select_model(out: Mapping[str, DataFrame], model: str) -> dict[str, DataFrame]:
    """ML-20: one model's metrics, predictions and confusion matrix (%)."""
    chosen = out["predictions"].where(F.col("model") == model)
    return {"metrics": out["comparison"].where(F.col("model") == model), "predictions": chosen,
            "confusion": me.confusion_matrix(chosen, normalize=True)}
