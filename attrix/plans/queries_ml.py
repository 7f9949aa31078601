"""Registered ML queries: metric queries with oracle SQL (ML-12…16, 20, 21,
24, ML-1/2) and model queries checked by rows and invariants (ML-3…11,
17…19, 22, 23; JOB-5…7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import filters as fl
from ..operators import metrics as me
from ..operators import forests, ml, model_store, networks
from .catalog import register, round_doubles
from .fixtures import labelled_documents, scores, subscribers
from .queries_rest import _quota_sql
from .sqltext import with_ctes

_NUM = ["weekly_hours", "signup_date", "age"]
_TXT = ["customer_service_inquiries", "subscription_type", "location"]


def _mode_expr(c: str, src: str = "subscribers") -> str:
    return (f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, v ASC LIMIT 1)")


@register("ml_impute_median", with_ctes("SELECT customer_id, " + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM subscribers)), 6) "
    f"AS {c}" for c in _NUM) + " FROM subscribers"))
def ml_impute_median(spark, sf):
    df = subscribers(spark, sf)
    return round_doubles(ml.impute(df, numeric=_NUM).select("customer_id", *_NUM))


@register("ml_impute_mode", with_ctes("SELECT customer_id, " + ", ".join(
    f"coalesce({c}, {_mode_expr(c)}) AS {c}" for c in _TXT) + " FROM subscribers"))
def ml_impute_mode(spark, sf):
    df = subscribers(spark, sf)
    return ml.impute(df, categorical=_TXT).select("customer_id", *_TXT)


@register("ml_what_if_profile", with_ctes(
    "SELECT customer_id, subscription_type, round(weekly_hours, 6) AS weekly_hours, "
    "round((SELECT quantile_cont(song_skip_rate, 0.5) FROM subscribers), 6) AS song_skip_rate, "
    "round((SELECT quantile_cont(CAST(age AS DOUBLE), 0.5) FROM subscribers), 6) AS age, "
    f"{_mode_expr('customer_service_inquiries')} AS customer_service_inquiries "
    "FROM subscribers"))
def ml_what_if(spark, sf):
    """ML-21 in bulk: every customer becomes a partial profile (plan and
    hours given as they are) completed with the feature table's exact
    medians / modes for the fields not given."""
    feats = subscribers(spark, sf)
    profiles = feats.select(
        "customer_id", "subscription_type", "weekly_hours",
        F.lit(None).cast("double").alias("song_skip_rate"), F.lit(None).cast("long").alias("age"),
        F.lit(None).cast("string").alias("customer_service_inquiries"))
    filled = ml.impute(profiles, numeric=["song_skip_rate", "age"], categorical=["customer_service_inquiries"],
                       reference=feats)
    return round_doubles(filled)


_CNT = """
SELECT {g} count(*) AS n,
  sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn FROM {src} {gb}"""

_AUC = """
SELECT {g} sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS roc_auc FROM (
  SELECT *, sum(pos) OVER (PARTITION BY {p} ORDER BY s DESC) AS tp,
         sum(pos) OVER (PARTITION BY {p}) AS P, sum(neg) OVER (PARTITION BY {p}) AS N FROM (
    SELECT {g} p_churn AS s, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS neg FROM {src} GROUP BY {g} p_churn)) {gb}"""


def _metrics_sql(src: str, grouped: bool) -> str:
    g = "model," if grouped else ""
    gb = "GROUP BY model" if grouped else ""
    p = "model" if grouped else "1"
    cnt = _CNT.format(g=g, src=src, gb=gb)
    auc = _AUC.format(g=g, src=src, gb=gb, p=p)
    join = "JOIN a USING (model)" if grouped else ", a"
    return f"""
WITH c AS ({cnt}), a AS ({auc})
SELECT {g} round((tp + tn) * 1.0 / n, 6) AS accuracy,
  round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
  round(roc_auc, 6) AS roc_auc FROM c {join}"""


def _nested(sql_body: str, *ctes: str) -> str:
    return with_ctes(f"SELECT * FROM ({sql_body})", *ctes)


@register("ml_metrics", _nested(_metrics_sql("scores", False), "scores"))
def ml_metrics(spark, sf):
    return round_doubles(me.classification_metrics(scores(spark, sf)))


@register("ml_metrics_signal", _nested(_metrics_sql("signal_scores", False), "signal_scores"))
def ml_metrics_signal(spark, sf):
    return round_doubles(me.classification_metrics(scores(spark, sf, signal=True)))


@register("ml_compare", _nested(_metrics_sql("scores", True), "scores"))
def ml_compare(spark, sf):
    return round_doubles(me.compare_models(scores(spark, sf)))


@register("ml_select_model", with_ctes(
    f"SELECT * FROM ({_metrics_sql('scores', True)}) WHERE model = 'm1'", "scores"))
def ml_select(spark, sf):
    return fl.row_for(round_doubles(me.compare_models(scores(spark, sf))), "model", "m1")


@register("ml_auc", _nested(_AUC.format(g="model,", src="scores", gb="GROUP BY model", p="model")
                            .replace("sum(neg * (tp - pos / 2.0)) / (max(P) * max(N))",
                                     "round(sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)), 6)"), "scores"))
def ml_auc(spark, sf):
    return round_doubles(me.roc_auc(scores(spark, sf), group_cols=["model"]))


@register("ml_roc", with_ctes("""
SELECT model, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold FROM scores GROUP BY model
UNION ALL
SELECT model, round(coalesce(fp * 1.0 / nullif(N, 0), 0.0), 6), round(coalesce(tp * 1.0 / nullif(P, 0), 0.0), 6),
       round(s, 6) FROM (
  SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY s DESC) AS fp,
         sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM (
    SELECT model, p_churn AS s, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS neg FROM scores GROUP BY model, p_churn))""", "scores"))
def ml_roc(spark, sf):
    return round_doubles(me.roc_curve(scores(spark, sf), group_cols=["model"]))


@register("ml_confusion", with_ctes("""
SELECT CAST(l.label AS BIGINT) AS label,
  round(coalesce(coalesce(c.p0, 0) * 100.0 / nullif(coalesce(c.p0, 0) + coalesce(c.p1, 0), 0), 0), 6) AS pred_0,
  round(coalesce(coalesce(c.p1, 0) * 100.0 / nullif(coalesce(c.p0, 0) + coalesce(c.p1, 0), 0), 0), 6) AS pred_1
FROM (VALUES (0), (1)) l(label) LEFT JOIN (
  SELECT y_true, sum(CASE WHEN y_pred = 0 THEN 1 ELSE 0 END) AS p0, sum(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS p1
  FROM signal_scores GROUP BY y_true) c ON c.y_true = l.label""", "signal_scores"))
def ml_confusion(spark, sf):
    return round_doubles(me.confusion_matrix(scores(spark, sf, signal=True), normalize=True))


@register("ml_confusion_counts", with_ctes("""
SELECT model, CAST(y_true AS BIGINT) AS label, CAST(sum(CASE WHEN y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
  CAST(sum(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1 FROM scores GROUP BY model, y_true""", "scores"))
def ml_confusion_counts(spark, sf):
    return me.confusion_matrix(scores(spark, sf), normalize=False, group_cols=["model"])


@register("ml_class_weights", with_ctes("""
SELECT customer_id, churned, round((SELECT count(*) FROM subscribers) * 1.0 /
  (2 * count(*) OVER (PARTITION BY churned)), 6) AS weight FROM subscribers"""))
def ml_class_weights(spark, sf):
    return round_doubles(me.class_weights(subscribers(spark, sf).select("customer_id", "churned"), "churned"))


# -- model queries (rows-only checks; invariants in tests) ------------------------------------------------

def _model_ready(spark, sf):
    return subscribers(spark, sf).transform(fe.build_model_ready)


def _published(spark, name, df, make, *parts):
    """What ``make()`` gives (tables, models, cached tables to release), published once for these rows and
    parameters in the shared folder: any session reads it from there."""
    from ..operators.search import fingerprint
    from ..session import shared_path
    root, tag = shared_path(spark, "models", name), fingerprint(df, name, *parts)
    if model_store.latest(spark, root, tag) is None:
        tables, models, cached = make()
        model_store.publish(spark, root, tables, models, tag)
        for table in cached:
            table.unpersist()
    return model_store.load(spark, root, tag=tag)


def _bundle(spark, sf, n_trees: int = 300):
    df = _model_ready(spark, sf)

    def make():
        bundle = ml.train_final_model(df, rf_params={"n_estimators": n_trees})
        tables = ("metrics_df", "cm_df", "feature_importance_df", "valid_predictions_df")
        return {t: bundle[t] for t in tables}, {"forest": bundle["model"]}, [bundle["data"]]

    return _published(spark, "final_forest", df, make, n_trees).tables


@register("ml_rf_final_metrics")
def ml_rf_metrics(spark, sf):
    """ML-6 / JOB-5: the final forest (300 trees, depth 12, leaf 2, all features)."""
    return _bundle(spark, sf)["metrics_df"]


@register("ml_rf_confusion")
def ml_rf_confusion(spark, sf):
    return _bundle(spark, sf)["cm_df"]


@register("ml_rf_importances")
def ml_rf_importances(spark, sf):
    """ML-17."""
    return _bundle(spark, sf)["feature_importance_df"]


@register("ml_rf_validation_predictions")
def ml_rf_predictions(spark, sf):
    """ML-22 + ML-11."""
    return _bundle(spark, sf)["valid_predictions_df"]


@register("ml_logreg_coefficients")
def ml_logreg(spark, sf):
    """ML-4/5/7/18: scaled preprocessing + logistic regression coefficients."""
    from ..operators.split import split_frames
    df = _model_ready(spark, sf)
    train, _valid = split_frames(df, "churned", "customer_id", 0.2)
    nums, cats = ml.feature_columns(df)
    stages = ml.build_preprocessor(train, nums, cats, scale=True)
    n = train.count()
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[*stages, ml.logistic_regression(C=12.33, n_rows=n)]).fit(
        train.withColumn("churned", F.col("churned").cast("double")))
    names = ml.feature_names(model.transform(train.limit(0)))
    return ml.importance_table(spark, names, model.stages[-1].coefficients.toArray(), "coefficient")


@register("ml_decision_tree_metrics")
def ml_decision_tree(spark, sf):
    """ML-8: shallow tree, metrics on the exact hold-out."""
    from pyspark.ml import Pipeline
    from ..operators.split import split_frames
    df = _model_ready(spark, sf)
    train, valid = split_frames(df, "churned", "customer_id", 0.2)
    nums, cats = ml.feature_columns(df)
    model = Pipeline(stages=[*ml.build_preprocessor(train, nums, cats), ml.decision_tree(4)]).fit(
        train.withColumn("churned", F.col("churned").cast("double")))
    return me.classification_metrics(ml.validation_predictions(model, valid), model_name="Decision Tree")


@register("ml_dense_network_metrics")
def ml_dnn(spark, sf):
    """ML-9 (re-aimed as Spark's multilayer perceptron)."""
    from pyspark.ml import Pipeline, PipelineModel
    from ..operators.split import split_frames
    df = _model_ready(spark, sf)
    train, valid = split_frames(df, "churned", "customer_id", 0.2)
    nums, cats = ml.feature_columns(df)
    stages = ml.build_preprocessor(train, nums, cats, scale=True)
    prep = Pipeline(stages=stages).fit(train)
    width = len(ml.feature_names(prep.transform(train.limit(0))))
    x = prep.transform(train).select("features", F.col("churned").cast("double").alias("churned"))
    model = PipelineModel(stages=[*prep.stages, networks.fit(ml.dense_network(width, epochs=50), x)])
    return me.classification_metrics(ml.validation_predictions(model, valid), model_name="DNN")


def _search(spark, sf, family):
    """The table of a family's whole search: the operator's own draws and folds."""
    df = _model_ready(spark, sf).withColumn("churned", F.col("churned").cast("double"))
    _model, table, _best = ml.random_search(df, family)
    return table


@register("ml_random_search")
def ml_search(spark, sf):
    """ML-10: ten draws of C and class weight, AUC-scored on five stratified folds."""
    return _search(spark, sf, "Logistic Regression")


@register("ml_random_search_forest")
def ml_search_forest(spark, sf):
    """ML-10: twenty draws of the forest's space, five folds."""
    return _search(spark, sf, "Random Forest")


@register("ml_random_search_network")
def ml_search_network(spark, sf):
    """ML-10: ten draws of the perceptron's space, five folds."""
    return _search(spark, sf, "DNN")


_FOLDED = """
folded AS (SELECT *, (row_number() OVER (PARTITION BY churned ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id)
    - 1) % 5 AS fold FROM subscribers),
unions AS (SELECT u.left_out, f.* FROM folded f JOIN (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS left_out) u ON f.fold <> u.left_out)"""


def _prepared(spark, sf):
    """The subscribers' columns used here, prepared for five folds."""
    from ..operators.folds import prepare
    import uuid
    from ..session import shared_path
    return prepare(subscribers(spark, sf), _NUM, _TXT, "churned", "customer_id", shared_path(spark, "folds", uuid.uuid4().hex))


@register("ml_fold_scaling", with_ctes(" UNION ALL ".join(f"""
SELECT CAST(left_out AS INTEGER) AS left_out, '{c}' AS "column", round(m, 6) AS median, round(avg(coalesce({c}, m)), 6) AS mean,
       round(stddev_pop(coalesce({c}, m)), 6) AS deviation
FROM unions JOIN (SELECT left_out, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m FROM unions GROUP BY 1) USING (left_out)
GROUP BY left_out, m""" for c in _NUM), _FOLDED))
def ml_fold_scaling(spark, sf):
    """ML-1/3/5: median, mean and deviation of every training set "all but one fold" (-1: all), prepared together."""
    p = _prepared(spark, sf)
    d = p.design
    p.release()
    rows = [(k, c, float(d.fill[k][i]), float(d.mean[k][i]), float(d.std[k][i]))
            for k in range(-1, p.n_folds) for i, c in enumerate(p.numeric)]
    return round_doubles(spark.createDataFrame(rows, "left_out int, column string, median double, mean double, deviation double"))


@register("ml_fold_levels", with_ctes(" UNION ALL ".join(f"""
SELECT CAST(left_out AS INTEGER) AS left_out, '{c}' AS "column", arg_min(v, (-n, v)) AS mode, count(*) AS n_levels
FROM (SELECT left_out, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM unions WHERE {c} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
                                                      for c in _TXT), _FOLDED))
def ml_fold_levels(spark, sf):
    """ML-2/4/5: most frequent value and number of categories of every training set, prepared together."""
    p = _prepared(spark, sf)
    d = p.design
    p.release()
    rows = [(k, c, p.levels[j][int(d.mode[k][j])], int(d.seen[k][d.offsets[j]:d.offsets[j + 1]].sum()))
            for k in range(-1, p.n_folds) for j, c in enumerate(p.text)]
    return spark.createDataFrame(rows, "left_out int, column string, mode string, n_levels long")


@register("ml_vector_totals", with_ctes(" UNION ALL ".join(
    [f"""SELECT 'num__{c}' AS feature, round(sum(coalesce({c}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM subscribers))), 6) AS total
FROM subscribers""" for c in _NUM] +
    [f"SELECT 'cat__{c}_' || coalesce({c}, {_mode_expr(c)}), CAST(count(*) AS DOUBLE) FROM subscribers GROUP BY 1" for c in _TXT])))
def ml_vector_totals(spark, sf):
    """ML-3/4/5: names of the assembled vector's slots and their sums over all customers (of a one-hot slot: the level's rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = subscribers(spark, sf)
    scored = Pipeline(stages=ml.build_preprocessor(df, _NUM, _TXT)).fit(df).transform(df)
    names = F.array(*[F.lit(n) for n in ml.feature_names(scored)])
    slots = scored.select(F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("v"))).alias("s"))
    return round_doubles(slots.groupBy("s.feature").agg(F.sum("s.v").alias("total")))


@register("ml_training_history")
def ml_history(spark, sf):
    """ML-23: objective per iteration of a logistic regression."""
    from pyspark.ml import Pipeline
    df = _model_ready(spark, sf).withColumn("churned", F.col("churned").cast("double"))
    nums, cats = ml.feature_columns(df)
    model = Pipeline(stages=[*ml.build_preprocessor(df, nums, cats, scale=True),
                             ml.logistic_regression(C=1.0, n_rows=df.count())]).fit(df)
    return ml.training_history(spark, model.stages[-1].summary.objectiveHistory)


@register("ml_network_history")
def ml_network_history(spark, sf):
    """ML-9 / ML-23: loss and AUC of the network per epoch on the training and the hold-out part, with early stopping."""
    from pyspark.ml import Pipeline
    from ..operators.split import split_frames
    df = _model_ready(spark, sf).withColumn("churned", F.col("churned").cast("double"))
    train, valid = split_frames(df, "churned", "customer_id", 0.2)
    nums, cats = ml.feature_columns(df)
    prep = Pipeline(stages=ml.build_preprocessor(train, nums, cats, scale=True)).fit(train)
    cut = [prep.transform(x).select("features", "churned") for x in (train, valid)]
    _model, history = ml.fit_network(*cut, len(ml.feature_names(cut[0].limit(0))), hidden=(64, 32), epochs=30)
    return history


@register("ml_documents_quality")
def ml_documents(spark, sf):
    """ML on a second real binary target: document quality from length,
    language and source (small, unbalanced)."""
    from pyspark.ml import Pipeline
    docs = labelled_documents(spark, sf).withColumnRenamed("doc_id", "customer_id")
    docs = docs.select("customer_id", "n_chars", "lang", "source", F.col("quality").cast("double").alias("churned"))
    nums, cats = ["n_chars"], ["lang", "source"]
    from ..operators.split import split_frames
    train, valid = split_frames(docs, "churned", "customer_id", 0.2)
    model = Pipeline(stages=[*ml.build_preprocessor(train, nums, cats),
                             ml.random_forest({"max_depth": 5})]).fit(train)
    return me.classification_metrics(ml.validation_predictions(model, valid), model_name="RF quality")


@register("ml_best_params_parse")
def ml_params(spark, sf):
    """ML-19: the winning draws of the whole comparison, exported as wide CSV and read back
    with types (tuple text -> int array, 'None' -> NULL, '12.0' -> 12)."""
    import uuid
    from ..session import shared_path
    best = _comparison(spark, sf)["best_params"]
    return model_store.read_params(spark, model_store.export_params(best, shared_path(spark, "params", uuid.uuid4().hex)))


_PART = "SELECT CAST(1 + customer_id % 2 AS BIGINT) AS version, * FROM scores"


@register("ml_store_versions", with_ctes(
    "SELECT version, model, count(*) AS n_rows, CAST(sum(y_true) AS BIGINT) AS positives, "
    "round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy "
    f"FROM ({_PART}) GROUP BY version, model", "scores"))
def ml_versions(spark, sf):
    """ML-20 / SNK-3: results of the models over two halves of the customers, published as two
    versions, with files of a third that was never committed; every model is picked from both."""
    import uuid
    from functools import reduce
    from ..session import shared_path
    root = shared_path(spark, "models", "versions", uuid.uuid4().hex)
    preds = scores(spark, sf)
    for half in (0, 1):
        rows = preds.where(F.col("customer_id") % 2 == half)
        model_store.publish(spark, root, {"comparison": me.compare_models(rows), "predictions": rows})
    preds.write.parquet(f"{root}/data/{uuid.uuid4().hex}/tables/predictions")
    out = []
    for version in (1, 2):
        tables = model_store.load(spark, root, version, verify=True).tables
        sizes = tables["predictions"].groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"),
                                                            F.sum("y_true").cast("long").alias("positives"))
        out.append(tables["comparison"].select("model", "accuracy").join(sizes, "model")
                   .select(F.lit(version).cast("long").alias("version"), "model", "n_rows", "positives", "accuracy"))
    return round_doubles(reduce(lambda a, b: a.unionByName(b), out))


@register("job_7_scoring_log")
def job_7(spark, sf):
    """JOB-7: score the aligned incoming table with a forest trained on the
    base, classify risk, add provenance (append-ready log records)."""
    from pyspark.ml import PipelineModel
    from ..functions import dims
    from .jobs import incoming_prediction_ready_job, scoring_log_job
    from .queries_prj import incoming
    base = _model_ready(spark, sf).withColumn("churned", F.col("churned").cast("double"))

    def make():
        # as Spark's forest, which has no minimum split size
        prep, forest = forests.fit_rows(base, dict(dims.DEFAULT_RF_PARAMS, min_samples_split=None), "churned", "customer_id")
        return {}, {"forest": PipelineModel(stages=[*prep.stages, forest])}, []

    model = _published(spark, "scoring", base, make).model("forest")
    aligned = incoming_prediction_ready_job(incoming(spark, sf), subscribers(spark, sf))
    return scoring_log_job(model, aligned, "incoming", "RF Tuned").select(
        "customer_id", "p_churn", "risk_level", "source", "model_used")


@register("st_retrain_batches", with_ctes("""
SELECT 'b' || k AS name, 'trained' AS status, count(*) FILTER (WHERE in_base OR r = k) AS n_rows,
       count(*) FILTER (WHERE r = k) AS n_new,
       round(avg(churned * 1.0) FILTER (WHERE in_base OR r = k), 6) AS churn_rate
FROM (SELECT customer_id % 10 AS r, customer_id % 10 NOT IN (1, 2) AS in_base, churned FROM subscribers)
     CROSS JOIN (SELECT unnest([1, 2]) AS k)
GROUP BY k
UNION ALL SELECT 'b0', 'skipped: empty', 0, 0, NULL"""))
def st_retrain(spark, sf):
    """ST-1..4 / JOB-5: three labelled batches of several part files (one
    without rows) cut from the subscribers land in a fresh folder under the
    shared checkpoint directory; an available-now stream retrains the final
    forest once per batch on the base and the whole batch, and logs it."""
    import uuid
    from ..session import shared_path
    from ..sources.io import read_data, save_batch
    from ..streaming.retrain import start_retraining
    run = shared_path(spark, "st-retrain", uuid.uuid4().hex)
    raw = subscribers(spark, sf)
    k = F.col("customer_id")
    base = raw.where(~(k % 10).isin(1, 2))
    for name, cond in {"b0": F.lit(False), "b1": k % 10 == 1, "b2": k % 10 == 2}.items():
        save_batch(raw.where(cond).repartition(4), f"{run}/batches", batch_name=name)
    q = start_retraining(spark, f"{run}/batches", raw.schema, base, f"{run}/out", f"{run}/ckpt", log_path=f"{run}/log")
    q.awaitTermination()
    return round_doubles(read_data(spark, f"{run}/log", fmt="parquet").drop("batch"))


def _comparison(spark, sf):
    """The tables of one model comparison per input: every family with its whole search, 5
    folds, 20, 10 and 10 draws, up to 400 trees; published once, then read."""
    df = _model_ready(spark, sf)

    def make():
        out = ml.model_comparison(df)
        return *model_store.comparison_parts(out), [out["data"]]

    return _published(spark, "comparison", df, make).tables


@register("job_6_feature_weights")
def job_6_weights(spark, sf):
    """ML-17 / ML-18: coefficients and importances of the compared models, as published."""
    return round_doubles(_comparison(spark, sf)["weights"])


@register("job_6_model_comparison")
def job_6(spark, sf):
    """JOB-6 / ML-16: searched forest, logistic regression and perceptron,
    compared on the exact hold-out."""
    return _comparison(spark, sf)["comparison"]


@register("job_6_comparison_long")
def job_6_long(spark, sf):
    return _comparison(spark, sf)["comparison_long"]


@register("job_6_auc_summary")
def job_6_auc(spark, sf):
    return _comparison(spark, sf)["auc_summary"]


@register("job_6_roc_points")
def job_6_roc(spark, sf):
    return _comparison(spark, sf)["roc_points"]


@register("job_6_best_params")
def job_6_params(spark, sf):
    """The chosen draws, written and read back (SNK-5, ML-19)."""
    return _comparison(spark, sf)["best_params"]


@register("job_7_log_appended_once", with_ctes(
    "SELECT customer_id, round(p_churn, 6) AS p_churn, CASE WHEN customer_id % 3 = 0 THEN 'late' ELSE 'incoming' END AS source "
    "FROM scores WHERE model = 'm1'", "scores"))
def job_7_append(spark, sf):
    """JOB-7 / SET-2: scored records in two batches, the first appended twice and one attempt
    left uncommitted; the log holds every record once."""
    import uuid
    from ..session import shared_path
    from ..sources.io import append_once, read_log
    log = shared_path(spark, "log", uuid.uuid4().hex)
    records = scores(spark, sf).where(F.col("model") == "m1").select("customer_id", "p_churn")
    late = F.col("customer_id") % 3 == 0
    first = records.where(~late).withColumn("source", F.lit("incoming"))
    for _ in range(2):
        append_once(first, log, "batch-1")
    first.write.parquet(f"{log}/data/attempt=b-batch-9.{uuid.uuid4().hex}")
    append_once(records.where(late).withColumn("source", F.lit("late")), log, "batch-2")
    return round_doubles(read_log(spark, log, first.schema).select("customer_id", "p_churn", "source"))


_HOLD_OUT = _quota_sql("subscribers", "churned", "CAST(ceil(sum(ns) * 0.2) AS BIGINT)")


@register("ml_holdout_rows", with_ctes(
    "SELECT customer_id, CAST(churned AS BIGINT) AS y_true FROM r JOIN q USING (st) WHERE rn <= quota", _HOLD_OUT))
def ml_holdout(spark, sf):
    """The deterministic part of ML-22: which rows are scored, and their truth."""
    return _bundle(spark, sf)["valid_predictions_df"].select("customer_id", "y_true")


@register("ml_confusion_totals", with_ctes(
    "SELECT label, CAST(CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END AS DOUBLE) AS total FROM (SELECT l AS label, "
    "(SELECT count(*) FROM r JOIN q USING (st) WHERE rn <= quota AND churned = l) AS n FROM (SELECT unnest([0, 1]) AS l))",
    _HOLD_OUT))
def ml_confusion_totals(spark, sf):
    """The deterministic part of the forest's confusion matrix: each row sums to 100 %."""
    return round_doubles(_bundle(spark, sf)["cm_df"].select("label", (F.col("pred_0") + F.col("pred_1")).alias("total")))


@register("ml_model_selection", with_ctes(
    "SELECT 'Logistic Regression' AS model, count(*) AS n_rows, CAST(sum(churned) AS BIGINT) AS positives "
    "FROM r JOIN q USING (st) WHERE rn <= quota", _HOLD_OUT))
def ml_selection(spark, sf):
    """ML-20: the predictions of one chosen model."""
    chosen = ml.select_model(_comparison(spark, sf), "Logistic Regression")["predictions"]
    return chosen.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").alias("positives"))


@register("job_7_scoring_records", with_ctes(
    "SELECT customer_id, 'incoming' AS source, 'RF Tuned' AS model_used FROM subscribers"))
def job_7_records(spark, sf):
    """The deterministic part of JOB-7: one record per incoming customer, with provenance."""
    return job_7(spark, sf).select("customer_id", "source", "model_used")


@register("ml_decision_tree_importances")
def ml_tree_importances(spark, sf):
    """ML-8: importances of the shallow tree."""
    from pyspark.ml import Pipeline
    from ..operators.split import split_frames
    df = _model_ready(spark, sf)
    train, _valid = split_frames(df, "churned", "customer_id", 0.2)
    nums, cats = ml.feature_columns(df)
    model = Pipeline(stages=[*ml.build_preprocessor(train, nums, cats), ml.decision_tree(4)]).fit(
        train.withColumn("churned", F.col("churned").cast("double")))
    names = ml.feature_names(model.transform(train.limit(0)))
    return ml.importance_table(spark, names, model.stages[-1].featureImportances.toArray())


@register("ml_roc_drop_intermediate", with_ctes("""
SELECT model, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold FROM scores GROUP BY model
UNION ALL
SELECT model, round(coalesce(fp * 1.0 / nullif(N, 0), 0.0), 6), round(coalesce(tp * 1.0 / nullif(P, 0), 0.0), 6),
       round(s, 6) FROM (
  SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn FROM (
    SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC) AS tp,
           sum(neg) OVER (PARTITION BY model ORDER BY s DESC) AS fp,
           sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM (
      SELECT model, round(p_churn * 20) / 20 AS s, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS neg FROM scores GROUP BY 1, 2))
  WINDOW w AS (PARTITION BY model ORDER BY s DESC))
WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg""", "scores"))
def ml_roc_drop(spark, sf):
    """ML-14 with collinear points dropped; scores coarsened to 0.05 steps so
    that many neighbouring groups are collinear."""
    s = scores(spark, sf).withColumn("p_churn", F.round(F.col("p_churn") * 20) / 20)
    return round_doubles(me.roc_curve(s, group_cols=["model"], n_buckets=7, drop_intermediate=True))
