"""A small hold-out is scored by all cores."""

import numpy as np

from attrix.operators import ml


def test_small_hold_out_is_spread_before_scoring(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), "xyz"[i % 3], int(a + 0.5 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "customer_id long, a double, location string, churned int").coalesce(1)
    bundle = ml.train_final_model(df, rf_params={"n_estimators": 4})
    preds = bundle["valid_predictions_df"]
    assert preds.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert preds.count() == preds.select("customer_id").distinct().count() == 24
    assert {r.feature for r in bundle["feature_importance_df"].collect()} == {"num__a", *(f"cat__location_{v}" for v in "xyz")}
