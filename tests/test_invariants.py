"""Invariants of splits, folds, samples, metrics and quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.operators import metrics as me
from attrix.operators import split as sp
from attrix.operators.quantiles import exact_quantiles
from attrix.plans.fixtures import scores, subscribers

from .conftest import SF_MID


@pytest.fixture(scope="module")
def subs(spark):
    return subscribers(spark, SF_MID).cache()


def test_split_sizes_exact(subs):
    flagged = sp.stratified_split(subs, "churned", "customer_id", 0.2, seed=42)
    n = subs.count()
    test = flagged.where("is_test = 1")
    assert test.count() == int(np.ceil(n * 0.2))
    by = {r.churned: r.c for r in test.groupBy("churned").agg(F.count("*").alias("c")).collect()}
    tot = {r.churned: r.c for r in subs.groupBy("churned").agg(F.count("*").alias("c")).collect()}
    for k in tot:
        assert abs(by[k] - tot[k] * 0.2) <= 1


def test_split_reproducible_and_seed_sensitive(subs):
    a = {r.customer_id for r in sp.split_frames(subs, "churned", "customer_id", 0.2, seed=1)[1].collect()}
    b = {r.customer_id for r in sp.split_frames(subs, "churned", "customer_id", 0.2, seed=1)[1].collect()}
    c = {r.customer_id for r in sp.split_frames(subs, "churned", "customer_id", 0.2, seed=2)[1].collect()}
    assert a == b and a != c


def test_folds_disjoint_and_balanced(subs):
    f = sp.stratified_folds(subs, "churned", "customer_id", 5)
    sizes = [r.c for r in f.groupBy("fold").agg(F.count("*").alias("c")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    assert f.select("customer_id").distinct().count() == subs.count()


def test_sample_sizes(subs):
    n = subs.count()
    assert sp.sample_rows(subs, 0, "customer_id").count() == 0
    assert sp.sample_rows(subs, n + 10, "customer_id").count() == n
    assert sp.sample_rows(subs, 17, "customer_id").count() == 17


def test_pool_too_small(spark):
    small = spark.createDataFrame([(i, i % 2) for i in range(10)], "customer_id long, churned int")
    with pytest.raises(ValueError):
        sp.reserve_pool(small, "churned", "customer_id", 10)


def test_auc_extremes(spark):
    equal = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)], "y_true int, p_churn double")
    assert me.roc_auc(equal).first().roc_auc == 0.5
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y_true int, p_churn double")
    assert me.roc_auc(perfect).first().roc_auc == 1.0


def test_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.random(500), 2)              # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, p_churn double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(me.roc_auc(df, n_buckets=7).first().roc_auc - want) < 1e-12
    # concentrated scores with far outliers, continuous, more buckets than scores
    s2 = np.r_[rng.random(480) * 1e-6, 1e9, -1e9, rng.normal(size=18)]
    df2 = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s2)], "y_true int, p_churn double")
    p2, n2 = s2[y == 1], s2[y == 0]
    want2 = ((p2[:, None] > n2[None, :]).sum() + 0.5 * (p2[:, None] == n2[None, :]).sum()) / (len(p2) * len(n2))
    for n in (2, 16, 1024):
        assert abs(me.roc_auc(df2, n_buckets=n).first().roc_auc - want2) < 1e-12


def test_auc_rejects_missing_scores_and_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), (None, 0, 0.8), (None, 1, 0.3)],
                               "model string, y_true int, p_churn double")
    got = {r["model"]: r["roc_auc"] for r in me.classification_metrics(
        df.withColumn("y_pred", F.lit(1)), group_cols=["model"]).collect()}
    assert got == {"a": 1.0, None: 0.0}
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="NULL or NaN"):
            me.roc_auc(spark.createDataFrame([(0, 0.1), (1, bad)], "y_true int, p_churn double")).collect()


def test_confusion_of_an_absent_class_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y_true int, y_pred int")
    assert [tuple(r) for r in me.confusion_matrix(df).collect()] == [(0, 50.0, 50.0), (1, 0.0, 0.0)]


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (0, 0, 0.1)], "y_true int, y_pred int, p_churn double")
    m = me.classification_metrics(df).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and m.recall == 0.0


def test_roc_monotone(spark):
    roc = me.roc_curve(scores(spark, SF_MID), group_cols=["model"]).toPandas()
    for _, g in roc.groupby("model"):
        g = g.sort_values("threshold", ascending=False)
        assert g.fpr.is_monotonic_increasing and g.tpr.is_monotonic_increasing
        assert g.fpr.iloc[-1] == 1.0 and g.tpr.iloc[-1] == 1.0


def test_confusion_rows_sum_to_100(spark):
    cm = me.confusion_matrix(scores(spark, SF_MID, signal=True)).collect()
    assert [r.label for r in cm] == [0, 1]
    for r in cm:
        assert abs(r.pred_0 + r.pred_1 - 100.0) < 1e-9


@pytest.mark.parametrize("skewed,accuracy", [(False, 100), (True, 100), (True, 50), (False, 5000)])
def test_exact_quantiles_vs_numpy(spark, skewed, accuracy):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < (0.9 if skewed else 0.5), "hot", "cold")
    v = np.round(rng.exponential(3.0, 4000), 1)          # duplicates
    v[:7] = np.nan if skewed else v[:7]                  # NaN is ignored like NULL
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, v)], "g string, v double")
    out = {r.g: r for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"], accuracy=accuracy).collect()}
    for key in ("hot", "cold"):
        vals = v[(g == key) & ~np.isnan(v)]
        want = np.quantile(vals, [0.0, 0.25, 0.5, 0.9, 1.0])
        got = [out[key][f"q{i}"] for i in range(5)]
        assert np.allclose(got, want, rtol=0, atol=1e-9)


@pytest.mark.parametrize("accuracy,sub_buckets", [(100, 8), (50, 1), (5000, 16)])
def test_exact_quantiles_sub_buckets_vs_numpy(spark, accuracy, sub_buckets):
    # band_rows_per_task=0 forces the second level (ranking inside slices)
    rng = np.random.default_rng(7)
    g = np.where(rng.random(5000) < 0.85, "hot", "cold")
    v = np.round(rng.normal(0.0, 5.0, 5000), 2)
    v[:5] = [np.inf, -np.inf, np.inf, 3.0, -np.inf]
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, v)], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    out = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy,
                                           band_rows_per_task=0, sub_buckets=sub_buckets).collect()}
    glob = exact_quantiles(df.where("abs(v) < double('inf')"), "v", probs,
                           accuracy=accuracy, band_rows_per_task=0, sub_buckets=sub_buckets).first()
    fin = np.isfinite(v)
    want_glob = np.quantile(v[fin], probs)
    assert np.allclose([glob[f"q{i}"] for i in range(len(probs))], want_glob, rtol=0, atol=1e-9)
    for key in ("hot", "cold"):
        vals = np.sort(v[g == key])
        for i, p in enumerate(probs):
            pos = (len(vals) - 1) * p
            a, b = vals[int(np.floor(pos))], vals[int(np.ceil(pos))]
            if a != b and not (np.isfinite(a) and np.isfinite(b)):
                continue                       # interpolating into an infinity
            want = a if a == b else a + (pos - np.floor(pos)) * (b - a)
            got = out[key][f"q{i}"]
            assert got == want or abs(got - want) < 1e-9, (key, p, got, want)


def test_roc_drop_intermediate_vs_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 10) / 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, p_churn double")
    got = me.roc_curve(df, n_buckets=3, drop_intermediate=True).toPandas()
    thr = np.sort(np.unique(s))[::-1]
    tps = np.array([((s >= t) & (y == 1)).sum() for t in thr])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in thr])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    want = sorted([(0.0, 0.0)] + [(fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep])
    assert sorted(zip(got.fpr.round(12), got.tpr.round(12))) == [(round(a, 12), round(b, 12)) for a, b in want]


def test_split_exact_with_a_hot_stratum(spark):
    # one label holds ~90 % of the rows (hot key); quotas and folds stay exact
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "customer_id long, churned int")
    flagged = sp.stratified_split(df, "churned", "customer_id", 0.25, seed=9)
    per = {r.churned: r.c for r in flagged.where("is_test = 1").groupBy("churned")
           .agg(F.count("*").alias("c")).collect()}
    assert per == {0: 1125, 1: 125}
    folds = sp.stratified_folds(df, "churned", "customer_id", 4, seed=9)
    sizes = sorted(r.c for r in folds.where("churned = 0").groupBy("fold").agg(F.count("*").alias("c")).collect())
    assert sizes == [1125, 1125, 1125, 1125]


def test_rank_does_not_depend_on_the_prefix(spark):
    # ranks follow (hash key, id), whatever the number of buckets
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "customer_id long, churned int")
    base = {(r.customer_id, r["__rank"]) for r in
            sp.ranked_within_strata(df, "customer_id", 5, "churned").collect()}
    grown = {(r.customer_id, r["__rank"]) for r in
             sp.ranked_within_strata(df, "customer_id", 5, "churned", prefix_len=1).collect()}
    assert grown == base and len(base) == 3000
    ranks = sorted(r for _, r in base)
    assert ranks == sorted(list(range(1, 2701)) + list(range(1, 301)))
