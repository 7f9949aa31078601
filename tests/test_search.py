"""Searches that share their work give what separate fits give."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrix.operators import folds, forests, logistic, ml, quantiles, search

NUMERIC, TEXT = ["a", "b", "k"], ["t", "u"]


@pytest.fixture(scope="module")
def train(spark):
    """Two informative numbers with missing values and NaN, a small count, two texts with a rare level."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(320):
        a, b = rng.normal(), rng.normal()
        y = int(a - 0.7 * b + 0.8 * rng.normal() > 0)
        rows.append((i, None if i % 11 == 0 else float(a), float("nan") if i % 13 == 0 else float(b) * 100, float(i % 4),
                     None if i % 17 == 0 else "xyz"[i % 3], "rare" if i == 5 else "often" if y and i % 2 else "seldom", float(y)))
    return spark.createDataFrame(rows, "id long, a double, b double, k double, t string, u string, y double").repartition(3).cache()


@pytest.fixture(scope="module")
def prepared(train, tmp_path_factory):
    return folds.prepare(train, NUMERIC, TEXT, "y", "id", f"file://{tmp_path_factory.mktemp('folds')}", 4, 7)


def separate(train, prepared, k):
    """Preprocessing learned from the training rows of a fold alone."""
    rows = train.join(prepared.table.select(F.col("row").cast("long").alias("id"), "fold"), "id")
    fit_on, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
    return Pipeline(stages=ml.build_preprocessor(fit_on, NUMERIC, TEXT, scale=True)).fit(fit_on), fit_on, held


@pytest.mark.parametrize("k", [0, 1, -1])
def test_shared_preprocessing_equals_separate(train, prepared, k):
    prep, fit_on, held = separate(train, prepared, k)
    mine = prepared.preprocessing(k)
    for rows in (fit_on, held):
        want = {r.id: r.features.toArray() for r in prep.transform(rows).select("id", "features").collect()}
        got = {r.id: r.features.toArray() for r in mine.transform(rows).select("id", "features").collect()}
        assert want.keys() == got.keys()
        for i in want:
            assert got[i] == pytest.approx(want[i], abs=1e-9)
    assert ml.feature_names(prep.transform(held)) == ml.feature_names(mine.transform(held))


def test_leave_one_out_medians(spark):
    rng = np.random.default_rng(1)
    values = {c: [(int(f), float(v)) for f, v in zip(rng.integers(0, 3, n), rng.choice([1.0, 2.0, 2.0, 7.5, -3.0, 1e18], n))]
              for c, n in (("p", 41), ("q", 400), ("r", 2))}
    rows = [(c, f, v) for c, x in values.items() for f, v in x] + [("p", 0, None), ("p", 1, float("nan")), ("empty", 0, None)]
    long = spark.createDataFrame(rows, "column string, fold int, value double")
    for accuracy in (10_000, 20):                    # all in the band; narrow bands
        _, out = quantiles.leave_one_out_medians(long, 3, accuracy)
        got = {(r.column, r.left_out): r.median for r in out.collect()}
        want = {(c, k): np.median(left) for c, x in values.items() for k in range(-1, 3)
                if (left := [v for f, v in x if f != k])}
        assert got == want


def test_many_logistic_fits_equal_separate(train, prepared):
    tasks = [logistic.LogisticTask(i, k, c, bal) for i, (c, bal) in enumerate([(0.01, False), (1.0, True), (50.0, False)])
             for k in (0, 3, -1)]
    weights = logistic.fit_many(prepared, tasks)
    for t, w in zip(tasks, weights, strict=True):
        prep, fit_on, _ = separate(train, prepared, t.fold)
        n, positive = prepared.sizes[t.fold]
        weight = F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))) if t.balanced else F.lit(1.0)
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (t.C * n), standardization=False, maxIter=500,
                                   tol=1e-12).fit(prep.transform(fit_on).withColumn("w", weight))
        kept = np.append(np.ones(len(NUMERIC)), prepared.design.seen[t.fold]) > 0
        assert w[:-1][kept] == pytest.approx(model.coefficients.toArray(), abs=2e-4)
        assert not w[:-1][~kept].any()
        assert w[-1] == pytest.approx(model.intercept, abs=2e-4)


def test_search_equals_a_plain_loop(train, tmp_path):
    """Two draws, three folds: each AUC is that of a fit of its own."""
    shared = folds.prepare(train, NUMERIC, TEXT, "y", "id", f"file://{tmp_path}", 3, 7)
    draws = [{"C": 0.05, "class_weight": None}, {"C": 5.0, "class_weight": "balanced"}]
    got = search.search_scores(shared, "Logistic Regression", draws, "y")
    evaluator = BinaryClassificationEvaluator(labelCol="y", numBins=0)
    for d, auc in zip(draws, got, strict=True):
        want = []
        for k in range(3):
            prep, fit_on, held = separate(train, shared, k)
            n, positive = shared.sizes[k]
            x = prep.transform(fit_on).withColumn(ml.BALANCED_COL, F.when(F.col("y") == 1, n / (2 * positive))
                                                  .otherwise(n / (2 * (n - positive))))
            want.append(evaluator.evaluate(ml.classifier("Logistic Regression", d, int(n), 0, "y").fit(x).transform(prep.transform(held))))
        assert auc == pytest.approx(np.mean(want), abs=2e-3)
    # the score table answers a second search; what is missing from it is fitted
    table = search.ScoreTable(shared)
    assert len(table.done("Logistic Regression")) == 6
    found = []
    original = logistic.fit_many
    try:
        logistic.fit_many = lambda p, tasks: found.extend(tasks) or original(p, tasks)
        assert search.search_scores(shared, "Logistic Regression", draws, "y") == got
        search.search_scores(shared, "Logistic Regression", [*draws, {"C": 0.5, "class_weight": None}], "y")
    finally:
        logistic.fit_many = original
    assert [(t.draw, t.fold) for t in found] == [(2, 0), (2, 1), (2, 2)]


PARAMS = {"n_estimators": 60, "max_depth": 6, "min_samples_leaf": 3, "min_samples_split": 12, "max_features": "sqrt",
          "class_weight": "balanced"}


def test_small_forest_is_a_spark_model(spark, train, prepared, tmp_path):
    """The model grown in tasks scores rows as its trees did; its nodes keep the limits."""
    model = forests.fit_small(prepared, PARAMS, seed=5)
    assert model.getNumTrees == 60 and model.numFeatures == prepared.design.width
    nodes = forests.node_table(model)
    inner = nodes.where("leftChild >= 0")
    assert inner.agg(F.min("rawCount")).first()[0] >= 12
    assert nodes.where("leftChild < 0").agg(F.min("rawCount")).first()[0] >= 3
    scored = model.transform(prepared.preprocessing(scale=False).transform(prepared.table))
    got = {r.row: r.p for r in scored.select("row", vector_to_array("probability")[1].alias("p")).collect()}
    # the same trees, asked for the rows in the task
    whole = prepared.matrix.toPandas().sort_values("row", key=lambda s: s.map(lambda x: x.encode()))
    x, c, y = np.stack(whole.x), np.stack(whole.c).astype(int), whole.y.to_numpy()
    b = forests._Binned(prepared.design, -1, x, c, np.ones(len(y), bool))
    p = np.mean([(n["positive"] / n["weight"])[leaf] for _, n, leaf in
                 forests._forest(b, y, forests._weights(prepared, -1, PARAMS), np.ones(len(y), bool), PARAMS, 0, 60, 5)], axis=0)
    assert got.keys() == set(whole.row)
    assert [got[r] for r in whole.row] == pytest.approx(p, abs=1e-12)
    path = f"file://{tmp_path}/m"
    model.write().save(path)
    assert type(model).load(path).getNumTrees == 60
    assert model.featureImportances.toArray()[:2].sum() > 0.4


def test_cross_validated_forests(prepared):
    """Every row is scored once a draw, by forests that did not see it; about as well as Spark's forest."""
    plain = PARAMS | {"class_weight": None, "max_features": None, "max_depth": None, "min_samples_split": 2}
    out = forests.cross_validated(prepared, [(0, PARAMS), (4, plain)], seed=5)
    rows = out.collect()
    assert sorted({(r.draw, r.fold) for r in rows}) == [(d, k) for d in (0, 4) for k in range(4)]
    assert len({(r.draw, r.row) for r in rows}) == len(rows) == 2 * 320
    auc = search._by_group(out)
    evaluator = BinaryClassificationEvaluator(labelCol="y", numBins=0)
    for k in range(2):
        prep = prepared.preprocessing(k, scale=False)
        model = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=15, minInstancesPerNode=3, seed=1,
                                       featureSubsetStrategy="all").fit(prep.transform(prepared.table.where(F.col("fold") != k)))
        theirs = evaluator.evaluate(model.transform(prep.transform(prepared.table.where(F.col("fold") == k))))
        assert auc[4, k] == pytest.approx(theirs, abs=0.05) and auc[0, k] > 0.7


def brute_split(b, y, w, leaf, split):
    """Best (impurity after, cell) of the root by trying every cut."""
    rows = np.flatnonzero(w > 0)
    best = None
    for cell in range(b.total):
        if not b.allowed[cell]:
            continue
        v = b.cells[rows, b.column[cell]]
        left = v <= cell if cell < b.numeric_cells else v == cell
        if min(left.sum(), (~left).sum()) < leaf:
            continue
        cost = 0.0
        for side in (left, ~left):
            t, p = w[rows][side].sum(), (w * y)[rows][side].sum()
            cost += p * (t - p) / t
        if best is None or cost < best[0] - 1e-12:
            best = (cost, cell)
    return best


def test_grown_splits_equal_brute_force(prepared):
    whole = prepared.matrix.toPandas()
    x, c, y = np.stack(whole.x), np.stack(whole.c).astype(int), whole.y.to_numpy()
    for seed in range(4):
        rng = np.random.default_rng(seed)
        b = forests._Binned(prepared.design, -1, x, c, np.ones(len(y), bool))
        w = rng.integers(0, 3, len(y)).astype(float)
        nodes, leaf = forests.grow(b, y, w, rng, 1, 4, 2, b.width)
        cost, cell = brute_split(b, y, w, 4, 2)
        after = sum(p * (t - p) / t for t, p in zip(nodes["weight"][1:], nodes["positive"][1:]))
        assert after == pytest.approx(cost)
        assert set(leaf) == {1, 2} and nodes["rows"][0] == (w > 0).sum()


@pytest.mark.parametrize("kind", [RandomForestClassifier, DecisionTreeClassifier])
def test_min_split(train, prepared, kind):
    """No inner node below the limit; a row's node is the first on its way with too few rows."""
    x = prepared.preprocessing(scale=False).transform(prepared.table)
    kw = {"numTrees": 5} if kind is RandomForestClassifier else {}
    model = kind(labelCol="y", maxDepth=8, seed=3, **kw).fit(x)
    least = 40
    cut = forests.with_min_split(model, least)
    before, after = forests.node_table(model), forests.node_table(cut)
    assert before.where(f"leftChild >= 0 and rawCount < {least}").count() > 0
    assert after.where(f"leftChild >= 0 and rawCount < {least}").count() == 0
    whole = {(r.treeID, r.id): r for r in before.collect()}

    def walk(tree, features):
        r = whole[tree, 0]
        while r.leftChild >= 0 and r.rawCount >= least:
            v, values = features[r.split.featureIndex], r.split.leftCategoriesOrThreshold
            left = v <= values[0] if r.split.numCategories < 0 else v in values
            r = whole[tree, r.leftChild if left else r.rightChild]
        return r.impurityStats[1] / sum(r.impurityStats)

    trees = sorted({t for t, _ in whole})
    for r in cut.transform(x).select("features", "probability").collect():
        assert r.probability[1] == pytest.approx(np.mean([walk(t, r.features.toArray()) for t in trees]), abs=1e-9)
    assert forests.with_min_split(model, 2) is model


def test_network_fits_run_beside_each_other_and_resume(train, tmp_path):
    shared = folds.prepare(train, NUMERIC, TEXT, "y", "id", f"file://{tmp_path}", 2, 7)
    draws = [{"hidden": (4,), "batch_size": 32, "epochs": 15}, {"hidden": (5, 3), "batch_size": 32, "epochs": 10}]
    first = search.search_scores(shared, "DNN", draws[:1], "y")
    ran = []
    original = search._spark_fits
    try:
        search._spark_fits = lambda p, f, todo, *more: ran.extend(todo) or original(p, f, todo, *more)
        both = search.search_scores(shared, "DNN", draws, "y")
    finally:
        search._spark_fits = original
    assert both[0] == first[0] > 0.6 and [(i, k) for i, _, k in ran] == [(1, 0), (1, 1)]


def test_networks_of_other_layers_run_beside_each_other(train, tmp_path, monkeypatch):
    """their passes came one after the other."""
    import threading
    shared = folds.prepare(train, NUMERIC, TEXT, "y", "id", f"file://{tmp_path}", 2, 7)
    both, fit = threading.Barrier(2, timeout=60), search.networks.fit_many
    monkeypatch.setattr(search.networks, "fit_many", lambda *a: both.wait() >= 0 and fit(*a))
    draws = [{"hidden": (4,), "batch_size": 32, "epochs": 3}, {"hidden": (5, 3), "batch_size": 32, "epochs": 3}]
    assert len(search.search_scores(shared, "DNN", draws, "y")) == 2


def test_random_search_end_to_end(train):
    train = train.withColumnsRenamed({"t": "location", "u": "region"})
    for family, grid in (("Logistic Regression", {"C": [0.1, 1.0], "class_weight": [None]}),
                         ("Random Forest", {"n_estimators": [20], "max_depth": [4, None], "min_samples_split": [2, 30]}),
                         ("DNN", {"hidden": [(4,)], "batch_size": [32], "epochs": [10]})):
        shared = search.prepare_search(train.withColumnRenamed("id", "customer_id"), 3, 42, "y")
        model, table, best = ml.random_search(train, family, grid, 2, folds=3, target="y", prepared=shared)
        rows = table.collect()
        assert all(0.6 < r.mean_auc <= 1.0 for r in rows) and rows[0].params == str(best)
        scored = ml.score(model, train)
        assert BinaryClassificationEvaluator(labelCol="y").evaluate(scored) > 0.7
        assert scored.count() == 320
