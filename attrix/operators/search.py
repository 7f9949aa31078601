"""Random search with cross-validation (ML-10) and model comparison (JOB-6).

Folds are prepared once for all families (:mod:`.folds`).  Logistic draws are fitted
together (:mod:`.logistic`); forests by tasks over a small table (:mod:`.forests`) or
by Spark's forest; networks by shared passes (:mod:`.networks`).  Every
finished (family, draw, fold) is a row of a score table in the shared folder, which is
read first: a search that was killed goes on where it was, and a search over the same
rows with the same draws repeats nothing.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..session import shared_path
from . import forests, logistic, networks
from . import metrics as me
from .folds import Prepared, prepare

SCORES = "family string, draw int, params string, fold int, auc double"
#: Spark fits that run beside each other, at least
PARALLEL = 8


def fingerprint(df: DataFrame, *parts: Any) -> str:
    """Key of a search: its rows (one pass) and parameters."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*cols)), F.sum(F.xxhash64(F.lit(7), *cols) % 1_000_003)).first()
    return hashlib.sha256(repr((sorted(df.columns), tuple(row), parts)).encode()).hexdigest()[:24]


class ScoreTable:
    """Finished (family, draw, fold) with their AUC; appends are whole or absent."""

    def __init__(self, prepared: Prepared):
        self.spark, self.path, self.lock = prepared.spark, f"{prepared.folder}/scores", threading.Lock()

    def done(self, family: str) -> dict[tuple[str, int], float]:
        from ..sources.io import read_optional
        rows = read_optional(self.spark, self.path, SCORES).where(F.col("family") == family)
        return {(r["params"], r["fold"]): r["auc"] for r in rows.collect()}        # a row per draw and fold

    def add(self, rows: list[tuple]) -> None:
        with self.lock:
            self.spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(self.path)


def prepare_search(train: DataFrame, folds: int = 5, seed: int = 42, target: str = dims.TARGET, id_col: str = "customer_id",
                   folder: str | None = None) -> Prepared:
    """Folds, preprocessing and matrix that the families share.  The folder is named by
    the rows and the split, so a repeated search finds its tables and scores."""
    from .ml import feature_columns
    nums, cats = feature_columns(train, target)
    used = train.select(*dict.fromkeys([*nums, *cats, target, id_col]))
    folder = folder or shared_path(train.sparkSession, "search", fingerprint(used, nums, cats, target, id_col, folds, seed))
    return prepare(used, nums, cats, target, id_col, folder, folds, seed)


def _by_group(scored: DataFrame) -> dict[tuple[int, int], float]:
    """Exact AUC of each (draw, fold)."""
    rows = me.roc_auc(scored, "y", "p", ["draw", "fold"]).collect()                # a row per draw and fold
    return {(r["draw"], r["fold"]): r["roc_auc"] for r in rows}


def _network_fits(prepared: Prepared, todo: list[tuple[int, Mapping, int]], target: str, table: ScoreTable, fixed: Mapping) -> None:
    """Networks in shared passes, those of the same hidden layers together; what is finished is kept.
    A pass over few rows is short, so the passes of different layers run beside each other."""
    from .ml import classifier
    width = {k: len(prepared.numeric) + int(prepared.design.seen[k].sum()) for _, _, k in todo}
    fits = [(i, d, k, classifier("DNN", d, int(prepared.sizes[k][0]), width[k], target, **fixed)) for i, d, k in todo]
    blocks = networks.fold_blocks(prepared, sorted(width), sorted({n.getBlockSize() for *_, n in fits}))

    def one(hidden: tuple[int, ...]) -> None:
        part = [f for f in fits if tuple(f[3].getLayers()[1:]) == hidden]
        weights = networks.fit_many(blocks, [(k, n) for _, _, k, n in part])
        auc = _by_group(networks.scores(prepared, [(i, k, n.getLayers()) for i, _, k, n in part], weights))
        table.add([("DNN", i, str(dict(d)), k, auc.get((i, k))) for i, d, k, _ in part])

    try:
        with ThreadPoolExecutor(PARALLEL) as pool:
            layers = dict.fromkeys(tuple(n.getLayers()[1:]) for *_, n in fits)
            for f in as_completed([pool.submit(inheritable_thread_target(prepared.spark)(one), h) for h in layers]):
                f.result()
    finally:
        blocks.release()


def _spark_fits(prepared: Prepared, family: str, todo: list[tuple[int, Mapping, int]], target: str, table: ScoreTable,
                fixed: Mapping) -> None:
    """Fits by Spark's own classifiers, one for each core (``PARALLEL`` at least) at a time; each is recorded when it ends.
    Networks are Spark's too, but share their passes."""
    from .ml import BALANCED_COL, classifier
    if family == "DNN":
        return _network_fits(prepared, todo, target, table, fixed)
    evaluator = BinaryClassificationEvaluator(labelCol=target, metricName="areaUnderROC", numBins=0)
    data = {}
    for k in sorted({k for _, _, k in todo}):
        prep = prepared.preprocessing(k, scale=family != "Random Forest")
        cols = ["features", target]
        x = prep.transform(prepared.table.where(F.col("fold") != k)).select(*cols)
        n, positive = prepared.sizes[k]
        weight = F.when(F.col(target) == 1, n / (2 * max(1.0, positive))).otherwise(n / (2 * max(1.0, n - positive)))
        width = len(prepared.numeric) + int(prepared.design.seen[k].sum())
        data[k] = (x.withColumn(BALANCED_COL, weight).persist(),
                   prep.transform(prepared.table.where(F.col("fold") == k)).select(*cols).persist(), int(n), width)

    def one(draw: int, params: Mapping, k: int) -> tuple:
        x, y, n, width = data[k]
        p = dict(params)
        least = p.pop("min_samples_split", None)
        model = classifier(family, p, n, width, target, **fixed).fit(x)
        if family == "Random Forest":
            model = forests.with_min_split(model, least)
        return family, draw, str(dict(params)), k, float(evaluator.evaluate(model.transform(y)))

    try:
        # fits of a small table keep one core each busy
        with ThreadPoolExecutor(max(PARALLEL, prepared.spark.sparkContext.defaultParallelism)) as pool:
            futures = [pool.submit(inheritable_thread_target(prepared.spark)(one), *t) for t in todo]
            held = []
            for f in as_completed(futures):
                held.append(f.result())
                if len(held) >= PARALLEL:
                    table.add(held)
                    held = []
            if held:
                table.add(held)
    finally:
        for x, y, _, _ in data.values():
            x.unpersist()
            y.unpersist()


def search_scores(prepared: Prepared, family: str, draws: Sequence[Mapping[str, Any]], target: str, seed: int = 42,
                  **fixed) -> list[float]:
    """Mean AUC of each draw over the folds; what the score table holds is not fitted again."""
    table = ScoreTable(prepared)
    done = table.done(family)
    todo = [(i, d, k) for i, d in enumerate(draws) for k in range(prepared.n_folds) if (str(dict(d)), k) not in done]
    if family == "Logistic Regression" and not fixed and logistic.fits_the_driver(prepared, len(todo)):
        if todo:
            tasks = [logistic.LogisticTask(i, k, d["C"], d.get("class_weight") == "balanced") for i, d, k in todo]
            auc = _by_group(logistic.scores(prepared, tasks, logistic.fit_many(prepared, tasks)))
            table.add([(family, i, str(dict(d)), k, auc.get((i, k))) for i, d, k in todo])
    elif family == "Random Forest" and not fixed and forests.fits_a_task(prepared):
        # a few draws at a time, those that share trees together: what is finished is kept
        open_draws = sorted({i for i, _, _ in todo}, key=lambda i: (forests.family_of(draws[i]), i))
        for first in range(0, len(open_draws), 10):
            part = open_draws[first:first + 10]
            auc = _by_group(forests.cross_validated(prepared, [(i, draws[i]) for i in part], seed))
            table.add([(family, i, str(dict(d)), k, auc.get((i, k))) for i, d, k in todo if i in part])
    elif todo:
        _spark_fits(prepared, family, todo, target, table, fixed)
    done = table.done(family)
    return [sum(done[str(dict(d)), k] or 0.0 for k in range(prepared.n_folds)) / prepared.n_folds for d in draws]


def refit(prepared: Prepared, family: str, params: Mapping[str, Any], target: str, seed: int = 42, **fixed) -> PipelineModel:
    """The family's model on the whole training table with one draw, as a pipeline that scores raw rows."""
    from .ml import BALANCED_COL, classifier
    scale = family != "Random Forest"
    prep = prepared.preprocessing(scale=scale)
    n, positive = prepared.sizes[-1]
    if not scale and not fixed and forests.fits_a_task(prepared):
        return PipelineModel(stages=[*prep.stages, forests.fit_small(prepared, params, seed)])
    p = dict(params)
    if family == "DNN":
        network = classifier(family, p, int(n), prepared.design.width, target, **fixed)
        blocks = networks.fold_blocks(prepared, [-1], [network.getBlockSize()])
        try:
            weights = networks.fit_many(blocks, [(-1, network)])[0]
        finally:
            blocks.release()
        return PipelineModel(stages=[*prep.stages, networks.as_model(prepared.spark, network, weights)])
    least = p.pop("min_samples_split", None)
    weight = F.when(F.col(target) == 1, n / (2 * max(1.0, positive))).otherwise(n / (2 * max(1.0, n - positive)))
    x = prep.transform(prepared.table).select("features", target, weight.alias(BALANCED_COL)).persist()
    model = classifier(family, p, int(n), prepared.design.width, target, **fixed).fit(x)
    x.unpersist()
    if family == "Random Forest":
        model = forests.with_min_split(model, least)
    return PipelineModel(stages=[*prep.stages, model])
