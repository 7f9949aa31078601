"""Cross-validation folds prepared once (ML-5 for "all but fold k").

Imputation values, category levels and scaling of every training set "all rows
but fold k", and of the whole table, come from one set of passes over the table:
medians from one sketch and one band (:func:`.quantiles.leave_one_out_medians`),
modes, levels, means and deviations from the folds' totals subtracted from the
whole.  What comes to the driver is model metadata: a row per column and fold, and
per category level and fold.

The rows themselves are written once to the shared folder, as a *matrix* (numeric
values with NaN for missing, level codes with -1 for missing) that all models
read; a task turns it into the vectors of a training set with :class:`Design`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import leave_one_out_medians
from .split import stratified_folds

#: rows of a small table that one task should have
ROWS_PER_TASK = 50_000


@dataclass
class Design:
    """Numbers that turn matrix rows into the vectors of training set k (index -1: the whole table)."""
    fill: np.ndarray            # sets x numeric columns
    mean: np.ndarray
    std: np.ndarray
    mode: np.ndarray            # sets x text columns: level codes
    seen: np.ndarray            # sets x one-hot slots: the level occurs in the training set
    offsets: np.ndarray         # first slot of each text column, and the end

    @property
    def width(self) -> int:
        return self.fill.shape[1] + int(self.offsets[-1])

    def filled(self, k: int, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(np.isnan(x), self.fill[k], x), np.where(c < 0, self.mode[k], c)

    def vectors(self, k: int, x: np.ndarray, c: np.ndarray, scale: bool = True) -> np.ndarray:
        x, c = self.filled(k, x, c)
        if scale:
            x = (x - self.mean[k]) / self.std[k]
        slots = np.zeros((len(x), int(self.offsets[-1])))
        at = c + self.offsets[:-1]
        rows = np.repeat(np.arange(len(x)), c.shape[1])
        slots[rows, at.ravel()] = self.seen[k][at.ravel()]
        return np.concatenate([x, slots], axis=1)


@dataclass
class Prepared:
    spark: SparkSession
    folder: str
    target: str
    numeric: list[str]
    text: list[str]
    n_folds: int
    levels: list[list[str]]
    design: Design
    sizes: np.ndarray           # sets x (rows, positive rows)
    table: DataFrame            # fold, row, target and the feature columns; cached
    matrix: DataFrame           # fold, row, y, x, c

    def stages(self, k: int = -1, scale: bool = True) -> list:
        """Fitted preprocessing of training set k; nothing is read."""
        from .ml import preprocessing_stages
        d = self.design
        fills = {c: float(d.fill[k][i]) for i, c in enumerate(self.numeric)}
        fills |= {c: self.levels[j][int(d.mode[k][j])] for j, c in enumerate(self.text)}
        scaling = {c: (float(d.mean[k][i]), float(d.std[k][i])) for i, c in enumerate(self.numeric)} if scale else None
        stages = preprocessing_stages(self.numeric, self.text, fills, scaling)
        if self.text:
            # one model per column: arrays of labels of different lengths are padded with nulls on their way to the JVM
            labels = [[v for i, v in enumerate(self.levels[j]) if d.seen[k][d.offsets[j] + i]] for j in range(len(self.text))]
            stages[1:2] = [StringIndexerModel.from_labels(x, i, o, handleInvalid="keep") for x, i, o in
                           zip(labels, stages[1].getInputCols(), stages[1].getOutputCols(), strict=True)]
        return stages

    def preprocessing(self, k: int = -1, scale: bool = True) -> PipelineModel:
        return Pipeline(stages=self.stages(k, scale)).fit(self.table)

    def release(self) -> None:
        self.table.unpersist()


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written if it isn't there whole."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:                       # absent, or the writer was killed
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def prepare(train: DataFrame, numeric: Sequence[str], text: Sequence[str], target: str, id_col: str, folder: str,
            n_folds: int = 5, seed: int = 42) -> Prepared:
    """Folds of ``train``, and all that models need of each training set."""
    spark = train.sparkSession
    numeric, text = list(numeric), list(text)

    def table():
        folded = stratified_folds(train, target, id_col, n_folds, seed, fold_col="__fold")
        value = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in numeric]
        return folded.select(F.col("__fold").alias("fold"), F.col(id_col).cast("string").alias("row"),
                             F.col(target).cast("double").alias(target), *value,
                             *[F.col(f"`{c}`").cast("string").alias(c) for c in text])

    rows = kept(spark, f"{folder}/table", table)
    by_class = rows.groupBy("fold", F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    sets = [*range(n_folds), -1]
    sizes = np.array([[sum(r["n"] for r in by_class if r["fold"] != k),
                       sum(r["n"] for r in by_class if r["fold"] != k and r["y"] == 1)] for k in sets], float)

    # numbers
    long = rows.select("fold", *numeric).unpivot(["fold"], numeric, "column", "value") if numeric else None
    moments, medians = leave_one_out_medians(long, n_folds) if numeric else ([], None)
    median = {(r["column"], r["left_out"]): r["median"] for r in medians.collect()} if numeric else {}
    fill = np.array([[median.get((c, k), 0.0) for c in numeric] for k in sets]).reshape(len(sets), len(numeric))
    mean, std = np.zeros_like(fill), np.ones_like(fill)
    for s, k in enumerate(sets):
        for i, c in enumerate(numeric):
            parts = [(r["n"], r["mean"], r["m2"]) for r in moments if r["column"] == c and r["fold"] != k]
            parts.append((sizes[s, 0] - sum(p[0] for p in parts), fill[s, i], 0.0))       # the filled ones
            total = max(1.0, sum(p[0] for p in parts))
            m = sum(n * a for n, a, _ in parts) / total
            mean[s, i] = m
            std[s, i] = np.sqrt(sum(m2 + n * (a - m) ** 2 for n, a, m2 in parts) / total) or 1.0

    # texts: a row per level and fold
    counts = (rows.select("fold", *text).unpivot(["fold"], text, "column", "value").where(F.col("value").isNotNull())
              .groupBy("column", "fold", "value").agg(F.count(F.lit(1)).alias("n")).collect()) if text else []
    levels, modes, seen = [], np.zeros((len(sets), len(text)), int), []
    for j, c in enumerate(text):
        mine = [r for r in counts if r["column"] == c]
        totals = [{} for _ in sets]
        for s, k in enumerate(sets):
            for r in mine:
                if r["fold"] != k:
                    totals[s][r["value"]] = totals[s].get(r["value"], 0) + r["n"]
        names = [min(t, key=lambda v: (-t[v], v)) if t else "Unknown" for t in totals]
        level = sorted({r["value"] for r in mine} | {n for n, t in zip(names, totals, strict=True) if not t})
        levels.append(level)
        modes[:, j] = [level.index(n) for n in names]
        seen.append(np.array([[v in t or (v == n and not t) for v in level] for t, n in zip(totals, names, strict=True)]))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(int)
    slots = np.concatenate(seen, axis=1).astype(float) if seen else np.zeros((len(sets), 0))
    design = Design(fill, mean, std, modes, slots, offsets)

    parts = max(1, int(sizes[-1, 0] // ROWS_PER_TASK))
    codes = [F.coalesce(F.array_position(F.lit(level) if level else F.array().cast("array<string>"), F.col(f"`{c}`")).cast("int") - 1,
                        F.lit(-1)) for c, level in zip(text, levels, strict=True)]
    matrix = rows.select(
        "fold", "row", F.col(target).alias("y"),
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))) for c in numeric]).cast("array<double>").alias("x"),
        F.array(*codes).cast("array<int>").alias("c"))
    if parts < matrix.rdd.getNumPartitions():
        rows, matrix = rows.coalesce(parts), matrix.coalesce(parts)
    return Prepared(spark, folder, target, numeric, text, n_folds, levels, design, sizes, rows.persist(),
                    kept(spark, f"{folder}/matrix", lambda: matrix))


def arrays(batch, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """Values and codes of an Arrow batch or table of matrix rows."""
    def flat(name, width, kind):
        column = batch.column(name)
        chunks = column.chunks if hasattr(column, "chunks") else [column]
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
        return (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).reshape(-1, width)
    return flat("x", design.fill.shape[1], float), flat("c", design.mode.shape[1], int)
