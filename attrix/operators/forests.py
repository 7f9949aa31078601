"""Forests: node tables, minimum split size, and many forests over one small table.

* :func:`with_min_split` (ML-6, ML-8): Spark's trees have no minimum number of rows
  for a split.  The fitted model's node table (one row per node, as models are
  saved) is read, every node below a node with fewer rows is dropped, and the model
  is loaded again from the smaller table.
* :func:`cross_validated` (ML-10): a search fits hundreds of forests on one training
  table.  Where that table, as histogram cells of a byte, is small enough for one task
  (checked: ``MAX_CELLS``), Spark deals out (draw, fold, run of trees) tasks instead of rows:
  each grows its trees level by level on histograms of the whole training set and
  returns the summed leaf probabilities of the fold's rows.  The cells are worked out before,
  in blocks of rows (:func:`_blocks`, :func:`_cuts`), and only they are copied.  Draws that have the same trees but for
  where they end share them (:func:`family_of`).  Larger tables are
  fitted by Spark's own forest, several at a time (see :mod:`.search`).
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassificationModel, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .folds import Design, Prepared, arrays, kept

#: rows x columns of a training table that a task may hold, a byte each (two where a column has over 256 cells)
MAX_CELLS = 128_000_000
#: rows of a block, and least rows of a partition of blocks
BLOCK, PART_ROWS = 8192, 32_768
MAX_BINS = 32
TREES_PER_TASK = 50
#: copies of a small table that are dealt out, for each core
GROUPS_PER_CORE = 3
MAX_DEPTH = 30
#: nodes of a forest that the driver and every scoring task may hold as Spark's objects, some 150 bytes each
MODEL_NODES = 250_000

_LEAF = "named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', cast(array() as array<double>), 'numCategories', -1)"


# -- minimum split size ------------------------------------------------------------------------

def node_table(model) -> DataFrame:
    """The saved node table of a fitted tree or forest: ``treeID`` and the node's fields."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "trees", uuid.uuid4().hex)
    model.write().save(path)
    return _nodes(spark.read.parquet(f"{path}/data"))


def _nodes(data: DataFrame) -> DataFrame:
    return data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data.select(F.lit(0).alias("treeID"), "*")


def collapsed(nodes: DataFrame, least: int) -> DataFrame:
    """The node table without the nodes below a node of fewer than ``least`` rows.

    A node has at least as many rows as those below it, so a node stays if its
    parent has enough.  Node numbers are their places in depth-first order, which
    the ones that stay keep."""
    parents = (nodes.where((F.col("leftChild") >= 0) & (F.col("rawCount") >= least))
               .select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id")))
    left = nodes.where("id = 0").unionByName(nodes.join(parents, ["treeID", "id"]).select(nodes.columns))
    # as many rows as the tree has nodes: model metadata
    numbered = left.withColumn("new", F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1)
    right = numbered.select("treeID", F.col("id").alias("rightChild"), F.col("new").alias("newRight"))
    inner = (F.col("leftChild") >= 0) & (F.col("rawCount") >= least)
    kept = numbered.join(right, ["treeID", "rightChild"], "left")
    return kept.select(
        "treeID", F.col("new").cast("int").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
        F.when(inner, F.col("gain")).otherwise(-1.0).alias("gain"),
        F.when(inner, F.col("new") + 1).otherwise(-1).cast("int").alias("leftChild"),
        F.when(inner, F.col("newRight")).otherwise(-1).cast("int").alias("rightChild"),
        F.when(inner, F.col("split")).otherwise(F.expr(_LEAF)).alias("split"))


_FIELDS = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"]


def with_min_split(model, least: int | None):
    """``model`` (a fitted tree or forest) with no split of a node of fewer than ``least`` rows."""
    if not least or least <= 2:
        return model
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "trees", uuid.uuid4().hex)
    model.write().save(f"{path}/whole")
    data = spark.read.parquet(f"{path}/whole/data")
    nodes = collapsed(_nodes(data), least)
    ensemble = "nodeData" in data.columns
    nodes = nodes.select("treeID", F.struct(*_FIELDS).alias("nodeData")) if ensemble else nodes.select(*_FIELDS)
    nodes.write.parquet(f"{path}/cut/data")
    spark.read.text(f"{path}/whole/metadata").coalesce(1).write.text(f"{path}/cut/metadata")
    if ensemble:
        spark.read.parquet(f"{path}/whole/treesMetadata").write.parquet(f"{path}/cut/treesMetadata")
        return RandomForestClassificationModel.load(f"{path}/cut")
    return DecisionTreeClassificationModel.load(f"{path}/cut")


# -- a forest as its node table ----------------------------------------------------------------------

class _ForestWriter(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        spark = self.forest.spark
        spark.read.parquet(f"{self.forest.path}/data").write.parquet(f"{path}/data")
        spark.read.parquet(f"{self.forest.path}/treesMetadata").write.parquet(f"{path}/treesMetadata")
        about = self.forest.about | {"class": f"{GrownForest.__module__}.{GrownForest.__name__}", "uid": self.forest.uid}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")


class _ForestReader(MLReader):
    def load(self, path: str) -> GrownForest:
        return GrownForest(SparkSession.getActiveSession(), path)


class GrownForest(Model, MLWritable, MLReadable):
    """A saved forest that scores from its node table.

    Spark's model of a few million nodes fills a driver of a gigabyte, and every task that scores gets a
    copy.  Here nodes are 28 bytes each; Python workers read them from a broadcast, and columns,
    importances and files are those of Spark's model (:meth:`as_spark` loads it)."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path, self._nodes = spark, path, None
        self.about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        self._resetUid(self.about["uid"])
        self.getNumTrees, self.numFeatures, self.numClasses = (int(self.about[k]) for k in ("numTrees", "numFeatures", "numClasses"))

    def getMaxDepth(self) -> int:
        return int(self.about["paramMap"]["maxDepth"])

    def table(self) -> DataFrame:
        return _nodes(self.spark.read.parquet(f"{self.path}/data"))

    def as_spark(self) -> RandomForestClassificationModel:
        path = shared_path(self.spark, "trees", uuid.uuid4().hex)
        _ForestWriter(self).save(path)
        about = json.dumps(self.about | {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel"})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        return RandomForestClassificationModel.load(path)

    @property
    def featureImportances(self) -> DenseVector:
        """As Spark's: of each tree the gains times rows of its splits, their sum 1, added up, the sum again 1."""
        gain = F.sum(F.col("gain") * (F.col("impurityStats")[0] + F.col("impurityStats")[1]))
        rows = (self.table().where("leftChild >= 0").groupBy("treeID", F.col("split.featureIndex").alias("slot"))
                .agg(gain.alias("gain")).collect())                  # a row per tree and slot
        total, each = np.zeros(self.numFeatures), {}
        for r in rows:
            each[r["treeID"]] = each.get(r["treeID"], 0.0) + r["gain"]
        for r in sorted(rows, key=lambda r: (r["treeID"], r["slot"])):
            if each[r["treeID"]]:
                total[r["slot"]] += r["gain"] / each[r["treeID"]]
        return DenseVector(total / total.sum() if total.sum() else total)

    def nodes(self):
        """Broadcast (first node of each tree, slot, cut, left, right, share of class 1); a leaf leads to itself."""
        if self._nodes is None:
            cut = F.coalesce(F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)), F.lit(0.0))
            found = (self.table().select("treeID", "id", F.col("split.featureIndex").alias("slot"), cut.alias("cut"), "leftChild", "rightChild",
                                         (F.col("impurityStats")[1] / (F.col("impurityStats")[0] + F.col("impurityStats")[1])).alias("share"))
                     .toArrow())
            found = found.take(pa.array(np.lexsort((found.column("id").to_numpy(), found.column("treeID").to_numpy()))))
            tree, own = found.column("treeID").to_numpy(), np.arange(found.num_rows, dtype=np.int32)
            first = np.flatnonzero(np.diff(tree, prepend=-1)).astype(np.int32)
            start = np.repeat(first, np.diff([*first, len(tree)]))
            slot, left, right = (found.column(c).to_numpy() for c in ("slot", "leftChild", "rightChild"))
            leaf = left < 0
            self._nodes = self.spark.sparkContext.broadcast((
                first, np.where(leaf, 0, slot).astype(np.int32), found.column("cut").to_numpy(),
                np.where(leaf, own, left + start).astype(np.int32), np.where(leaf, own, right + start).astype(np.int32),
                found.column("share").to_numpy()))
        return self._nodes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, width, depth = self.nodes(), self.numFeatures, self.getMaxDepth()

        def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            first, slot, cut, left, right, share = held.value
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * width
                total = np.zeros(len(x))
                for root in first:
                    at = np.full(len(x), root, np.int32)
                    for _ in range(depth):
                        down = np.where(flat[base + slot[at]] <= cut[at], left[at], right[at])
                        if np.array_equal(down, at):
                            break
                        at = down
                    total += share[at]
                yield pa.array(total)

        vote = F.arrow_udf(votes, "double")
        n = float(self.getNumTrees)
        raw = F.array(F.lit(n) - F.col("__votes"), F.col("__votes"))
        columns = dataset.columns
        return (dataset.withColumn("__votes", vote(vector_to_array("features")))
                .select(*[F.col(f"`{c}`") for c in columns], array_to_vector(raw).alias("rawPrediction"),
                        array_to_vector(F.transform(raw, lambda v: v / n)).alias("probability"),
                        (F.col("__votes") > n / 2).cast("double").alias("prediction")))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


# -- growing trees inside a task -------------------------------------------------------------------

def _thresholds(x: np.ndarray) -> np.ndarray:
    """Cuts between the values of a column's training rows: between all, or into MAX_BINS bins of about as many rows."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) > MAX_BINS:
        place = np.searchsorted(np.cumsum(counts), np.arange(1, MAX_BINS) * counts.sum() / MAX_BINS)
        lower = np.unique(place[place < len(values) - 1])
    else:
        lower = np.arange(len(values) - 1)
    a, b = values[lower], values[lower + 1] if len(lower) else values[:0]
    middle = a + (b - a) / 2
    return np.where(middle < b, middle, a)


def _kind(widths: Sequence[int]) -> type:
    """Few bytes that hold the codes of columns of so many cells."""
    most = max(widths, default=0)
    return np.uint8 if most <= 1 << 8 else np.int16 if most < 1 << 15 else np.int32


def _codes(design: Design, k: int, x: np.ndarray, c: np.ndarray, thresholds: Sequence[np.ndarray], kind: type) -> np.ndarray:
    """A row per column: a table row's cell, counted from the column's first."""
    x, c = design.filled(k, x, c)
    out = np.empty((x.shape[1] + c.shape[1], len(x)), kind)
    for i, cut in enumerate(thresholds):
        out[i] = np.searchsorted(cut, x[:, i], side="left")
    out[x.shape[1]:] = c.T
    return out


class _Binned:
    """The rows of a task as histogram cells: numbers in at most MAX_BINS bins, texts by level."""

    def __init__(self, design: Design, k: int, x: np.ndarray, c: np.ndarray, train: np.ndarray):
        filled, _ = design.filled(k, x, c)
        thresholds = [_thresholds(filled[train, i]) for i in range(x.shape[1])]
        self._laid_out(design, k, thresholds)
        self.codes = _codes(design, k, x, c, thresholds, _kind(self.widths))

    @classmethod
    def of(cls, design: Design, k: int, thresholds: Sequence[np.ndarray], codes: np.ndarray) -> _Binned:
        """From cuts and codes that were worked out before."""
        out = cls.__new__(cls)
        out._laid_out(design, k, thresholds)
        out.codes = codes
        return out

    def _laid_out(self, design: Design, k: int, thresholds: Sequence[np.ndarray]) -> None:
        self.thresholds = list(thresholds)
        n_numeric, levels = len(self.thresholds), np.diff(design.offsets).astype(int)
        self.widths = [*(len(t) + 1 for t in self.thresholds), *levels.tolist()]
        ends = np.cumsum(self.widths).astype(int)
        at = int(ends[-1]) if len(ends) else 0
        self.numeric_cells = int(sum(self.widths[:n_numeric]))
        feature = [np.repeat(np.arange(n_numeric), self.widths[:n_numeric])] if n_numeric else []
        self.total = at
        #: vector slot that a cut after (numbers) or at (levels) a cell looks at, and its column
        self.feature = np.concatenate([*feature, n_numeric + np.arange(at - self.numeric_cells)]).astype(int)
        self.column = np.repeat(np.arange(len(self.widths)), self.widths)
        self.start = (ends - self.widths).astype(int) if len(ends) else ends
        self.width = design.width
        self.allowed = np.ones(at, bool)
        self.allowed[self.numeric_cells:] = design.seen[k] > 0
        self.allowed[np.append(self.start[1:], at)[:n_numeric].astype(int) - 1] = False      # nothing lies above a last bin
        #: of every cell
        self.cut = np.concatenate([*[np.append(t, np.nan) for t in self.thresholds], np.full(at - self.numeric_cells, 0.5)])

    @property
    def cells(self) -> np.ndarray:
        return self.codes.T + self.start


def _subset(max_features, width: int) -> int:
    if max_features in (None, 1.0):
        return width
    if max_features == "sqrt":
        return max(1, int(np.sqrt(width)))
    if max_features == "log2":
        return max(1, int(np.log2(width)))
    return max(1, min(width, int(max_features * width if isinstance(max_features, float) else max_features)))


def _packing(n_rows: int) -> tuple[list[list[int]], int]:
    """How the three sums of a cell (rows, weight of class 0, weight of class 1) are held in
    floats: sums below ``2 ** bits`` as digits of one number, or of two where rows are many."""
    return ([[0, 1, 2]], 17) if n_rows < 1 << 17 else ([[0, 1], [2]], 26)


def grow(b: _Binned, y: np.ndarray, w: np.ndarray, rng, max_depth: int, min_leaf: int, min_split: int, subset: int,
         class_weight: tuple[float, float] = (1.0, 1.0), scored: np.ndarray | None = None,
         by_depth: dict[int, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One tree on the rows of positive weight; ``w`` is how often the bootstrap drew each
    row, and a row counts that often times its class's weight.  Returns the nodes (breadth first)
    and the leaf of every row in ``scored`` (default: of all).  ``by_depth`` is given those rows'
    leaves at each depth: the leaves of the tree that ends there, which has the same nodes down to it.

    A cell's sums are whole numbers, added as digits of one float (exact below 2 ** 53).  Of
    two siblings the one with fewer rows is counted, a column at a time, the other is the parent
    less that.  Impurities are worked out where a cut leaves enough rows on both sides only."""
    n_columns, total, numeric = len(b.codes), b.total, b.numeric_cells
    groups, bits = _packing(int(w.sum()) + 1)
    mask = (1 << bits) - 1
    scored = np.arange(len(y)) if scored is None else scored
    drawn = np.flatnonzero(w > 0)
    codes = np.take(b.codes, drawn, axis=1)                          # in memory a column after the other
    live = np.arange(len(drawn))
    held_code, held_key = np.empty(len(live), codes.dtype), np.empty(len(live), np.int64)
    one, times = y[drawn] == 1, w[drawn]
    digits = (np.ones(len(live)), np.where(one, 0.0, times), np.where(one, times, 0.0))
    packed = [sum(digits[d] * float(1 << bits * i) for i, d in enumerate(g)) for g in groups]
    columns = list(zip(b.start, [*b.start[1:], total], strict=True))
    nodes: dict[str, list] = {name: [] for name in ("cell", "left", "weight", "positive", "rows", "gain")}
    first, here = 0, 1
    local = np.zeros(len(live), np.int64)                            # node of a live row, in this level
    at, moving = np.zeros(len(scored), np.int64), np.arange(len(scored))
    parents = None                                                   # histograms of the last level's nodes that split
    for depth in range(max_depth + 1):
        if by_depth is not None:
            by_depth[depth] = at.copy()
        tc = np.bincount(local, minlength=here)
        t0, t1 = np.bincount(local, digits[1][live], here), np.bincount(local, digits[2][live], here)
        tp = t1 * class_weight[1]
        tw = t0 * class_weight[0] + tp
        best, gain = np.full(here, -1), np.zeros(here)
        able = (tc >= max(2, min_split, 2 * min_leaf)) & (tp > 1e-12) & (tw - tp > 1e-12)
        raw = None
        if depth < max_depth and able.any() and n_columns:
            m = int(able.sum())
            if parents is None:
                counted = np.ones(1, bool)
            else:
                pair = able.reshape(-1, 2).any(axis=1)               # siblings lie beside each other
                counted = np.zeros(here, bool)
                smaller = 2 * np.arange(here // 2) + (tc[1::2] < tc[::2])
                counted[smaller[pair]] = True
            number = np.cumsum(counted) - 1
            n_counted = int(counted.sum())
            rows = np.flatnonzero(counted[local])
            node, rows = number[local[rows]], live[rows]
            values = [v[rows] for v in packed]
            sums = [np.empty((n_counted, total), np.int64) for _ in packed]
            code, key = held_code[:len(rows)], held_key[:len(rows)]
            base = {n: node * n for n in {end - start for start, end in columns}}
            for j, (start, end) in enumerate(columns):
                np.take(codes[j], rows, out=code, mode="clip")
                np.add(base[end - start], code, out=key)
                for s, v in zip(sums, values, strict=True):
                    s[:, start:end] = np.bincount(key, v, n_counted * (end - start)).reshape(n_counted, -1)
            if parents is None:
                raw = sums
            else:
                which = np.flatnonzero(able)
                mine = counted[which]
                of = number[smaller[which // 2]]                     # the counted one of a node's pair
                raw = []
                for s, whole in zip(sums, parents, strict=True):
                    h = s[of]
                    h[~mine] = whole[which[~mine] // 2] - h[~mine]
                    raw.append(h)
            cut = []
            for h in raw:                                            # numbers: all cells up to the cut
                if numeric:
                    c = np.cumsum(h, axis=1)
                    # what lies in the columns before: each has all of the node's rows
                    c[:, :numeric] -= h[:, :columns[0][1]].sum(axis=1)[:, None] * b.column[None, :numeric]
                    c[:, numeric:] = h[:, numeric:]
                else:
                    c = h
                cut.append(c)
            if subset < b.width:
                draw = rng.random((m, b.width))
                chosen = draw <= np.partition(draw, subset - 1, axis=1)[:, subset - 1:subset]
                place = np.flatnonzero(chosen[:, b.feature] & b.allowed)
                count = cut[0].ravel()[place] & mask
                place = place[(count >= min_leaf) & (count <= (tc[able] - min_leaf)[place // total])]
            else:
                count = cut[0] & mask
                place = np.flatnonzero((count >= min_leaf) & (count <= (tc[able] - min_leaf)[:, None]) & b.allowed)
            node = place // total
            part = {}
            for g, c in zip(groups, cut, strict=True):
                found = c.ravel()[place]
                part |= {d: (found >> bits * i) & mask for i, d in enumerate(g) if d}
            hp = part[2] * class_weight[1]
            hw = part[1] * class_weight[0] + hp
            w_all, p_all = tw[able], tp[able]
            rw, rp = w_all[node] - hw, p_all[node] - hp
            after = hp * (hw - hp) / hw + rp * (rw - rp) / rw
            if len(place):
                starts = np.flatnonzero(np.diff(node, prepend=-1))   # a node's cuts lie beside each other
                least = np.minimum.reduceat(after, starts)
                hit = np.flatnonzero(after == np.repeat(least, np.diff([*starts, len(node)])))
                hit = hit[np.diff(node[hit], prepend=-1) > 0]        # the first of equals
                got = node[hit]
                drop = p_all[got] * (w_all[got] - p_all[got]) / w_all[got] - after[hit]
                good = drop > 1e-9
                where = np.flatnonzero(able)[got[good]]
                best[where], gain[where] = place[hit[good]] % total, 2 * drop[good] / tw[where]
        split = best >= 0
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)      # in the next level
        left = np.where(split, first + here + child, -1)
        for name, found in (("cell", best), ("left", left), ("weight", tw), ("positive", tp), ("rows", tc), ("gain", gain)):
            nodes[name].append(found)
        if not split.any():
            break
        parents = [h[split[able]] for h in raw]
        # rows of these codes go right: above the cut, or at the level
        column = b.column[best]
        low = best - b.start[column] + (best < numeric)
        high = np.where(best < numeric, np.iinfo(codes.dtype).max, low)

        def right(of: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
            value = of.ravel().take(column.take(node) * of.shape[1] + rows)  # noqa: B023
            return (value >= low.take(node)) & (value <= high.take(node))  # noqa: B023

        stay = split[local]
        if not stay.all():
            live, local = live[stay], local[stay]
        local = child.take(local) + right(codes, local, live)
        node = at[moving] - first
        stay = split[node]
        if not stay.all():
            moving, node = moving[stay], node[stay]
        at[moving] = left.take(node) + right(b.codes, node, scored[moving])
        first, here = first + here, 2 * int(split.sum())
    return {k: np.concatenate(v) for k, v in nodes.items()}, at


def _forest(b: _Binned, y, class_weight, train, params: Mapping[str, Any], first: int, last: int, seed: int,
            scored: np.ndarray | None = None, by_depth: dict[int, np.ndarray] | None = None):
    """(tree, nodes, leaf of every row in ``scored``) of trees first..last; bootstraps depend on the seed and the tree alone."""
    rows = np.flatnonzero(train)
    depth = params.get("max_depth")
    for t in range(first, last):
        rng = np.random.default_rng([seed, t])
        w = np.zeros(len(y))
        w[rows] = np.bincount(rng.integers(0, len(rows), len(rows)), minlength=len(rows))
        if by_depth is not None:
            by_depth.clear()
        yield t, *grow(b, y, w, rng, MAX_DEPTH if depth is None else int(depth), int(params.get("min_samples_leaf") or 1),
                       int(params.get("min_samples_split") or 2), _subset(params.get("max_features"), b.width), class_weight,
                       scored, by_depth)


def _depth(params: Mapping[str, Any]) -> int:
    return MAX_DEPTH if params.get("max_depth") is None else int(params["max_depth"])


def family_of(params: Mapping[str, Any]) -> tuple:
    """Draws of one family have the same trees but for where they end: a node of less than twice the
    least leaf is never split, and trees of less depth are the upper nodes of the deeper ones."""
    leaf = int(params.get("min_samples_leaf") or 1)
    return (str(params.get("class_weight")), str(params.get("max_features")), leaf,
            max(2, int(params.get("min_samples_split") or 2), 2 * leaf))


def _shared(draws: Sequence[tuple[int, Mapping[str, Any]]]) -> list[tuple[list[tuple[int, dict]], int, int]]:
    """Runs of trees to grow: (draws that have these trees, first, last)."""
    families: dict[tuple, list[tuple[int, dict]]] = {}
    for i, p in draws:
        families.setdefault(family_of(p), []).append((i, dict(p)))
    out = []
    for members in families.values():
        edges = sorted({0, *(int(p["n_estimators"]) for _, p in members)})
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            mine = [m for m in members if int(m[1]["n_estimators"]) >= z]
            out += [(mine, t, min(t + TREES_PER_TASK, z)) for t in range(a, z, TREES_PER_TASK)]
    return out


def fits_a_task(prepared: Prepared) -> bool:
    return prepared.sizes[-1, 0] * (len(prepared.numeric) + len(prepared.text)) <= MAX_CELLS


def _weights(prepared: Prepared, k: int, params: Mapping[str, Any]) -> tuple[float, float]:
    n, positive = prepared.sizes[k]
    return (n / (2 * max(1.0, n - positive)), n / (2 * max(1.0, positive))) if params.get("class_weight") == "balanced" else (1.0, 1.0)


def _cost(trees: int, params: Mapping[str, Any]) -> int:
    depth = params.get("max_depth")
    return trees * (24 if depth is None else min(int(depth), 24))


def _shared_out(costs: Sequence[int], n: int) -> list[list[int]]:
    """``n`` groups of work: the dearest pieces go first, each to the group with least to do."""
    load, groups = [(0, g) for g in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g = heapq.heappop(load)
        groups[g].append(i)
        heapq.heappush(load, (cost + costs[i], g))
    return groups


def _keys(spark, n: int) -> list[int]:
    """``n`` keys, each of which has one of ``n`` partitions of its own."""
    key = F.col("id").cast("int")
    found = spark.range(64 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p")).agg(F.min(key).alias("k")).collect()
    keys = [r["k"] for r in found]
    spare = iter(range(64 * n, 65 * n))
    return keys + [next(spare) for _ in range(n - len(keys))]


def _dealt(prepared: Prepared, costs: Sequence[int]) -> tuple[DataFrame, dict[int, list[int]]]:
    """The whole (checked) table once for each group of work, and the groups: key -> pieces of
    work.  There are a few groups for every core, however many pieces (:func:`_shared_out`)."""
    cores = prepared.spark.sparkContext.defaultParallelism
    n = max(1, min(len(costs), GROUPS_PER_CORE * cores))
    keys = _keys(prepared.spark, n)
    named = F.array(*[F.lit(k) for k in keys])
    # the small table lies in a file or two: spread before it is copied
    rows = prepared.matrix.repartition(min(n, cores)).withColumn("task", F.explode(named)).repartition(n, "task").groupBy("task")
    return rows, dict(zip(keys, _shared_out(costs, n), strict=True))


_BLOCKS = "part int, place int, x binary, c binary, y binary, fold binary, row array<string>"


def _blocks(prepared: Prepared) -> DataFrame:
    """The matrix by id, rows of one id by their values (one order for the bootstraps), written as blocks of rows."""
    design = prepared.design
    n_x, n_c = design.fill.shape[1], design.mode.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            x, c = arrays(table, design)
            y, fold = table.column("y").to_numpy().astype(np.float32), table.column("fold").to_numpy().astype(np.int32)
            data = [x.T.tobytes(), c.T.astype(np.int32).tobytes(), y.tobytes(), fold.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), *[pa.array([d], pa.binary()) for d in data],
                 pa.array([table.column("row").to_pylist()], pa.list_(pa.string()))], ["part", "place", "x", "c", "y", "fold", "row"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(held)
                whole = n // BLOCK * BLOCK
                for i in range(0, whole, BLOCK):
                    yield packed(table.slice(i, BLOCK))
                    place += 1
                held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield packed(pa.Table.from_batches(held))

    def make() -> DataFrame:
        keys = [F.coalesce(F.col("row"), F.lit("")), F.col("row").isNull(), F.coalesce(F.col("y"), F.lit(float("nan"))),
                *[F.col("x")[i] for i in reversed(range(n_x))], *[F.col("c")[i] for i in reversed(range(n_c))], F.col("fold")]
        parts = max(1, int(prepared.sizes[-1, 0] // PART_ROWS))
        return prepared.matrix.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, _BLOCKS)

    return kept(prepared.spark, f"{prepared.folder}/blocks", make)


def _columns(block: Mapping[str, Any], design: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, c, y, fold) of a block, the first two a row per column."""
    y, fold = np.frombuffer(block["y"], np.float32), np.frombuffer(block["fold"], np.int32)
    return (np.frombuffer(block["x"]).reshape(design.fill.shape[1], len(y)),
            np.frombuffer(block["c"], np.int32).reshape(design.mode.shape[1], len(y)), y, fold)


def _cuts(blocks: DataFrame, design: Design, sets: Sequence[int]) -> dict[int, list[np.ndarray]]:
    """Cuts of every numeric column for each training set "all but fold k" (-1: all); a task has a column's values."""
    n_x, fill = design.fill.shape[1], design.fill

    def by_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, fold in zip(batch.column("x").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                if n_x:
                    values = np.frombuffer(x).reshape(n_x, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(n_x), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary()),
                         pa.array([fold] * n_x, pa.binary())], ["column", "x", "fold"])

    def found(table: pa.Table) -> pa.Table:
        j = table.column("column")[0].as_py()
        x = np.concatenate([np.frombuffer(v) for v in table.column("x").to_pylist()])
        fold = np.concatenate([np.frombuffer(v, np.int32) for v in table.column("fold").to_pylist()])
        cuts = [_thresholds(np.where(np.isnan(x), fill[k][j], x)[fold != k]) for k in sets]
        return pa.table({"set": pa.array(sets, pa.int32()), "column": pa.array([j] * len(sets), pa.int32()),
                         "cuts": pa.array([c.tobytes() for c in cuts], pa.binary())})

    rows = (blocks.select("x", "fold").mapInArrow(by_column, "column int, x binary, fold binary").groupBy("column")
            .applyInArrow(found, "set int, column int, cuts binary").collect())        # a row per column and set
    held = {(r["set"], r["column"]): np.frombuffer(r["cuts"]) for r in rows}
    return {k: [held.get((k, j), np.zeros(0)) for j in range(n_x)] for k in sets}


def _copied(prepared: Prepared, blocks: DataFrame, cuts: Mapping[int, Sequence[np.ndarray]], keys: Mapping[int, Sequence[int]]):
    """The whole (checked) table as cells once for each group of work: ``keys[k]`` are those of training set k."""
    design, n = prepared.design, sum(len(v) for v in keys.values())
    kind = _kind([*(len(t) + 1 for k in keys for t in cuts[k]), *np.diff(design.offsets).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                x, c, _, _ = _columns(block, design)
                for k, mine in keys.items():
                    codes = _codes(design, k, x.T, c.T, cuts[k], kind).tobytes()
                    for key in mine:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key], pa.int32()), *[pa.array([block[c]], pa.int32()) for c in ("part", "place")],
                             *[pa.array([d], pa.binary()) for d in (codes, block["y"], block["fold"])]],
                            ["task", "part", "place", "codes", "y", "fold"])

    rows = blocks.select("part", "place", "x", "c", "y", "fold").repartition(prepared.spark.sparkContext.defaultParallelism)
    made = rows.mapInArrow(run, "task int, part int, place int, codes binary, y binary, fold binary")
    return made.repartition(n, "task").groupBy("task"), kind


def _whole(table: pa.Table, n_columns: int, kind: type) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(part, place and rows of each block, codes, y, fold) of a task's table, in order."""
    of = sorted(zip(table.column("part").to_pylist(), table.column("place").to_pylist(), range(table.num_rows), strict=True))
    y = [np.frombuffer(table.column("y")[i].as_buffer(), np.float32) for _, _, i in of]
    codes, at = np.empty((n_columns, sum(map(len, y))), kind), 0
    for (_, _, i), mine in zip(of, y, strict=True):
        codes[:, at:at + len(mine)] = np.frombuffer(table.column("codes")[i].as_buffer(), kind).reshape(n_columns, len(mine))
        at += len(mine)
    fold = np.concatenate([np.frombuffer(table.column("fold")[i].as_buffer(), np.int32) for _, _, i in of])
    return [(p, q, len(mine)) for (p, q, _), mine in zip(of, y, strict=True)], codes, np.concatenate(y), fold


def cross_validated(prepared: Prepared, draws: Sequence[tuple[int, Mapping[str, Any]]], seed: int = 42) -> DataFrame:
    """(draw, fold, row, y, p): each row's probability from the forests that did not see its fold."""
    design, folds = prepared.design, range(prepared.n_folds)
    n_columns = len(prepared.numeric) + len(prepared.text)
    work = [(max((p for _, p in mine), key=_depth), mine, first, last) for mine, first, last in _shared(draws)]
    weight = {k: [_weights(prepared, k, w[0]) for w in work] for k in folds}
    # groups of a fold have about as much to do, and as many of them as there are cores run at once
    cores = prepared.spark.sparkContext.defaultParallelism
    groups = _shared_out([_cost(last - first, p) for p, _, first, last in work], min(len(work), cores))
    keys = _keys(prepared.spark, len(groups) * len(folds))
    of_fold = {k: keys[k * len(groups):(k + 1) * len(groups)] for k in folds}
    mine_of = {key: (k, g) for k in folds for key, g in zip(of_fold[k], groups, strict=True)}
    blocks = _blocks(prepared)
    cuts = _cuts(blocks, design, list(folds))
    dealt, kind = _copied(prepared, blocks, cuts, of_fold)

    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        k, mine = mine_of[task]
        sizes, codes, y, fold = _whole(table, n_columns, kind)
        train = fold != k
        held = np.flatnonzero(~train)
        b = _Binned.of(design, k, cuts[k], codes) if train.any() else None
        sums: dict[int, np.ndarray] = {}
        for number in sorted(mine):
            params, members, first, last = work[number]
            for draw, _ in members:
                sums.setdefault(draw, np.zeros(len(held)))
            if b is not None:
                shallow = {_depth(p) for _, p in members} != {_depth(params)}
                by_depth: dict[int, np.ndarray] | None = {} if shallow else None
                for _, nodes, leaf in _forest(b, y, weight[k][number], train, params, first, last, seed, held, by_depth):
                    share = nodes["positive"] / nodes["weight"]
                    for draw, p in members:
                        sums[draw] += share[by_depth.get(_depth(p), leaf) if by_depth else leaf]
        ends = np.searchsorted(held, np.cumsum([0, *(n for _, _, n in sizes)]))
        out = [(part, place, task, draw, k, p[a:z].tobytes()) for (part, place, _), a, z in zip(sizes, ends[:-1], ends[1:], strict=True)
               if z > a for draw, p in sums.items()]
        names = ("part", "place", "task", "draw", "fold")
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({n: pa.array(v, pa.int32()) for n, v in zip(names, cols[:5], strict=True)} | {"p": pa.array(cols[5], pa.binary())})

    trees = {i: int(p["n_estimators"]) for i, p in draws}

    def added(rows: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for block in rows.to_pylist():
            y, fold = np.frombuffer(block["y"], np.float32).astype(np.int32), np.frombuffer(block["fold"], np.int32)
            ids = pa.array(block["row"], pa.string())
            sums: dict[tuple[int, int], np.ndarray] = {}
            for part in sorted(parts.to_pylist(), key=lambda r: r["task"]):
                of = (part["draw"], part["fold"])
                sums[of] = sums.get(of, 0.0) + np.frombuffer(part["p"])
            for (draw, k), p in sums.items():
                mine = np.flatnonzero(fold == k)
                out.append(pa.table({"draw": pa.array(np.full(len(p), draw), pa.int32()), "fold": pa.array(fold[mine]),
                                     "row": ids.take(pa.array(mine)), "y": pa.array(y[mine]), "p": pa.array(p / trees[draw])}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(
            ("draw", "fold", "row", "y", "p"), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()), strict=True)})

    at = ["part", "place"]
    parts = dealt.applyInArrow(run, "part int, place int, task int, draw int, fold int, p binary")
    sums = (blocks.select(*at, "y", "fold", "row").groupBy(*at).cogroup(parts.groupBy(*at))
            .applyInArrow(added, "draw int, fold int, row string, y int, p double"))
    return sums.groupBy("draw", "fold", "row", "y").agg(F.sum("p").alias("p"))


def fit_rows(train: DataFrame, params: Mapping[str, Any], target: str, id_col: str, seed: int = 42):
    """Preprocessing and forest (ML-6) learned from ``train``: (fitted pipeline of the
    preprocessing, forest).  A table that is small enough for one task's memory is dealt out
    whole and its trees are grown there; a larger one is fitted by Spark's forest, on at least
    as many partitions as there are cores."""
    from .folds import prepare
    from .ml import build_preprocessor, feature_columns, random_forest
    spark = train.sparkSession
    classifier = random_forest(params, label=target)                 # raises on what no tree here may have
    seed = int(params.get("random_state") or seed)
    nums, cats = feature_columns(train, target)
    if train.count() * (len(nums) + len(cats)) <= MAX_CELLS:
        used = train.select(*dict.fromkeys([*nums, *cats, target, id_col]))
        prepared = prepare(used, nums, cats, target, id_col, shared_path(spark, "fit", uuid.uuid4().hex), 2, seed)
        try:
            return prepared.preprocessing(scale=False), fit_small(prepared, params, seed)
        finally:
            prepared.release()
    prep = Pipeline(stages=build_preprocessor(train, nums, cats)).fit(train)
    x = prep.transform(train).select("features", F.col(target).cast("double").alias(target))
    cores = spark.sparkContext.defaultParallelism
    if x.rdd.getNumPartitions() < cores:
        x = x.repartition(cores)
    forest = classifier.fit(x)
    return prep, with_min_split(forest, params.get("min_samples_split"))


def _saved(t: int, nodes: Mapping[str, np.ndarray], b: _Binned) -> pa.Table:
    """Rows of a tree in the node table of saved models, numbered depth first."""
    left, cell = nodes["left"], nodes["cell"]
    inner, levels = np.zeros(1, int), []                             # inner nodes, a level after the other
    while len(inner := inner[left[inner] >= 0]):
        levels.append(inner)
        inner = np.stack([left[inner], left[inner] + 1], axis=1).ravel()
    size, place = np.ones(len(left), int), np.zeros(len(left), int)
    for v in reversed(levels):
        size[v] += size[left[v]] + size[left[v] + 1]
    for v in levels:
        place[left[v]], place[left[v] + 1] = place[v] + 1, place[v] + 1 + size[left[v]]
    order = np.argsort(place)
    left, cell, w, p = left[order], cell[order], nodes["weight"][order], nodes["positive"][order]
    split, share, n = left >= 0, p / w, len(order)
    stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2), pa.int32()), pa.array(np.stack([w - p, p], axis=1).ravel()))
    return pa.table({
        "treeID": pa.array(np.full(n, t), pa.int32()), "id": pa.array(np.arange(n), pa.int32()),
        "prediction": pa.array((share > 0.5).astype(float)), "impurity": pa.array(2 * share * (1 - share)), "impurityStats": stats,
        "rawCount": pa.array(nodes["rows"][order], pa.int64()), "gain": pa.array(np.where(split, nodes["gain"][order], -1.0)),
        "leftChild": pa.array(np.where(split, np.arange(n) + 1, -1), pa.int32()),
        "rightChild": pa.array(np.where(split, place[np.where(split, left + 1, 0)], -1), pa.int32()),
        "featureIndex": pa.array(np.where(split, b.feature[cell], -1), pa.int32()),
        "threshold": pa.array(b.cut[cell], mask=~split)})


def fit_small(prepared: Prepared, params: Mapping[str, Any], seed: int = 42) -> RandomForestClassificationModel | GrownForest:
    """A forest on the whole (checked) table as a Spark model: tasks grow its trees,
    their node table is written in the form of saved models and loaded, if it has at most
    ``MODEL_NODES`` nodes; a larger one scores from that table."""
    spark, design, n_trees = prepared.spark, prepared.design, int(params["n_estimators"])
    step = max(1, min(TREES_PER_TASK, -(-n_trees // spark.sparkContext.defaultParallelism)))
    runs = [(t, min(t + step, n_trees)) for t in range(0, n_trees, step)]
    params, weight = dict(params), _weights(prepared, -1, params)
    schema = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
              "leftChild int, rightChild int, featureIndex int, threshold double")

    groups = _shared_out([last - first for first, last in runs], min(len(runs), GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))
    keys = _keys(spark, len(groups))
    mine_of = dict(zip(keys, groups, strict=True))
    n_columns = len(prepared.numeric) + len(prepared.text)
    blocks = _blocks(prepared)
    cuts = _cuts(blocks, design, [-1])
    dealt, kind = _copied(prepared, blocks, cuts, {-1: keys})

    def run(table: pa.Table) -> pa.Table:
        mine = mine_of[table.column("task")[0].as_py()]
        _, codes, y, _ = _whole(table, n_columns, kind)
        train, b, none = np.ones(len(y), bool), _Binned.of(design, -1, cuts[-1], codes), np.zeros(0, int)     # no row is scored here
        return pa.concat_tables([_saved(t, nodes, b) for i in mine
                                 for t, nodes, _ in _forest(b, y, weight, train, params, *runs[i], seed, none)])

    path = shared_path(spark, "trees", uuid.uuid4().hex)
    cut = F.struct(F.col("featureIndex"), F.array_compact(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                   F.lit(-1).alias("numCategories")).alias("split")
    nodes = dealt.applyInArrow(run, schema)
    nodes.select("treeID", F.struct(*_FIELDS[:-1], cut).alias("nodeData")).write.parquet(f"{path}/data")
    # a saved model's other tables, from a forest of one stump over two rows of as many features
    two = spark.createDataFrame([(Vectors.sparse(design.width, [], []), float(y)) for y in (0, 1)], ["features", prepared.target])
    stump = RandomForestClassifier(labelCol=prepared.target, numTrees=1, maxDepth=0, seed=seed).fit(two.coalesce(1))
    stump.write().save(f"{path}/stump")
    about = json.loads(spark.read.text(f"{path}/stump/metadata").first()[0])
    about["numTrees"] = n_trees
    depth = params.get("max_depth")
    about["paramMap"] |= {"numTrees": n_trees, "maxDepth": MAX_DEPTH if depth is None else int(depth)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = spark.read.parquet(f"{path}/stump/treesMetadata")
    trees = one.withColumn(one.columns[0], F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    trees.select(one.columns).write.parquet(f"{path}/treesMetadata")
    if spark.read.parquet(f"{path}/data").count() > MODEL_NODES:
        return GrownForest(spark, path)
    return RandomForestClassificationModel.load(path)
