"""Operator 13: Merkle manifest of a dataset, checkpoint-and-recompute.

Every row is a leaf.  The leaves of a group (``lang``) in order form a binary
tree, and the trees' tops, ordered by group, form one more, whose top is the
root.  Only every ``SPAN``-th level is kept (written to the shared folder).  An
*aligned subtree* is the 2^SPAN nodes of a kept level below one node of the
next, so it is also the unit of work:

* **up**: the nodes of a kept level are dealt by (tree, subtree), folded inside
  the task, and only the subtree's top is written;
* **proofs**, from the top down: one row per subtree says what lies above it
  (siblings up to the root).  A task regenerates the missing interior nodes from
  the kept ones, emits for every node its siblings inside the subtree and those
  above, and discards the rest.

A task holds one subtree at a time, whatever the size of the tree, so a group
with a third of all rows is only more subtrees.  Positions come from one range
partitioning of the digests (never of the texts) by (group, order, digest) and
prefix sums over the partitions.  Every table is written once and read back: a
lost executor costs tasks of one level.

Defined results: a NULL field counts as ``-``; a NULL group is a group of its
own, before all others; rows of equal order are ordered by digest, and wholly
equal rows are interchangeable leaves of their own; a tree of one leaf has this
leaf as its top; an empty table has no rows and no root.  Columns are taken by
name under internal names, so extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder

#: Levels between two kept ones: a subtree has 2^8 nodes.
SPAN = 8
_ROWS = 2048
_IN_PARTITION = (1 << 33) - 1              # monotonically_increasing_id: partition << 33 | row
PATH = "path array<struct<side:string,digest:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of a row: per field ``-`` if NULL, else its UTF-8 byte count, ``:`` and its value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                             for c in text]), 256)


def proof_digest(path: Column) -> Column:
    """Digest of the siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda at, s: F.sha2(
        F.when(s["side"] == "L", F.concat(s["digest"], at)).when(s["side"] == "R", F.concat(at, s["digest"])).otherwise(at), 256))


# -- inside a task: one aligned subtree at a time -------------------------------------------

def _parent(run: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in run]).encode()).digest()


def _regenerate(nodes: list[bytes], total: int, span: int) -> tuple[list[list[bytes]], int]:
    """All levels of a subtree from its kept nodes; ``total`` nodes has the whole
    tree at that level.  A tree ends where one node is left."""
    levels = [nodes]
    for _ in range(span):
        if total == 1:
            break
        below = levels[-1]
        levels.append([_parent(below[i:i + 2]) for i in range(0, len(below), 2)])
        total = (total + 1) // 2
    return levels, total


def _at_level(n: int, level: int) -> int:
    return -(-n // (1 << level))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of a stream sorted by its first two columns (tree, subtree), one list for each."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != key:
                if held:
                    yield held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield held


def _up(level: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def flush():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.bool_())], ["tree", "n", "pos", "digest", "done"])

        for rows in _subtrees(batches):                       # tree, chunk, pos, n, digest
            tree, chunk, _, n, _ = rows[0]
            levels, total = _regenerate([r[4] for r in rows], _at_level(n, level), span)
            out.append((tree, n, chunk, levels[-1][0], total == 1))
            if len(out) >= _ROWS:
                yield flush()
                out = []
        if out:
            yield flush()
    return run


def _steps(levels: list[list], i: int) -> tuple[list[str], list]:
    """Sides and digests of node i's siblings inside its subtree (a lone node has none: ``-``)."""
    sides, digests = [], []
    for nodes in levels[:-1]:
        j = i ^ 1
        if j < len(nodes):
            sides.append("L" if j < i else "R")
            digests.append(nodes[j])
        else:
            sides.append("-")
            digests.append(None)
        i >>= 1
    return sides, digests


def _down(level: int, span: int, names: list[str], payload: list[pa.Field]):
    """Columns in: tree, chunk, pos, n, digest, then sides, above, subroot, root of the
    row that opens a subtree (pos -1), then at the lowest level the leaves' payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def flush():
            cols = list(zip(*out, strict=True))
            if level:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            sides, above = cols[4], cols[5]
            offsets = [0]
            for s in sides:
                offsets.append(offsets[-1] + len(s))
            steps = pa.StructArray.from_arrays([pa.array([x for s in sides for x in s], pa.string()),
                                                pa.array([x for d in above for x in d], pa.string())], ["side", "digest"])
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
                      pa.array(cols[3], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)]
            arrays += [pa.array(c, f.type) for c, f in zip(cols[6:], payload, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for rows in _subtrees(batches):
            tree, _, _, _, _, over, above, subroot, root = rows[0][:9]       # pos -1 comes first
            rows = rows[1:]
            levels, _ = _regenerate([r[4] for r in rows], _at_level(rows[0][3], level), span)
            text = [[d.hex() for d in nodes] for nodes in levels]
            for i, r in enumerate(rows):
                sides, digests = _steps(text, i)
                if level:
                    out.append((tree, r[2], "".join(sides) + over, digests + above, subroot, root))
                else:
                    out.append((tree, text[0][i], subroot, root, sides + list(over), digests + above, *r[9:]))
                if len(out) >= _ROWS:
                    yield flush()
                    out = []
        if out:
            yield flush()
    return run


# -- tables -----------------------------------------------------------------------------------

def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _positioned(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Rows (tree, order, digest, payload) with their place ``pos`` in their tree and
    the tree's size ``n``, written; and the largest size (0: no rows)."""
    rows = _written(rows, f"{folder}/leaves")
    # equal rows may fill more than one range: the row number of the written file parts them
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree").asc_nulls_first(), F.col("order").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = _written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
                      .withColumn("seq", F.monotonically_increasing_id()), f"{folder}/ranged")
    ranged = ranged.withColumn("part", F.shiftright("seq", 33)).withColumn("seq", F.col("seq").bitwiseAND(F.lit(_IN_PARTITION)))
    # a row per range and tree: as many as ranges and trees together
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"), F.min("seq").alias("first"))
    by_tree = Window.partitionBy("tree")
    sizes = sizes.select("tree", "part", "first", F.sum("here").over(by_tree).alias("n"),
                         (F.sum("here").over(by_tree.orderBy("part")) - F.col("here")).alias("before"))
    sizes = _written(sizes, f"{folder}/sizes").select(F.col("tree").alias("t"), F.col("part").alias("p"), "n", "first", "before")
    placed = ranged.join(sizes, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    placed = placed.select("tree", (F.col("before") + F.col("seq") - F.col("first")).alias("pos"), "n", "digest",
                           *[c for c in rows.columns if c not in ("tree", "order", "digest", "tie")])
    return _written(placed, f"{folder}/level-0"), sizes.agg(F.max("n")).first()[0] or 0


def _dealt(nodes: DataFrame, span: int, *more: str) -> DataFrame:
    chunk = F.when(F.col("pos") < 0, F.col("chunk")) if "chunk" in nodes.columns else F.lit(None)
    nodes = nodes.withColumn("chunk", F.coalesce(chunk, F.shiftright("pos", span)))
    return (nodes.select("tree", "chunk", "pos", "n", "digest", *more).repartition("tree", "chunk")
            .sortWithinPartitions("tree", "chunk", "pos"))


def _built(leaves: DataFrame, largest: int, folder: str, span: int) -> tuple[list[DataFrame], DataFrame]:
    """Kept levels, and the top of every tree (tree, n, digest)."""
    levels, tops, nodes, level = [leaves], None, leaves, 0
    while True:
        folds = _dealt(nodes, span).mapInArrow(_up(level, span), "tree string, n long, pos long, digest binary, done boolean")
        folds = _written(folds, f"{folder}/level-{level + span}")
        done = folds.where("done").select("tree", "n", "digest")
        tops = done if tops is None else tops.union(done)
        level += span
        if _at_level(largest, level) <= 1:
            return levels, tops
        nodes = folds.where("not done")
        levels.append(nodes)


def _descended(levels: list[DataFrame], starts: DataFrame, payload: list[str], folder: str, span: int) -> DataFrame:
    """Every leaf with its path.  ``starts`` has a row (tree, n, over, above, subroot, root)
    for each tree: the steps from its top to the root."""
    # the kept level whose subtree holds the tree's top: height h = bits of n - 1
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(F.lit(1))
    starts = starts.withColumn("stage", F.floor((height - 1) / span).cast("int"))
    opens = ["over", "above", "subroot", "root"]
    found = None
    for k in range(len(levels) - 1, -1, -1):
        marks = starts.where(F.col("stage") == k).select("tree", F.lit(0).cast("long").alias("chunk"), *opens)
        if found is not None:
            marks = marks.unionByName(found.select("tree", F.col("pos").alias("chunk"), *opens))
        last = k == 0
        nodes = levels[k].select("tree", "pos", "n", "digest", *(payload if last else []))
        mixed = nodes.unionByName(marks.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        mixed = _dealt(mixed, span, *opens, *(payload if last else []))
        if last:
            kinds = [f for f in levels[0].schema.fields if f.name in payload]
            kinds = sorted(kinds, key=lambda f: payload.index(f.name))
            fields = [pa.field(f.name, {"long": pa.int64(), "string": pa.string()}[
                "long" if f.dataType.simpleString() == "bigint" else "string"]) for f in kinds]
            schema = f"tree string, digest string, subroot string, root string, {PATH}"
            schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kinds)
            return mixed.mapInArrow(_down(0, span, ["tree", "digest", "subroot", "root", "path", *payload], fields), schema)
        found = mixed.mapInArrow(
            _down(k * span, span, ["tree", "pos", *opens], []),
            "tree string, pos long, over string, above array<string>, subroot string, root string")
        found = _written(found, f"{folder}/paths-{k * span}")


def manifest(rows: DataFrame, group_col: str = "lang", order_col: str = "doc_id", digest_col: str = "leaf",
             carry: Sequence[str] = (), folder: str | None = None, span: int = SPAN) -> DataFrame:
    """Inclusion proofs of all rows: ``tree`` (the group), ``order``, ``digest``,
    ``subroot``, ``root``, ``path`` (per level the sibling's side, ``L``, ``R`` or
    ``-`` for none, and its digest, from the leaf up) and the text columns named in
    ``carry``.  ``digest_col`` holds hex digests; the kept levels stay in ``folder``
    (default: a new one in the shared folder)."""
    spark: SparkSession = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    carried = [f"carry_{i}" for i in range(len(carry))]
    leaves = rows.select(rows[group_col].cast("string").alias("tree"), rows[order_col].cast("long").alias("order"),
                         F.unhex(rows[digest_col]).alias("digest"), rows[order_col].cast("long").alias("leaf_order"),
                         *[rows[c].cast("string").alias(a) for c, a in zip(carry, carried, strict=True)])
    placed, largest = _positioned(leaves, f"{folder}/trees")
    if not largest:
        return spark.createDataFrame([], f"tree string, order long, digest string, subroot string, root string, {PATH}"
                                     + "".join(f", `{c}` string" for c in carry))
    levels, tops = _built(placed, largest, f"{folder}/trees", span)
    # one more tree over the tops, ordered by group: (tree, digest) is its leaf, the group's name its payload
    upper = tops.select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest",
                        F.col("tree").alias("name"), F.col("n").alias("leaves"))
    upper_placed, groups = _positioned(upper, f"{folder}/groups")
    upper_levels, root = _built(upper_placed, groups, f"{folder}/groups", span)
    start = root.select("tree", "n", F.lit("").alias("over"), F.array().cast("array<string>").alias("above"),
                        F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    over = _descended(upper_levels, start, ["name", "leaves"], f"{folder}/groups", span)
    over = _written(over, f"{folder}/groups/proofs")
    starts = over.select(F.col("name").alias("tree"), F.col("leaves").alias("n"),
                         F.array_join(F.transform("path", lambda s: s["side"]), "").alias("over"),
                         F.transform("path", lambda s: s["digest"]).alias("above"), F.col("digest").alias("subroot"), "root")
    found = _descended(levels, starts, ["leaf_order", *carried], f"{folder}/trees", span)
    return found.select("tree", F.col("leaf_order").alias("order"), "digest", "subroot", "root", "path",
                        *[F.col(a).alias(c) for c, a in zip(carry, carried, strict=True)])
