"""SimHash near-duplicates: fingerprints, exact links by vantage-point trees.

*Fingerprint.*  Lower-cased (A-Z) words, shingles of ``shingle`` words with
repeats, XXH64 with seed 42 of each; a bit is 1 if set in over half of them.
The hashes of a text are counted bit by bit in numpy, in runs of bounded length.

*Links.*  Two of ``distance + 1`` disjoint bit blocks cannot all differ in a
pair that differs in at most ``distance`` bits, so every linked pair agrees in
one block.  Plain vantage-point shards of the 64-bit space don't work here:
unrelated fingerprints lie 32 +- 4 bits apart, so a radius of 4 reaches over
two thirds of the points on either side of every ball (README).  So the shards
are taken in the metric of one block, where the radius is 0 and no shard
overlaps another, and the trees run inside the shards, in the full metric:

- a vantage point's ball of median radius parts a node; by the triangle
  inequality a point within ``distance`` of the boundary may have partners on
  the other side, and is queried there as well;
- leaves compare home points and visiting queries exactly.

A shard with many fingerprints (one hot block value) is dealt over several
tasks: its points are cut into parts, and a task takes one pair of parts.  A
task returns a spanning forest of its links, not all pairs.  Equal fingerprints
are one node from the start, so a group of copies is one row.

Defined cases: fewer words than a shingle: the whole sequence is the only one;
no words (or NULL text): fingerprint zero, linked like any other.  A NULL
``doc_id`` has a fingerprint and a component but is nobody's smallest id
unless all are NULL.  Repeated rows stay and share their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, text_slices
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Points of one shard part; a pair of parts is a task's unit.
PART = 2048
LEAF = 128
_RUN = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text (unsigned)."""
    import xxhash
    words = text.encode().lower().split()          # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _RUN):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i:i + _RUN], ends[i:i + _RUN], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64))],
                                                 ["doc_id", "text_hash", "fp"])

    return picked(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")) \
        .mapInArrow(run, "doc_id long, text_hash long, fp long")


class Forest:
    """Union-find over the points of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def tree_links(points: np.ndarray, home: np.ndarray, visiting: np.ndarray, distance: int, forest: Forest) -> None:
    """Link all pairs home x home and visiting x home within ``distance``.

    ``home`` and ``visiting`` index ``points``; a node's queries are its own
    points and those visiting from over the boundary."""
    todo = [(home, visiting)]
    while todo:
        home, visiting = todo.pop()
        if not len(home):
            continue
        if len(home) > LEAF:
            d = np.bitwise_count(points[home] ^ points[home[0]])
            radius = int(np.median(d))
            inside = d <= radius
            if not inside.all():
                v = np.bitwise_count(points[visiting] ^ points[home[0]]).astype(np.int16)
                d = d.astype(np.int16)
                # triangle inequality: |d(x, v) - d(y, v)| <= d(x, y)
                into = np.r_[home[~inside & (d <= radius + distance)], visiting[v <= radius + distance]]
                out = np.r_[visiting[v > radius - distance]]
                # a home pair over the boundary is found once: the outer point visits the ball
                todo += [(home[inside], into), (home[~inside], out)]
                continue
        for i in range(0, len(home), 512):
            part = home[i:i + 512]
            near = np.bitwise_count(points[part][:, None] ^ points[home][None]) <= distance
            a, b = np.nonzero(np.triu(near, 1 + i))
            _link_once(part[a], home[b], forest)
            for j in range(0, len(visiting), 4096):
                some = visiting[j:j + 4096]
                a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[some][None]) <= distance)
                _link_once(part[a], some[b], forest)


def _link_once(left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    if len(left) > 4096:
        # dense leaf: link neighbours in the sparse matrix's rows instead of every pair, in numpy first
        parent = np.fromiter(map(forest.root, range(len(forest.parent))), np.int64, len(forest.parent))
        keep = parent[left] != parent[right]
        pair = np.unique(parent[left[keep]] * len(parent) + parent[right[keep]])
        left, right = pair // len(parent), pair % len(parent)
    forest.link(left, right)


def block_masks(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 1`` disjoint blocks of the 64 bits."""
    edges = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def links(nodes: DataFrame, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """Spanning links ``a, b`` of the distinct fingerprints ``fp`` within
    ``distance`` bits: all components, not all pairs."""
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L").alias("value"))
                       for i, (s, w) in enumerate(block_masks(distance))])
    dealt = nodes.select("fp", F.inline(blocks).alias("block", "value"))
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("block", "value", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    # each point of a shard of p parts goes to the p pairs that its part is in
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (dealt.join(sizes, ["block", "value"])
             .withColumn("own", own)
             .select("fp", "block", "value", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("block", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch | None:
            out_a, out_b = [], []
            key = np.stack([rows.column(i).to_numpy() for i in range(4)], 1)
            own, fp = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                points = fp[a:b].view(np.uint64)
                forest, every = Forest(b - a), np.arange(b - a)
                if key[a, 2] == key[a, 3]:
                    tree_links(points, every, every[:0], distance, forest)
                else:       # two parts of one shard: the first is home, the second visits
                    first = own[a:b] == key[a, 2]
                    _visit_only(points, every[first], every[~first], distance, forest)
                roots = np.fromiter(map(forest.root, range(b - a)), np.int64, b - a)
                moved = np.flatnonzero(roots != every)
                out_a.append(fp[a:b][moved])
                out_b.append(fp[a:b][roots[moved]])
            if not out_a:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

        for batch in batches:       # a cell may go on into the next batch
            held.append(batch)
            rows = pa.Table.from_batches(held)
            tail = rows.num_rows - 1
            last = [rows.column(i)[tail].as_py() for i in range(4)]
            same = np.logical_and.reduce([rows.column(i).to_numpy() == last[i] for i in range(4)])
            start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if start and (out := solve(rows.slice(0, start).combine_chunks())) is not None:
                yield out
            held = rows.slice(start).to_batches()
        if held and (out := solve(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return (cells.repartition("block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q")
            .mapInArrow(run, "a long, b long"))


def _visit_only(points: np.ndarray, home: np.ndarray, visiting: np.ndarray, distance: int, forest: Forest) -> None:
    """Links between two sets, by the tree over ``home``; home pairs are another cell's."""
    todo = [(home, visiting)]
    while todo:
        home, visiting = todo.pop()
        if not len(home) or not len(visiting):
            continue
        if len(home) > LEAF:
            d = np.bitwise_count(points[home] ^ points[home[0]])
            radius = int(np.median(d))
            inside = d <= radius
            if not inside.all():
                v = np.bitwise_count(points[visiting] ^ points[home[0]]).astype(np.int16)
                todo += [(home[inside], visiting[v <= radius + distance]), (home[~inside], visiting[v > radius - distance])]
                continue
        for i in range(0, len(visiting), 4096):
            some = visiting[i:i + 4096]
            for j in range(0, len(home), 512):
                part = home[j:j + 512]
                a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[some][None]) <= distance)
                _link_once(part[a], some[b], forest)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` of every row: the smallest
    ``doc_id`` that links of at most ``distance`` differing bits reach."""
    marked = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), distance))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # a computed key, so that the join shuffles both of its sides itself: only then does
    # adaptive execution split a component of very many fingerprints
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id")) \
        .select(F.col("root").bitwiseXOR(F.lit(0).cast("long")).alias("root"), "component_id")
    of = joined.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does:
    the one of smallest id (of smallest text hash among equal ids; a NULL id
    only where all are)."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stay = (near_duplicates(docs, shingle, distance, id_col, text_col)
            .groupBy("root").agg(F.min(rank).alias("first")).select("first.doc_id", "first.text_hash").alias("s"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                        docs[id_col].cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("text_hash")).alias("d")
    kept = whole.join(stay, F.expr("d.doc_id <=> s.doc_id and d.text_hash = s.text_hash"), "left_semi")
    copies = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("row.*")
