"""Approximate nearest neighbours: robust-pruned directed graphs over shards.

Vectors are dealt by hash into shards of bounded size.  In a shard, equal
vectors are one node.  The graph starts with random edges; every node then
searches the graph greedily from the entry point (the node nearest the mean),
and robust pruning turns what it visited into edges: the nearest candidate
stays, and every other that is closer to it, by the factor ``alpha``, than to
the node goes.  Edges get reverse edges, pruned alike where a node has too
many.  The second pass uses the relaxed factor, which keeps long, diverse edges.

Shard indexes are rows of a table in the shared checkpoint folder.  Queries, in
blocks, meet every shard's index; a beam search in each gives candidates whose
exact cosine (double precision, original vectors) decides; the best of all
shards win, ties to the smaller id.

Norms are taken of vectors scaled by a power of two to components around one, so
very large and very small finite vectors keep their cosine.

Defined cases: a vector that is NULL, zero, or has NULL or non-finite
components takes no part, as query or candidate; neither does one whose length
isn't the commonest of the table (ties: the smaller length).  NULL ids take no part.  A query's own row isn't among its
candidates; other rows with an equal vector are.  Fewer candidates than ``k``:
all of them.  Repeated ids are rows of their own as candidates; a query id that
occurs more than once is asked once for each distinct vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
DEGREE = 32
BEAM = 64
ALPHA = 1.2
QUERY_BLOCK = 256
_SEED = 5


def _beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: node ids (n, beam), nearest first
    (-1: none), and their similarities.  Rounds go on until every query has
    expanded all of its beam."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, q @ x[entry], True
    seen[:, entry] = True
    while True:
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            return ids, sims
        # the two nearest unexpanded nodes of each query
        masked = np.where(open_[active], sims[active], -np.inf)
        take = np.argsort(-masked, axis=1)[:, :2]
        rows = np.arange(len(active))[:, None]
        real = np.isfinite(masked[rows, take])
        open_[active[~real.any(1)]] = False              # every round expands a node or closes the query
        node = np.where(real, ids[active[:, None], take], entry)
        a_rows = np.repeat(active, 2).reshape(-1, 2)
        open_[a_rows[real], take[real]] = False
        near = np.where(real[:, :, None], edges[node], -1).reshape(len(active), -1)
        ok = near >= 0
        safe = np.where(ok, near, entry)
        ok &= ~seen[active[:, None], safe]
        # one query's two lists may share a node: keep its first place
        order = np.argsort(np.where(ok, safe, len(x)), axis=1, kind="stable")
        ranked = np.take_along_axis(safe, order, 1)
        again = np.zeros_like(ok)
        np.put_along_axis(again, order, np.c_[np.zeros((len(active), 1), bool), ranked[:, 1:] == ranked[:, :-1]], 1)
        ok &= ~again
        r, c = np.nonzero(ok)
        seen[active[r], safe[r, c]] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("ij,ij->i", x[safe[r, c]], q[active[r]])
        all_ids = np.concatenate([ids[active], np.where(ok, near, -1)], 1)
        all_sims = np.concatenate([sims[active], sim], 1)
        all_open = np.concatenate([open_[active], ok], 1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        open_[active] = np.take_along_axis(all_open, best, 1)


def robust_prune(x: np.ndarray, node: int, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse edges of a node: the nearest candidate stays and drives out
    those that are ``alpha`` times closer to it than to the node."""
    c = np.unique(candidates)
    c = c[(c >= 0) & (c != node)]
    if not len(c):
        return c
    d = np.maximum(0, 2 - 2 * (x[c] @ x[node]))          # squared distance of unit vectors
    c = c[np.lexsort((c, d))]
    d = np.sort(d)
    between = np.maximum(0, 2 - 2 * (x[c] @ x[c].T))
    alive, kept = np.ones(len(c), bool), []
    for i in range(len(c)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > d
    return c[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n, degree; -1: none) and the entry point over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(_SEED)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(np.argmax(x @ x.mean(0)))
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        edges[:, :start.shape[1]] = start + (start >= np.arange(n)[:, None])
    for factor in (1.0, alpha):
        for batch in np.array_split(rng.permutation(n), -(-n // 256)):
            found, _ = _beam_search(x, edges, entry, x[batch], beam)
            back: dict[int, list[int]] = {}
            for p, near in zip(batch.tolist(), found, strict=True):
                kept = robust_prune(x, p, np.r_[near, edges[p]], factor, degree)
                edges[p] = -1
                edges[p, :len(kept)] = kept
                for k in kept.tolist():
                    back.setdefault(k, []).append(p)
            for k, new in back.items():
                every = np.unique(np.r_[edges[k][edges[k] >= 0], new])
                if len(every) > degree:
                    every = robust_prune(x, k, every, factor, degree)
                edges[k] = -1
                edges[k, :len(every)] = every
    return edges, entry


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to [0.5, 1)."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _cosines(a: np.ndarray, norm_a: float, b: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    return (b * a).sum(1) / (norm_a * norm_b)


class Shard:
    """One shard: distinct vectors as nodes with their ids, and the graph."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, degree: int, beam: int, alpha: float):
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        self.ids = ids[order]
        self.start = np.searchsorted(inverse.ravel()[order], np.arange(len(self.vectors) + 1))
        self.vectors = _scaled(self.vectors)
        self.norm = np.sqrt((self.vectors ** 2).sum(1))
        self.unit = (self.vectors / self.norm[:, None]).astype(np.float32)
        self.edges, self.entry = build_graph(self.unit, degree, beam, alpha)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, ...]:
        """(query position, vec_id, score) of the k best candidates of each query."""
        queries = _scaled(queries)
        norm = np.sqrt((queries ** 2).sum(1))
        out = ([], [], [])
        for i in range(0, len(queries), QUERY_BLOCK):
            part = slice(i, i + QUERY_BLOCK)
            found, _ = _beam_search(self.unit, self.edges, self.entry,
                                    (queries[part] / norm[part, None]).astype(np.float32), max(beam, k + 1))
            for j, near in enumerate(found, i):
                near = near[near >= 0]
                score = _cosines(queries[j], norm[j], self.vectors[near], self.norm[near])
                # of each node the k + 1 smallest ids can be among the best k
                some = [self.ids[self.start[m]:min(self.start[m] + k + 1, self.start[m + 1])] for m in near.tolist()]
                ids = np.concatenate(some)
                score = np.repeat(score, list(map(len, some)))
                other = ids != query_ids[j]
                ids, score = ids[other], score[other]
                best = np.lexsort((ids, -score))[:k]
                out[0].append(np.full(len(best), j))
                out[1].append(ids[best])
                out[2].append(score[best])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (array<double>) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # one row: the commonest length
    common = sizes.agg(F.min_by("size", F.struct((-F.col("n")).alias("fewer"), "size")).alias("common"))
    return rows.join(F.broadcast(common), F.size("v") == F.col("common")).select("vec_id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if n and len(flat) % n or len(set(pa.compute.list_value_length(column).to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1).astype(np.float64)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM,
                alpha: float = ALPHA) -> DataFrame:
    """``shard, index`` (binary) over ``vec_id, v``; every row is indexed."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard = Shard(rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks()), degree, beam, alpha)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(shard)], pa.binary())})

    # a number of partitions of its own: a shard is little data but long work, so it isn't coalesced with others
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "shard int, index binary")


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, blocks: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every query
    (``vec_id, v``) over all shards, by beam search in each shard's graph.

    Queries go in blocks of some thousands; each pair of block and shard is a task."""
    blocks = blocks or max(1, -(-queries.count() // (16 * QUERY_BLOCK)))
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")))
    last = index.agg(F.max("shard")).first()[0] or 0
    # a task for each pair of block and shard: a shard's index goes to every block
    pairs = asked.select("block", "queries", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))
    copies = index.select("shard", "index", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = pickle.loads(batch.column(0)[i].as_py())
                asked = batch.column(1)[i].values
                if not len(asked):
                    continue
                ids = asked.field("vec_id").to_numpy()
                position, found, score = shard.nearest(ids, _matrix(asked.field("v")), k, beam)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[position.astype(np.int64)]), pa.array(position.astype(np.int64)),
                     pa.array(found.astype(np.int64)), pa.array(score.astype(np.float64))],
                    ["query_id", "position", "vec_id", "score"])

    tasks = blocks * (last + 1)
    found = (pairs.repartition(tasks, "shard", "block").join(copies.repartition(tasks, "shard", "block"), ["shard", "block"])
             .select("index", "queries")
             .mapInArrow(run, "query_id long, position long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "position").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
