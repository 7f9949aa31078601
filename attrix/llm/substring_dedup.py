"""Substring deduplication by shared windows of words over reference blocks.

Words are runs of non-white space.  The reference of a document is every document
of smaller id.  Each run of ``window`` words that occurs there (known by 80 bits
of hash) is marked, and marked windows that overlap or touch make one duplicate
span.  This is no Lempel-Ziv parse: nothing is matched word by word, and a span
has no place in the reference.  Every window is judged, also one over the
boundary of two passages, so no passage of ``window`` words or more is lost.

The reference is cut into blocks of bounded size (documents dealt by hash), and
every block indexes its own windows.  What blocks exchange is small:

1. Each block publishes the anchors of its windows: the least hash of the
   five-word runs inside a window.  Equal windows have equal anchors, and about
   one word in five is one.  Anchors that two blocks hold are returned to them.
2. Of windows with such an anchor (candidates), each block publishes an 80-bit
   hash and the smallest id that holds it.  Where another block has a smaller
   id, the window is returned.
3. Each block marks the windows of its documents: a window occurs in the reference if it was
   returned or if the block itself has it under a smaller id.

A block sends one row for each distinct anchor or window, so a passage or a copy
that a third of all documents hold has at most one row a block; no group is
ever gathered.  The three steps read one exchange of the texts.

Defined cases: NULL or empty text has no words.  Equal ids (repeated rows) are
not smaller, so they don't remove each other's words.  A NULL ``doc_id`` ranks
above every id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOW = 13
#: Words of an anchor: more of them are shared by chance less often, so fewer
#: windows are in question; fewer of them make fewer anchors (2 in WINDOW - RUN + 2 words).
RUN = 5
BLOCK_BYTES = 8 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = np.iinfo(np.int64).max


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of all words one after another, the number of words of each text, the words."""
    import xxhash
    words = [t.encode().split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(count.sum()))
    return flat, count, words


def _rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``n`` words."""
    size = len(h) - n + 1
    out = h[:size].copy()
    for j in range(1, n):
        out *= base
        out += h[j:j + size]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least_of(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (n - width)], h[n - width:]) if n > width else h


class Windows:
    """All windows of a block's documents that lie inside one document."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        h, self.count, self.words = word_hashes(texts)
        owner = np.repeat(np.arange(len(texts)), self.count)
        run = min(RUN, window)
        if len(h) < window:
            self.at = np.zeros(0, np.int64)
        else:
            self.at = np.flatnonzero(owner[:len(h) - window + 1] == owner[window - 1:])
        self.owner, self.window, self.h = owner, window, h
        self.doc = owner[self.at]
        self.anchor = (_least_of(_mixed(_rolled(h, run, _B1)), window - run + 1)[self.at]
                       if len(self.at) else np.zeros(0, np.uint64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 16 further bits of every window's hash."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        return (_mixed(_rolled(self.h, self.window, _B2))[self.at],
                (_mixed(_rolled(_mixed(self.h), self.window, _B1))[self.at] >> np.uint64(48)).astype(np.uint16))


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _first_holders(h: np.ndarray, c: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by hash, the starts of equal ones, the smallest id of each."""
    order = np.argsort(h)
    h, c = h[order], c[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    return order, start, np.minimum.reduceat(ids[order], start)


def _column(table: pa.Table, name: str, kind=None) -> np.ndarray:
    a = table.column(name).to_numpy()
    return a if kind is None else a.view(kind)


def _ids(table: pa.Table) -> np.ndarray:
    return pa.compute.fill_null(table.column("doc_id"), _NO_ID).to_numpy()


def _publish_anchors(window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        a = np.unique(Windows(docs.column("text").to_pylist(), window).anchor)
        return pa.table({"anchor": pa.array(a.view(np.int64)), "block": pa.array(np.full(len(a), key[0].as_py(), np.int32))})
    return run


def _publish_windows(window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = {"block": np.zeros(0, np.int32), "low": np.zeros(0, np.int64), "h": np.zeros(0, np.int64), "c": np.zeros(0, np.int32)}
        if docs.num_rows and shared.num_rows:
            w = Windows(docs.column("text").to_pylist(), window)
            some = np.flatnonzero(_member(w.anchor, np.sort(_column(shared, "anchor", np.uint64))))
            if len(some):
                h, c = w.keys()
                h, c = h[some], c[some]
                order, start, low = _first_holders(h, c, _ids(docs)[w.doc[some]])
                out = {"block": np.full(len(start), key[0].as_py(), np.int32), "low": low,
                       "h": h[order][start].view(np.int64), "c": c[order][start].astype(np.int32)}
        return pa.table({k: pa.array(v) for k, v in out.items()})
    return run


def spans_of(occurs: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Duplicate spans [start, end) of one document from its window starts that occur."""
    hits = at[occurs]
    if not len(hits):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(hits) > window])      # a gap of more than a window: a new span
    ends = np.r_[hits[new[1:] - 1], hits[-1]] + window
    return list(zip(hits[new].tolist(), ends.tolist(), strict=True))


def _factor(window: int, schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        w = Windows(docs.column("text").to_pylist(), window)
        ids = _ids(docs)
        occurs = np.zeros(len(w.at), bool)
        if len(w.at):
            h, c = w.keys()
            own = ids[w.doc]
            order, start, low = _first_holders(h, c, own)
            occurs[order] = np.repeat(low, np.diff(np.r_[start, len(order)])) < own[order]
            if found.num_rows:
                fh, fc = _column(found, "h", np.uint64), _column(found, "c").astype(np.uint16)
                by = np.lexsort((fc, fh))
                fh, fc = fh[by], fc[by]
                at = np.searchsorted(fh, h)
                for step in range(int(np.bincount(np.unique(fh, return_inverse=True)[1]).max())):  # equal 64 bits: compare all
                    k = np.minimum(at + step, len(fh) - 1)
                    occurs |= (fh[k] == h) & (fc[k] == c)
        first = np.cumsum(w.count) - w.count
        edge = np.searchsorted(w.doc, np.arange(docs.num_rows + 1))
        removed, spans, kept = [], [], []
        for i, words in enumerate(w.words):
            part = slice(edge[i], edge[i + 1])
            s = spans_of(occurs[part], w.at[part] - first[i], window)
            left, at = [], 0
            for a, b in s:
                left += words[at:a]
                at = b
            left += words[at:]
            spans.append([{"start": a, "end": b} for a, b in s])
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return pa.Table.from_arrays(
            [docs.column("doc_id").combine_chunks(), docs.column("rest").combine_chunks().cast(schema.field("rest").type), docs.column("text").combine_chunks(),
             pa.array(w.count), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "rest", "text", "n_words", "n_removed", "spans", "kept_text"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rest`` (struct of the other columns), ``text, n_words, n_removed,
    spans`` (word positions [start, end)) and ``kept_text`` of every row."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                       F.struct(F.lit(0).alias("_"), *[docs[f"`{c}`"] for c in others]).alias("rest"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    by_block = rows.groupBy("block")
    anchors = by_block.applyInArrow(_publish_anchors(window), "anchor long, block int")
    shared = (anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
              .where("n > 1").select("block", "anchor"))
    held = by_block.cogroup(shared.groupBy("block")).applyInArrow(_publish_windows(window), "block int, low long, h long, c int")
    found = (held.withColumn("least", F.min("low").over(Window.partitionBy("h", "c")))
             .where("low > least").select("block", "h", "c"))
    schema = (f"doc_id long, rest {rows.schema['rest'].dataType.simpleString()}, text string, n_words long, n_removed long, "
              "spans array<struct<start:long,end:long>>, kept_text string")
    empty = to_arrow_schema(StructType.fromDDL(schema))
    return by_block.cogroup(found.groupBy("block")).applyInArrow(_factor(window, empty), schema)
