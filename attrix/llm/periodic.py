"""Operator 12: runs of periodic words, by recursive frequency splitting.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) and at least ``max(MIN_WORDS, 2 q)`` words.  Inside a task,
over a slice of whole texts at once:

1. **Splitting.**  A run holds at least two whole periods, so each of its words
   occurs at least twice in any segment that holds the run.  A word that occurs
   once in its segment is in no run: it splits the segment.  Pieces shorter than
   ``MIN_WORDS`` go, the rest is counted again, until nothing splits.
2. **Lag scan** of the segments left.  For every lag q up to half the segment a
   qualifying run matches itself (word i = word i + q) on a stretch of q places or
   more, which covers a multiple of q; so only these places are looked at, m/q for
   each lag and m log m for a segment of m words.  A place stays when half the
   stretch on one of its sides has equal hash sums; the words themselves are then
   compared, outwards, to the ends of the stretch.  Places inside a run that is
   known already, whose period divides the lag, are passed over: their stretch is
   the same run.

Nothing is shuffled; memory is bounded by a slice (``SLICE_BYTES`` of text, or one
text that is longer) and ``PLACES`` looked at together.  A lost task repeats its
own rows only.

Defined results: a NULL or empty text has no words and no runs; repeated rows are
each answered; words are compared exactly, as bytes; the empty table has no rows.
Columns are taken by name under internal names, so extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MIN_WORDS = 12
PLACES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_segments(words: np.ndarray, bounds: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """``[start, end)`` of the segments left of ``words`` (codes); ``bounds`` are the
    starts of the texts and the end of the last one."""
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    span = int(words.max()) + 1 if len(words) else 1
    while len(at):
        # pieces that are too short go
        long = np.bincount(segment)[segment] >= least
        at, segment = at[long], segment[long]
        if not len(at):
            break
        _, inverse, count = np.unique(segment.astype(np.int64) * span + words[at], return_inverse=True, return_counts=True)
        common = count[inverse] >= 2
        if common.all():
            break
        at, old = at[common], segment[common]
        # a new piece starts behind a word that went and where the segment changes
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(old) > 0)
        segment = np.cumsum(new) - 1
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(segment) > 0])
    last = np.r_[first[1:], len(at)] - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist(), strict=True))


def _matching(words: np.ndarray, p: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest ``[a, b)`` around p in ``[low, high - q)`` with words[i] = words[i + q]."""
    b, step = p + 1, 64
    while b < high - q:
        end = min(high - q, b + step)
        off = np.flatnonzero(words[b:end] != words[b + q:end + q])
        if len(off):
            b += int(off[0])
            break
        b, step = end, step * 2
    a, step = p, 64
    while a > low:
        start = max(low, a - step)
        off = np.flatnonzero(words[start:a] != words[start + q:a + q])
        if len(off):
            a = start + int(off[-1]) + 1
            break
        a, step = start, step * 2
    return a, b


def _places(segments: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places to look at, lags ascending within a segment: (place, lag, segment start, segment end)."""
    held, size = [], 0
    for low, high in segments:
        m = high - low
        lag = 1
        while lag <= m // 2:
            # as many lags as make about PLACES places
            last = lag
            n = (m - 1) // lag
            while last < m // 2 and n + (m - 1) // (last + 1) <= PLACES:
                last += 1
                n += (m - 1) // last
            q = np.arange(lag, last + 1)
            count = (m - 1) // q                                  # places 0, q, 2q ... with place + q < m
            lags = np.repeat(q, count)
            k = np.arange(len(lags)) - np.repeat(np.cumsum(count) - count, count)
            held.append((low + k * lags, lags, np.full(len(lags), low), np.full(len(lags), high)))
            size += len(lags)
            lag = last + 1
            if size >= PLACES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def find_runs(words: np.ndarray, segments: list[tuple[int, int]], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs inside the segments, by start and period."""
    if not segments:
        return []
    rng = np.random.default_rng(12)
    mark = rng.integers(0, 1 << 63, int(words.max()) + 1, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mark[words], out=sums[1:])

    def alike(a, b, q):
        return sums[b] - sums[a] == sums[b + q] - sums[a + q]

    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int, int]]] = {}              # (start, end, period) of the runs that touch a block of words
    for p, q, low, high in _places(segments):
        same = words[p] == words[p + q]
        p, q, low, high = p[same], q[same], low[same], high[same]
        # a stretch of `need` places around p has half of them on one side
        half = (np.maximum(q, least - q) - 1) // 2
        right, left = p + half + 1, p - half
        ok = np.zeros(len(p), bool)
        fits = right + q <= high
        ok[fits] = alike(p[fits], right[fits], q[fits])
        fits = ~ok & (left >= low)
        ok[fits] = alike(left[fits], p[fits] + 1, q[fits])
        for at, lag, start, end in zip(p[ok].tolist(), q[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True):
            if any(s <= at and at + lag < e and lag % c == 0 for s, e, c in known.get(at >> 8, ())):
                continue
            a, b = _matching(words, at, lag, start, end)
            b += lag
            if b - a >= max(least, 2 * lag) and (a, b) not in found:
                found[a, b] = lag
                for block in range(a >> 8, (b - 1 >> 8) + 1):
                    known.setdefault(block, []).append((a, b, lag))
    return sorted((a, b, q) for (a, b), q in found.items())


def _coded(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their codes in a row, and where each text starts."""
    table: dict[bytes, int] = {}
    words = [_WORD.findall(t) if t else [] for t in texts]
    codes = np.fromiter((table.setdefault(w, len(table)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    return words, codes, np.concatenate([[0], np.cumsum([len(ws) for ws in words], dtype=np.int64)])


def _of_slice(texts: list[bytes | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs as (start, length, period), kept text) of each text."""
    words, codes, bounds = _coded(texts)
    runs: list[list] = [[] for _ in texts]
    for a, b, q in find_runs(codes, split_segments(codes, bounds, least), least):
        i = int(np.searchsorted(bounds, a, side="right")) - 1
        runs[i].append((a - int(bounds[i]), b - a, q))
    for ws, rs in zip(words, runs, strict=True):
        kept = ws
        if rs:
            # how many runs end their first period before a word and hold it
            gone = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in rs:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = [w for w, g in zip(ws, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
        yield len(ws), rs, b" ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` (structs start, length, period, by
    start and period) and ``kept_text``: the words left, joined by a space, when of
    every run only the first period stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                n, runs, kept = [], [], []
                for words, found, text in _of_slice(texts, least):
                    n.append(words)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    kept.append(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept_text"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); NULL without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"),
                                                 r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)
