"""Packing documents into fixed windows by the sum-of-squares rule.

Every document is its token ids and one end id.  Whole windows are cut off
long documents; the remainder goes, online, to the fill level that makes the
sum over levels of (number of windows at that level)^2 smallest.  The state is
one level array and at most ``OPEN`` open windows.  When more are open (pieces that
never add up to a window), and when a task's rows end, the emptiest open windows are
cut up to fill the fullest: half of the open ones in the first case, all of them at
the end.  So memory is bounded whatever the lengths, and a task leaves at most one
window that isn't full, which is cut at powers of two and needs no padding.

Each task packs its own rows: no shuffle, nothing gathered.  Window ids are
(task number, running number), so a rerun of a lost task makes the same rows.

Defined cases: NULL or empty text is the end id alone; NULL ``doc_id`` is kept
as NULL; repeated rows are packed as often as they occur; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import byte_bpe
from .common import picked, text_slices, tokenizer_path

WINDOW = 1024
#: Windows that may be open at once in a task (4 KB each).
OPEN = 2048
TASK_BITS = 36

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquaresPacker:
    """Online packing of one task's rows.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, first_id: int = 0):
        self.window = window
        self.next_id = first_id
        self.count = np.zeros(window + 1, np.int64)     # level array: open windows at each fill level
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []
        self.n_open = 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def _level_for(self, size: int) -> int:
        """Level to fill from; 0 opens a window.  Ties go to the fullest."""
        count, top = self.count, self.window - size
        before = count[1:top + 1]
        after = count[1 + size:top + size + 1].copy()
        if top:
            after[-1] = -1                               # a full window leaves the array: no growth
        change = 2 * (after - before)                    # of the sum of squares, less a constant 2
        change = np.where(before > 0, change + 2, np.iinfo(np.int64).max)
        if top:
            change[-1] = -2 * before[-1] + 1 if before[-1] else change[-1]
        opened = 2 * count[size] + 1
        if top:
            best = top - 1 - int(np.argmin(change[::-1]))
            if before[best] and change[best] <= opened:
                return best + 1
        return 0

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self._close([(doc_id, at // 4, ids[at:at + step], total)])
        if whole == len(ids):
            return
        piece = (doc_id, whole // 4, ids[whole:], total)
        size = total - whole // 4
        level = self._level_for(size)
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        self.n_open -= level > 0
        pieces.append(piece)
        level += size
        if level == self.window:
            self._close(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1
            if self.n_open > OPEN:
                self._fill(OPEN // 2)

    def _fill(self, keep: int) -> list[list]:
        """Fill the fullest open windows with cut pieces of the emptiest until ``keep``
        are open (or one is); returns what is left, which stays open."""
        left = [w for level in self.open for w in level]           # emptiest first
        lo, hi = 0, len(left) - 1
        while lo < hi and hi - lo + 1 > keep:
            room = self.window - sum(len(p[2]) // 4 for p in left[hi])
            while room and lo < hi:
                if not left[lo]:
                    lo += 1
                    continue
                doc_id, start, ids, total = left[lo].pop()
                n = len(ids) // 4
                if n > room:
                    left[lo].append((doc_id, start, ids[:4 * (n - room)], total))
                    start, ids, n = start + n - room, ids[4 * (n - room):], room
                left[hi].append((doc_id, start, ids, total))
                room -= n
            if room:
                break
            self._close(left[hi])
            hi -= 1
        left = [w for w in left[lo:hi + 1] if w]
        self.open = [[] for _ in range(self.window + 1)]
        for w in left:
            self.open[sum(len(p[2]) // 4 for p in w)].append(w)
        self.count[:] = list(map(len, self.open))
        self.n_open = len(left)
        return left

    def finish(self) -> None:
        """Close all windows; the last one is cut into powers of two."""
        rest = [p for w in self._fill(1) for p in w]
        size = sum(len(p[2]) // 4 for p in rest)
        while size:
            take = 1 << (size.bit_length() - 1)
            size -= take
            head = []
            while take:
                doc_id, start, ids, total = rest.pop(0)
                n = len(ids) // 4
                if n > take:
                    rest.insert(0, (doc_id, start + take, ids[4 * take:], total))
                    ids, n = ids[:4 * take], take
                head.append((doc_id, start, ids, total))
                take -= n
            self._close(head)
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.n_open = 0

    def take(self) -> pa.RecordBatch | None:
        if not self.done:
            return None
        columns = list(zip(*self.done, strict=True))
        self.done = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: their ids (little-endian unsigned 32-bit) and
    where they lie (``sequence_id``, ``offset``)."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe.encoder(path).encode
        packer = SumOfSquaresPacker(window, TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            for part in text_slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, encode(text) + end)
                if (out := packer.take()) is not None:
                    yield out
        packer.finish()
        if (out := packer.take()) is not None:
            yield out

    return picked(docs, id_col, text_col).mapInArrow(run, SCHEMA)
