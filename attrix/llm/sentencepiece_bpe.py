"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of the vocabulary continues behind a space, and none holds a line
feed, so a text falls into words (a run of spaces and what follows it) that
never merge with each other.  The distinct words of a slice lie in one flat
symbol array.  A round looks up the rank of every neighbouring pair, takes
each word's minimum (segmented), merges all its occurrences from the left, and
compacts the array; words without a pair left drop out.

Merging all occurrences at once equals the library's one-at-a-time order as
long as a merge makes no pair of a rank as good or better.  A word where that
happens after several merges in one round is redone with the exact queue.

Characters outside the vocabulary become byte pieces.  Empty or NULL text has
no ids and decodes to the empty text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, text_slices, tokenizer_path

SPACE = "▁"
_WORDS = re.compile(f" *[^ \n]+| +|\n")
NONE = np.iinfo(np.int32).max


class PieceTable:
    """Pieces, ranks and the table of pairs that merge, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if not special[i] and not is_byte[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word boundary: this vocabulary can't be cut into words")
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if is_byte[i]:
                self.byte_id[int(names[i][3:5], 16)] = i
        scores = {p: model.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # symbols: the pieces by id; single characters inside pieces that are none by themselves get numbers from n
        self.symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol))
        self.name = {i: p for p, i in self.symbol.items()}
        pairs = [(self.symbol[p[:k]], self.symbol[p[k:]], order[scores[p]], i) for p, i in self.ids.items()
                 for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.pairs = {(a, b): (r, i) for a, b, r, i in pairs}
        self.wide = n + len(self.symbol) + 2
        keys = np.array([a * self.wide + b for a, b, _, _ in pairs], np.int64)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.rank = np.array([x[2] for x in pairs], np.int32)[at]
        self.made = np.array([x[3] for x in pairs], np.int32)[at]
        self.pieces = n
        # decoding: the bytes of each id; byte pieces by their value
        self.text = [b""] * n
        self.value = np.full(n, -1, np.int32)
        for i in range(n):
            if is_byte[i]:
                self.value[i] = int(names[i][3:5], 16)
                self.text[i] = bytes([self.value[i]])
            elif model.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not special[i]:
                self.text[i] = names[i].replace(SPACE, " ").encode()

    # ---- encoding -------------------------------------------------------
    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each word; words begin with their spaces."""
        text = "".join(words).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        # a character outside the vocabulary is minus its code point and never merges
        known = np.array([self.symbol.get(chr(c), -int(c) - 1) for c in distinct], np.int64)
        symbol = known[inverse]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        last = np.full(len(words), -1, np.int32)      # rank of the word's last round, if it merged several
        redo: list[int] = []
        ended_words, ended_symbols = [], []
        while len(symbol):
            at = np.flatnonzero((word[:-1] == word[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0))
            rank = np.full(len(symbol), NONE, np.int32)
            made = np.zeros(len(symbol), np.int64)
            rank[at], made[at] = self.lookup(symbol[at], symbol[at + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(word)])
            again = (last[word[first]] >= 0) & (least <= last[word[first]])
            redo.extend(word[first][again].tolist())
            ended = (least == NONE) | again
            if ended.any():
                stay, finished = np.repeat(~ended, size), np.repeat(ended & ~again, size)
                ended_words.append(word[finished])
                ended_symbols.append(symbol[finished])
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                least, size = least[~ended], size[~ended]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # overlapping candidates (neighbouring positions): every second one from the left
            start = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            in_word = word[at]
            last[in_word] = -1
            several = in_word[:-1][in_word[:-1] == in_word[1:]]
            last[several] = rank[at[:-1]][in_word[:-1] == in_word[1:]]
            symbol[at] = made[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, word = symbol[stay], word[stay]
        for w in redo:
            exact = self.merge_in_order(words[w].replace(" ", SPACE))
            ended_words.append(np.full(len(exact), w))
            ended_symbols.append(np.array(exact, np.int64))
        if not ended_words:
            return [b""] * len(words)
        word, symbol = np.concatenate(ended_words), np.concatenate(ended_symbols)
        order = np.argsort(word, kind="stable")
        word, ids = self._with_bytes(word[order], symbol[order])
        edge = 4 * np.searchsorted(word, np.arange(len(words) + 1))
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece replaced by the byte pieces of their character."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.pieces))
        if not len(odd):
            return word, symbol
        run = {s: self.byte_id[list((chr(-s - 1) if s < 0 else self.name[s]).encode())]
               for s in np.unique(symbol[odd]).tolist()}
        times = np.ones(len(symbol), np.int64)
        runs = [run[s] for s in symbol[odd].tolist()]
        times[odd] = [len(r) for r in runs]
        ids = np.repeat(symbol, times)
        start = np.cumsum(times) - times
        width = times[odd]
        inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        ids[np.repeat(start[odd], width) + inside] = np.concatenate(runs)
        return np.repeat(word, times), ids

    def merge_in_order(self, word: str) -> list[int]:
        """The library's order: best rank first, ties from the left."""
        symbol = [self.symbol.get(c, -ord(c) - 1) for c in word]
        before, after = list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbol) and (hit := self.pairs.get((symbol[i], symbol[j]))):
                heapq.heappush(queue, (hit[0], i, j, symbol[i], symbol[j], hit[1]))

        for i in range(len(symbol) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b, made = heapq.heappop(queue)
            if symbol[i] != a or symbol[j] != b or after[i] != j:
                continue
            symbol[i], symbol[j] = made, None
            after[i] = after[j]
            if after[j] < len(symbol):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbol if s is not None]

    # ---- decoding -------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        value = self.value[ids]
        if (value >= 0x80).any():
            parts, at = [], 0
            is_byte = np.r_[value >= 0, False]
            edges = np.flatnonzero(np.diff(np.r_[False, is_byte]))
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                parts.append(b"".join([self.text[i] for i in ids[at:s].tolist()]).decode())
                parts.append(_decode_bytes(bytes(value[s:e].astype(np.uint8))))
                at = e
            parts.append(b"".join([self.text[i] for i in ids[at:].tolist()]).decode())
            text = "".join(parts)
        else:
            text = b"".join([self.text[i] for i in ids.tolist()]).decode()
        return text[1:] if text.startswith(" ") and value[0] < 0 else text


def _decode_bytes(run: bytes) -> str:
    """UTF-8 of a run of byte pieces; each stray byte is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[:e.start].decode() + "�" + _decode_bytes(run[e.start + 1:])


class WordCache(dict):
    """word -> ids as little-endian bytes; cleared when it outgrows its bound."""

    def __init__(self, table: PieceTable, max_words: int = 400_000):
        super().__init__()
        self.table, self.max_words = table, max_words

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_WORDS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self) > self.max_words:
            self.clear()
        new = list({w for words in cut for w in words} - self.keys())
        if new:
            self.update(zip(new, self.table.encode_words(new), strict=True))
        return [b"".join(map(self.__getitem__, words)) for words in cut]


_CACHES: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    """One table and word cache per worker process."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(PieceTable(path))
    return _CACHES[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row's whole text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache(path)
        for batch in batches:
            for part in text_slices(batch):
                ids = words.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` and the ``decoded`` text; NULL ids decode to the empty text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cache(path).table
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(1)
                flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
                texts = [table.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    return (encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
            .mapInArrow(run, "doc_id long, ids array<int>, decoded string"))
