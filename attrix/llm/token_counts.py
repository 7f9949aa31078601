"""Token counts under a unigram vocabulary, without making the tokens.

The vocabulary is the pieces and scores of a SentencePiece file, read as a
unigram model: a text's tokens are the pieces of best total score.  For each
distinct word an Aho-Corasick automaton lists every piece that occurs in it;
dynamic programming over end positions carries the best score and the number of
pieces on that path.  No piece continues behind a space, so words are
independent and a text's count is the sum over its words.

Tie rule of the tokenizer: a path replaces the best one at a position only if
its score is strictly higher, and paths are offered by ascending start, so of
equal scores the longest last piece stays.  A character that no single-character
piece covers may also be taken as unknown, at ten below the lowest score, and
counts as its UTF-8 bytes.  Scores are added in double precision.

Empty or NULL text counts 0 with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import picked, text_slices, tokenizer_path
from .sentencepiece_bpe import _WORDS, SPACE

UNKNOWN_PENALTY = 10.0


class UnigramCounter(dict):
    """word -> (count, score), computed when missing; cleared when it outgrows its bound."""

    def __init__(self, scores: dict[str, float], max_words: int = 400_000):
        import ahocorasick
        super().__init__()
        self.max_words = max_words
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), float(s)))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self[word] = self.best(word.replace(" ", SPACE))
        return found

    def best(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best path through one word."""
        n = len(word)
        score: list = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        done, single = 0, self.single

        def unknowns(upto: int) -> None:
            # positions that no piece ends at: only the unknown character leads there
            nonlocal done
            while done < upto:
                c = word[done]
                if c not in single:
                    s = score[done] + self.unknown
                    if score[done + 1] is None or s > score[done + 1]:
                        score[done + 1], count[done + 1] = s, count[done] + len(c.encode())
                done += 1

        for end, (length, piece) in self.automaton.iter(word):
            if done < end:
                unknowns(end)
            start = end + 1 - length
            s = score[start] + piece
            if score[end + 1] is None or s > score[end + 1]:
                score[end + 1], count[end + 1] = s, count[start] + 1
        unknowns(n)
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if len(self) > self.max_words:
            self.clear()
        found = list(map(self.__getitem__, _WORDS.findall(" " + text.replace(SPACE, " "))))
        return sum([c for c, _ in found]), float(sum([s for _, s in found]))


def unigram_scores(path: str) -> dict[str, float]:
    """Ordinary pieces of a SentencePiece file with their scores."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in scores):
        raise ValueError("a piece crosses a word boundary: this vocabulary can't be cut into words")
    return scores


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One automaton and word cache per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(unigram_scores(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score`` of every row's whole text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path)
        for batch in batches:
            for part in text_slices(batch):
                found = [words.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c for c, _ in found], pa.int64()),
                     pa.array(np.array([s for _, s in found], np.float64))], ["doc_id", "n_tokens", "score"])

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")
