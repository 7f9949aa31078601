"""Operator 11: licence scan with a generalised suffix automaton of licence words.

The automaton (``Automaton``) holds every substring of all phrases and templates
in a state; it is built once from the fixed texts (about two thousand words) and
goes to the tasks with the function.  Each file's words are streamed through it
once: after every word the state and the length say which is the longest match
that ends there (the matching statistics).  From them come

* **base places**: a phrase ends at a word if its state lies on the suffix links
  of the word's state, so all places are found, those inside longer matches too;
* **long matches**: matches of at least ``MIN_MATCH`` words (the whole template
  where it is shorter) that the next word ends, at each of the template's places
  that their state stands for;
* **spans**: long matches of a template that follow each other in file and
  template, at most ``MAX_GAP`` words apart in both, are chained so that most
  template words are covered.  A chain that covers ``MIN_COVER`` of its template
  is a span and gives the template's label, unless it lies inside a longer span
  of another template; its matches go, and the rest is chained again.

``score`` is the largest covered share of any template or phrase (a phrase found
is covered whole).  Nothing is shuffled and a task holds one slice of whole texts.

Defined results: a NULL or empty text has no words, no labels and score 0;
repeated rows are each answered; an empty table has no rows.  Columns are taken
by name under internal names, so extra columns don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices
from .license_texts import PHRASES, TEMPLATES

MIN_MATCH = 5
MAX_GAP = 20
MIN_COVER = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = ("doc_id long, n_words long, places array<struct<label:string,word:long>>, "
          "spans array<struct<label:string,start:long,length:long,covered:long,template_words:long>>, score double")
_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("covered", pa.int64()),
                   ("template_words", pa.int64())])


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased
    (``bytes.lower`` changes nothing else; every byte from 0x80 belongs to a word)."""
    return _WORD.findall(text.lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]                 # (sequence, words up to the end)
        self.sequences = [list(s) for s in sequences]
        for number, words in enumerate(self.sequences):
            last = 0
            for k, w in enumerate(words):
                last = self._append(last, w)
                self.ends[last].append((number, k + 1))
        # a state's places are its own and those of the states whose suffix link it is
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, arcs: dict[bytes, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of the substrings of q that end an arc from p; taken out of q if q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _append(self, last: int, w: bytes) -> int:
        if w in self.next[last]:                                      # another sequence began like this one
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def find(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word, where there is one."""
        arcs, link, length, root = self.next, self.link, self.length, self.next[0]
        v = n = 0
        for i, w in enumerate(words):
            if w not in root:                                         # a word of no sequence
                v = n = 0
                continue
            to = arcs[v].get(w)
            while to is None:
                v = link[v]
                n = length[v]
                to = arcs[v].get(w)
            v = to
            n += 1
            yield i, v, n


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(words_of(t.encode()), label) for label, t in templates.items()]
        self.automaton = a = Automaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])
        own = {a.find(w): k for k, (w, _) in enumerate(self.phrases)}
        # phrases that end where a state's substrings end, shortest state first
        self.ending: list[tuple[int, ...]] = [()] * len(a.length)
        for v in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            self.ending[v] = self.ending[a.link[v]] + ((own[v],) if v in own else ())
        self.own = own
        # a template that is shorter than a long match counts when it is met whole
        self.least = [min(MIN_MATCH, len(w)) for w, _ in self.templates]
        self.floor = min(self.least, default=MIN_MATCH)

    def scan(self, words: list[bytes]):
        """(base places, spans, score) of a file's words."""
        places, matches = [], defaultdict(list)
        first_template = len(self.phrases)
        held: tuple[int, int, int] | None = None

        def close(i, v, n):
            for number, end in self.automaton.ends[v]:
                t = number - first_template
                if t >= 0 and n >= self.least[t]:
                    matches[t].append((i - n + 1, end - n, n))         # place in the file, in the template, words

        for i, v, n in self.automaton.statistics(words):
            for k in self.ending[v]:
                size = len(self.phrases[k][0])
                if n >= size:
                    places.append((self.phrases[k][1], i - size + 1))
            if held and not (i == held[0] + 1 and n == held[2] + 1):
                close(*held)
            held = (i, v, n) if n >= self.floor else None
        if held:
            close(*held)
        spans, best = [], 0.0
        for t in sorted(matches):
            whole = len(self.templates[t][0])
            left = sorted(matches[t])
            while left:
                covered, start, end = _chain(left)
                best = max(best, covered / whole)
                if covered < MIN_COVER * whole:
                    break
                spans.append((self.templates[t][1], start, end - start, covered, whole))
                left = [m for m in left if m[0] + m[2] <= start or m[0] >= end]
        spans = [s for s in spans if not any(o[0] != s[0] and o[2] > s[2] and o[1] <= s[1] and s[1] + s[2] <= o[1] + o[2]
                                             for o in spans)]
        return sorted(set(places), key=lambda x: (x[1], x[0])), sorted(spans, key=lambda s: (s[1], s[0])), \
            1.0 if places else best


def _chain(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(covered template words, start, end in the file) of the best chain of matches
    (file place, template place, words), sorted; ties: the earliest."""
    gain, first = [], []
    top = (0, 0, 0)
    longest = max(m[2] for m in matches)
    for i, (f, t, n) in enumerate(matches):
        best, start = n, f
        for j in range(i - 1, -1, -1):
            g, u, m = matches[j]
            if f - g > longest + MAX_GAP:
                break
            if g < f and u < t and g + m < f + n and u + m < t + n and f - (g + m) <= MAX_GAP and t - (u + m) <= MAX_GAP:
                # words that both cover count once
                total = gain[j] + n - max(0, g + m - f, u + m - t)
                if total > best:
                    best, start = total, first[j]
        gain.append(best)
        first.append(start)
        if best > top[0]:
            top = (best, start, f + n)
    return top


@cache
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``places`` (label and word of each phrase found),
    ``spans`` (label, start, length in the file, covered words, words of the template)
    and ``score``."""
    fixed = (tuple(phrases.items()), tuple(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*fixed)
        for batch in batches:
            for part in text_slices(batch):
                counts, places, spans, scores = [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    found, covered, score = scanner.scan(words)
                    counts.append(len(words))
                    places.append([dict(zip(("label", "word"), x, strict=True)) for x in found])
                    spans.append([dict(zip(("label", "start", "length", "covered", "template_words"), x, strict=True))
                                  for x in covered])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)),
                     pa.array(spans, pa.list_(_SPAN)), pa.array(scores, pa.float64())],
                    ["doc_id", "n_words", "places", "spans", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
