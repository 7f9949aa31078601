"""Language ID by a small convolutional network over bytes, trained in numpy.

A window of bytes (fixed length) goes through one-hot filters of width 2, 3 and
4, max pooling over the window, ReLU and softmax.  A filter bank over one-hot
bytes is a sum of rows of pair tables, so applying it is two table look-ups a
position.  A text is predicted from all its windows: the mean of their class
probabilities, weighted by their bytes.

Training rows are a bounded sample of the labelled texts: up to
``docs_per_language`` documents of each language (smallest hash of the id) and
up to ``windows_per_doc`` windows of each, spread over the whole text.  Spark
cuts the windows; the driver gets at most docs x windows x 512 bytes for each
language, and trains one fixed-size model.

Defined cases: text that is NULL or holds no letter is ``und`` with score 0;
with no labelled rows every text is ``und`` with score 0; rows with NULL label
aren't learned from.  Equal probabilities go to the language first in order.
Repeated rows get equal predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES

WINDOW = 512
FILTERS = 8
CLASSES = 128
DOCS_PER_LANGUAGE = 250
WINDOWS_PER_DOC = 4
UNKNOWN = "und"


def _byte_classes() -> np.ndarray:
    """256 bytes -> 128 classes: 0 padding, letters by lower case, digits,
    white space and other ASCII by kind, bytes from 0x80 (nearly) one by one."""
    kind = np.full(256, 1, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = 2 + ord(c.lower()) - 97 if c.isalpha() else 28 if c.isdigit() else 29 if c.isspace() else 1
    kind[0x80:0xC0] = 30 + np.arange(64)
    kind[0xC0:0xE0] = 94 + np.arange(32)
    kind[0xE0:] = 126
    return kind


KIND = _byte_classes()


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """Byte classes of all windows of a text, the last one padded with 0."""
    n = max(1, -(-len(text) // length))
    out = np.zeros(n * length, np.uint8)
    out[:len(text)] = KIND[np.frombuffer(text, np.uint8)]
    return out.reshape(n, length)


@dataclass
class ByteCnn:
    languages: list[str]
    conv: list[np.ndarray]      # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray            # (3 * FILTERS,)
    out: np.ndarray             # (3 * FILTERS, languages)
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        return cls(languages, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in (2, 3, 4)],
                   np.zeros(3 * FILTERS, np.float32),
                   rng.normal(0, 0.3, (3 * FILTERS, len(languages))).astype(np.float32),
                   np.zeros(len(languages), np.float32))

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, the pair tables whose rows are summed (a single column as the last)."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        w2, w3, w4 = self.conv
        return [[pair(w2[0], w2[1])], [pair(w3[0], w3[1]), w3[2]], [pair(w4[0], w4[1]), pair(w4[2], w4[3])]]

    def pooled(self, x: np.ndarray, tables: list, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max over positions of every filter, (n, 3 * FILTERS), and the positions."""
        code = x.astype(np.intp)
        pairs = code[:, :-1] * CLASSES + code[:, 1:]
        rows = lambda table, at: np.take(table, at, axis=0, mode="clip")
        best, at = [], []
        for parts in tables:
            if len(parts) == 1:
                y = rows(parts[0], pairs)
            elif len(parts[1]) == CLASSES:
                y = rows(parts[0], pairs[:, :-1])
                y += rows(parts[1], code[:, 2:])
            else:
                y = rows(parts[0], pairs[:, :-2])
                y += rows(parts[1], pairs[:, 2:])
            if where:
                y = np.ascontiguousarray(y.transpose(0, 2, 1))
                at.append(y.argmax(axis=2))
                best.append(np.take_along_axis(y, at[-1][..., None], 2)[..., 0])
            else:
                best.append(_max_over_positions(y))
        return np.concatenate(best, 1) + self.bias, np.concatenate(at, 1) if where else None

    def probabilities(self, x: np.ndarray, tables: list | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = []
        for i in range(0, len(x), 64):
            pooled, _ = self.pooled(x[i:i + 64], tables)
            out.append(_softmax(np.maximum(pooled, 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01,
              seed: int = 11) -> ByteCnn:
        """Adam on cross-entropy; max pooling passes gradient to the best position."""
        rng = np.random.default_rng(seed)
        values = [*self.conv, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xs, ys = x[order[i:i + batch]], y[order[i:i + batch]]
                pooled, at = self.pooled(xs, self.tables(), where=True)
                hidden = np.maximum(pooled, 0)
                d = _softmax(hidden @ self.out + self.out_bias)
                d[np.arange(len(ys)), ys] -= 1
                d /= len(ys)
                d_hidden = (d @ self.out.T) * (pooled > 0)
                grads = []
                rows = np.arange(len(ys))[:, None]
                for k, w in enumerate(self.conv):
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    g = np.zeros_like(w)
                    for j in range(len(w)):
                        np.add.at(g[j], (xs[rows, at[:, part] + j], np.arange(FILTERS)[None]), d_hidden[:, part])
                    g[:, 0] = 0                                 # padding has no weight
                    grads.append(g)
                grads += [d_hidden.sum(0), hidden.T @ d, d.sum(0)]
                step += 1
                for p, g, a, b in zip(values, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its probability, for whole texts."""
        tables = self.tables()
        sums = np.zeros((len(texts), len(self.languages)))
        held, owner, count = [], [], 0

        def apply() -> None:
            x = np.concatenate(held)
            weight = (x > 0).sum(1).astype(np.float64)
            np.add.at(sums, np.concatenate(owner), self.probabilities(x, tables) * weight[:, None])

        for i, text in enumerate(texts):
            x = windows_of(text)
            held.append(x)
            owner.append(np.full(len(x), i))
            count += len(x)
            if count >= 4096:
                apply()
                held, owner, count = [], [], 0
        if held:
            apply()
        sums /= np.maximum(sums.sum(1, keepdims=True), 1e-300)
        best = sums.argmax(1)
        return best, sums[np.arange(len(texts)), best]


def _max_over_positions(y: np.ndarray) -> np.ndarray:
    """``y.max(axis=1)`` by halves, each a long contiguous maximum."""
    n = y.shape[1]
    while n > 1:
        half = (n + 1) // 2
        y = np.maximum(y[:, :half], y[:, n - half:n])
        n = half
    return y[:, 0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> ByteCnn | None:
    """Train on a bounded sample of the rows with a label; None without any."""
    rows = labelled.select(labelled[label_col].cast("string").alias("label"),
                           labelled[text_col].cast("string").alias("text"),
                           F.xxhash64(labelled[id_col].cast("string")).alias("order")) \
        .where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # one narrow pass: how many rows each label has, so that a hash bound keeps about the wanted number
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    span = 1 << 20
    bound = F.create_map(*[x for k, n in sizes.items()
                           for x in (F.lit(k), F.lit(min(span, int(span * 1.3 * docs_per_language / n) + 1)))])
    # whole windows spread over the whole text, cut by Spark
    n = F.greatest(F.lit(1), F.ceil(F.char_length("text") / WINDOW).cast("int"))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)),
                                         lambda i: F.floor(i * n / F.lit(windows_per_doc)).cast("int")))
    cut = (rows.where(F.pmod("order", F.lit(span)) < bound[F.col("label")])
           .select("label", "order", F.transform(picks, lambda i: F.substring(F.col("text"), i * WINDOW + 1, F.lit(WINDOW)))
                   .alias("parts")))
    sample = cut.orderBy("order", "label", "parts").limit(2 * docs_per_language * len(sizes)).collect()
    languages = sorted(sizes)
    index = {x: i for i, x in enumerate(languages)}
    x, y, taken = [], [], dict.fromkeys(languages, 0)
    for r in sample:
        if taken[r["label"]] < docs_per_language:
            taken[r["label"]] += 1
            w = np.concatenate([windows_of(p.encode())[:1] for p in r["parts"]])
            x.append(w)
            y.append(np.full(len(w), index[r["label"]]))
    if not x:
        return None
    return ByteCnn.new(languages).train(np.concatenate(x), np.concatenate(y))


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` (as struct ``row``) with ``lang_pred`` and ``score``."""
    text: Column = docs[text_col].cast("string")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                      F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if model is None:
        return row.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    # only the texts go to Python, a few MB at a time; the rows stay where they are
    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        held, size = [], 0
        for i, t in enumerate(texts):
            held.append(b"" if t is None else t.encode())
            size += len(held[-1])
            if size > SLICE_BYTES or i + 1 == len(texts):
                best, score = model.predict(held)
                names += [model.languages[b] for b in best]
                scores.append(score)
                held, size = [], 0
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    return (row.withColumn("guess", F.when(F.col("text").isNotNull(), guess("text")))
            .select("row", F.coalesce("guess.lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                    F.coalesce("guess.score", F.lit(0.0)).alias("score")))
