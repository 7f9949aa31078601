"""Small tables with everything awkward in them."""

from __future__ import annotations

import random

#: names that operators use inside; extra input columns of these names must not matter
CLASHING = ["pos", "key", "line", "h1", "h2", "row", "rest", "block", "fp", "root", "low", "at", "text_hash", "dropped",
            "lent", "next_keys", "keys", "cells", "label", "order", "score", "window", "part", "number", "shard", "kept"]

WORDS = "the of and to in is was for that with on by at from le la des und der que el".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "ing", "tion", "é", "ß", "123", "A"])
        out.append(w + ("\n" if i % 17 == 16 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def texts(seed: int = 3) -> list:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(14)]
    passage = prose(rng, 40).replace("\n", " ")
    line = "A Line that Many documents repeat\t"
    some = [None, "", " ", "\n", "\n\n \n", "x", "é", "1234 5678", "ÀÉ line\r\nnext \x0b\x0c end", "😀 ▁ \x00 z", "a  b   c"]
    some += base + [base[0], base[0], base[1] + " tail", base[2].replace("the", "teh", 1)]
    some += [b + " " + passage + " " + base[(i + 3) % 14] for i, b in enumerate(base[:5])]
    some += [line + "\n" + b for b in base[5:9]] + [" a line that many documents REPEAT\n" + line + "\n" + line]
    some += [prose(rng, 6000), "w" * 20_000, " ".join(["same"] * 3000), "\n".join(f"paragraph {i % 700}" for i in range(1500))]
    return some


def table(spark, with_null_id: bool = True, clashing: bool = True):
    """``doc_id, text, lang, source, n_chars`` and clashing extra columns; two rows repeat wholly."""
    rows = []
    for i, t in enumerate(texts()):
        rows.append((i * 7 % 101, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t)))
    rows += [rows[14], rows[14]]                                   # the same row three times
    if with_null_id:
        rows.append((None, rows[15][1], "en", None, 5))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clashing:
        rows = [r + tuple([7] * len(CLASHING)) for r in rows]
        schema += "".join(f", `{c}` long" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
