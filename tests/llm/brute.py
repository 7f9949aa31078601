"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def low(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rank_id(i) -> tuple:
    """NULL ids below every id."""
    return (i is not None, i or 0)


def line_dedup(docs: list[tuple], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """(n_lines, n_dropped, kept) of each (doc_id, text) row; rows of equal id are one document."""
    cut = [(d, (t or "").split("\n")) for d, t in docs]
    held = defaultdict(set)
    for d, lines in cut:
        for k in {low(x.strip(SPACE)) for x in lines}:
            held[k].add(rank_id(d))
    out = []
    for d, lines in cut:
        kept = []
        for x in lines:
            k = low(x.strip(SPACE))
            if len(k) < min_chars or len(held[k]) < min_docs or rank_id(d) == max(held[k]):
                kept.append(x)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def substring_dedup(docs: list[tuple], n: int = 13) -> list[tuple]:
    """(n_words, n_removed, kept words) of each row; a NULL id ranks above every id."""
    top = 1 << 62
    first: dict = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            first[k] = min(first.get(k, top), top if d is None else d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < (top if d is None else d):
                gone[i:i + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


def simhash(t: str | None, n: int = 4) -> int:
    import xxhash
    w = words(low(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], distance: int = 4) -> list[int]:
    """Index of the component of each fingerprint."""
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            near = [comp[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= distance]
            if min(near) < comp[i]:
                comp[i], changed = min(near), True
    return comp
