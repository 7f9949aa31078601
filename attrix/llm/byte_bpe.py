"""Byte-level BPE ids of whole texts.

The ids are those of the ``tokenizers`` file; they are computed from the rank
file of the same vocabulary, which is several times faster.  Two kinds of text
go to ``tokenizers``: one that holds a special token's string, whose rule for it
holds, and one with a long run of white space, on which the rank file's regular
expression runs out of stack (at a million characters).
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array

#: White-space characters in a row from which ``tokenizers`` encodes the text.
LONG_RUN = 100_000
_SPACES = re.compile(r"\s+")


def _long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _SPACES.finditer(text))


class TextEncoder:
    """``encode(text)`` -> ids as little-endian uint32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _long_run(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
