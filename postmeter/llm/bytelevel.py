"""Ids of a byte-level vocabulary, fast for plain texts.

The merges of the vocabulary file are run by a library that is made for ranks of byte strings and
gives arrays. Both libraries split texts by the same pattern, but the classes of letters and marks
behind it follow the Unicode version that each was built with; texts with characters beyond old
and common blocks therefore go to the vocabulary's own library. The tests compare the ids.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Byte-level vocabularies show each byte as a printable character: itself, or one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

#: Latin, Greek and Cyrillic letters, dashes and quotation marks.
_OTHER = re.compile("[^\x00-ʯΑ-ΡΣ-ώЀ-џ‐-‧€]")


class ByteLevel:
    """Encodes texts; with ``special`` the strings of special tokens in a text are those tokens, as the file says."""

    def __init__(self, path: str, special: bool) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not special
        named = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
        shown = {i: t for t, i in self.own.get_vocab().items() if t not in named}
        #: The bytes of each token, none for special ones.
        self.bytes = [bytes(map(BYTE_OF.__getitem__, shown[i])) if i in shown else b"" for i in range(max(shown) + 1)]
        self.ranks = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens=named if special else {},
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        other = [i for i, t in enumerate(texts) if _OTHER.search(t)]
        found = self.own.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
        known = {i: np.array(e.ids, np.uint32) for i, e in zip(other, found, strict=True)}
        fast = self.ranks.encode_to_numpy
        return [known[i] if i in known else fast(t, allowed_special="all") for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def byte_level(path: str, special: bool) -> ByteLevel:
    return ByteLevel(path, special)
