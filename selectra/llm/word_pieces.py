"""Ids of whole texts under a lower-casing word-level BPE vocabulary, by way of its distinct words.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its words in a row. A worker
process keeps the ids of the words it has met; only new words are split and encoded by the tokenizer's own model. The
kept words are bounded, and are met again where the bound empties them.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

KEPT_WORDS = 1_000_000
#: from here on the tokenizer itself splits; below are the Latin letters
BEYOND = "\u0250"
#: fixed value: the splitting pattern of the vocabulary file; white space is spelled out, because Python's \s has more
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


class _Kept(dict):
    """Values by key, computed when first asked for; emptied at a bound."""

    def __init__(self, compute: Callable, bound: int):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.compute(key)
        return value


@functools.cache
def word_encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    tokenizer = Tokenizer.from_file(path)
    model, specials = tokenizer.model, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    composed = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    special = regex.compile("|".join(map(regex.escape, specials)) or "(?!)")

    def of_part(part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        return of_spelled(part if plain else to_bytes.pre_tokenize_str(part)[0][0])

    def of_spelled(spelled: str) -> bytes:
        ids = [t.id for t in model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    parts = _Kept(of_part, KEPT_WORDS)

    def of_word(raw: bytes) -> bytes:
        word = raw.decode()
        if special.search(word):
            return np.array(tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if word.isascii():
            word = word.lower()
        elif max(word) >= BEYOND:  # letters on which two libraries' tables may differ
            pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(word))
            return b"".join(of_spelled(spelled) for spelled, _ in pieces)
        else:
            word = composed.normalize_str(word)
        if word.isalpha():  # one run of letters
            return parts[word]
        return b"".join(map(parts.__getitem__, PRE_TOKENS.findall(word)))

    words = _Kept(of_word, KEPT_WORDS)
    return lambda text: b"".join(map(words.__getitem__, text.encode().split()))
