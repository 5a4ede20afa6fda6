"""Whole texts to ids of the public tokenizers, with a bounded memory of units met before.

A unit is a stretch of text at whose borders the tokenizer always cuts, so that a text's ids are
those of its units in a row. A unit's ids come from the tokenizers library; for words of a byte-level
vocabulary that also comes as a file of ranks, from the same merges by way of tiktoken, which are the same ids.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

#: Units kept in a worker's memory, in two generations of half as many: when the young one is full, it becomes the old one,
#: and what was in the old one is forgotten unless it was met since. This costs time but changes no id.
MOST_UNITS = 800_000

#: White space other than space, tab, LF and CR, as UTF-8. A text with any of it isn't cut into units by gaps.
_ODD_LEADS = b"\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"
_ODD_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
#: A gap goes with the word after it, as a byte-level tokenizer joins a space to the word.
_GAP_WORDS = re.compile(rb"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_LETTERS = re.compile(rb" ?" + _LETTER + rb"+").fullmatch  # of ASCII or U+00C0 to U+00FF
#: A line's end, a word and the signs after it, each cut off from the next.
_PARTS = re.compile(rb"(\n)?( ?" + _LETTER + rb"+)([.,;:!?|]+)?").fullmatch

#: Plain texts: ASCII and the letters of U+00C0 to U+00FF only, no apostrophe (it starts contractions).
_NOT_PLAIN = re.compile(rb"['\xc2\xc4-\xff]|\xc3[\x97\xb7]").search
_RUNS = re.compile(rb"[a-z\x80-\xc3]+|[0-9]|[^0-9a-z\x80-\xc3\s]+").findall


class Units(dict):
    """Unit to its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, unit: bytes) -> bytes:
        if len(self) >= MOST_UNITS // 2:
            self.old = dict(self)
            self.clear()
        got = self.old.get(unit)
        self[unit] = got = self.encode(unit) if got is None else got
        return got


def _load(name: str):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


def _names(tokenizer) -> list[bytes]:
    """Names of control tokens, at which the library cuts a text before anything else; a text that holds one goes to it as a whole."""
    return [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]


def _whole(tokenizer, text: bytes) -> np.ndarray:
    return np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")


def _merges(name: str):
    """A function from a word to its ids, if a file of ranks stands beside the vocabulary."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = (name if os.sep in name else public_tokenizers.path(name)).removesuffix(".json") + ".tiktoken"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _visible() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteLevel:
    """Ids of a byte-level BPE without a normalizer; it joins a space to the word after it."""

    def __init__(self, name: str):
        tokenizer = _load(name)
        merged = _merges(name) or (lambda unit: tokenizer.encode(unit.decode(), add_special_tokens=False).ids)

        def encode(unit: bytes) -> bytes:
            if _LETTERS(unit):  # one word to the cutter
                return array("I", merged(unit)).tobytes()
            if parts := _PARTS(unit):
                return b"".join([self.units[part] for part in parts.groups() if part])
            return array("I", tokenizer.encode(unit.decode(), add_special_tokens=False).ids).tobytes()

        self.units, self.names, self.tokenizer = Units(encode), _names(tokenizer), tokenizer

    def __call__(self, text: bytes) -> np.ndarray:
        if any(name in text for name in self.names):
            return _whole(self.tokenizer, text)
        odd = len(text.translate(None, _ODD_LEADS)) < len(text) and _ODD_SPACE(text)
        units = [text] if odd else _GAP_WORDS(text)
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), dtype="<u4")


@functools.cache
def byte_level(name: str) -> ByteLevel:
    """One for each worker process, with the units that its tasks have met."""
    return ByteLevel(name)


class WordLevel:
    """Ids of a BPE with word ends that lower-cases and drops white space."""

    def __init__(self, name: str):
        tokenizer = _load(name)
        seen = _visible()

        def encode(unit: bytes) -> bytes:
            if _LETTERS(unit):  # such a run is one word: it only needs lower-casing
                return array("I", [t.id for t in tokenizer.model.tokenize("".join(map(seen.__getitem__, unit.decode().lower().encode())))]).tobytes()
            return array("I", tokenizer.encode(unit.decode(), add_special_tokens=False).ids).tobytes()

        self.units, self.names, self.tokenizer = Units(encode), _names(tokenizer), tokenizer

    def __call__(self, text: bytes) -> np.ndarray:
        if any(name in text for name in self.names):
            return _whole(self.tokenizer, text)
        units = text.split() if _NOT_PLAIN(text) else _RUNS(text.lower())
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), dtype="<u4")


@functools.cache
def word_level(name: str) -> WordLevel:
    """One for each worker process, with the units that its tasks have met."""
    return WordLevel(name)
