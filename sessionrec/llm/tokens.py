"""Token ids by the ``tokenizers`` library, word by word, with a cache of words.

Both vocabularies split a text into words by a pattern before anything else, so a text's
ids are those of its words one after the other. A word is encoded by the library once and
kept in a bounded cache of two generations, so words in use outlive rare ones; ids stay
packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

CACHE_WORDS = 400_000  # of each generation; about 300,000 words are new in 16 MB of text

# The splitting patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"

# The same with listed characters, for the standard library's patterns, which are quicker.
BYTE_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"

# Texts of these characters are split by them.
_LATIN_END = 0x250
_LATIN = re.compile(f"[\\x00-{chr(_LATIN_END - 1)}]*")

# Characters whose normal form and lower case are the same in every library.
_PLAIN = regex.compile(r"[\x00-\u012F\u0132-\u017F]*")


class _Words(dict):
    """Word -> packed ids."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.pop(word, None)
        if packed is None:
            packed = pack_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


def latin_pattern(letters_numbers_spaces: str) -> re.Pattern:
    """A splitting pattern for Latin texts, its ``{L}``, ``{N}`` and ``{S}`` the characters of a class."""
    listed = {}
    for name, of_class in (("{L}", r"\p{L}"), ("{N}", r"\p{N}"), ("{S}", r"\s")):
        found = [chr(c) for c in range(_LATIN_END) if regex.match(of_class, chr(c))]
        listed[name] = "".join(map(re.escape, found))
    return re.compile(re.sub(r"\{[LNS]\}", lambda m: listed[m[0]], letters_numbers_spaces))


def pack_ids(ids) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Packed ids of whole texts; equal to encoding each text by the library.

    Texts that could hold a special token, or, where the vocabulary normalises its
    input, characters outside the Latin blocks, are encoded by the library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.normalised = self.tokenizer.normalizer is not None
        self.pattern = regex.compile(WORD_PATTERN if self.normalised else BYTE_PATTERN)
        self.latin = latin_pattern(WORD_LATIN if self.normalised else BYTE_LATIN)
        self.words = _Words(self.tokenizer)

    def packed(self, text: str) -> bytes:
        if SPECIAL in text:
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.normalised:
            if not _PLAIN.fullmatch(text):
                return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
            text = unicodedata.normalize("NFC", text).lower()
        pattern = self.latin if text.isascii() or _LATIN.fullmatch(text) else self.pattern
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and cache per task."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
