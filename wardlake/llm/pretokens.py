"""Texts cut into the pieces that byte-level tokenizers encode one by one.

A tokenizer first cuts a text into pre-tokens and then encodes each on its own, so a pre-token is encoded
once and looked up ever after.  Texts of characters below U+0180 are cut here by a regular
expression that gives what the library gives (the tests compare every character); other
texts, and those with special strings, are left to the library itself.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLAIN_BELOW = 0x180
# Pre-tokens a worker remembers; it forgets them all when there are more.
REMEMBERED = 400_000


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c)).startswith(kinds))


LETTERS, NUMBERS = _class("L"), _class("N")
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
OTHERS = f"[^{SPACES}{LETTERS}{NUMBERS}]+"
# The cuts of the two tokenizers.
BYTE_LEVEL = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?{OTHERS}|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|{OTHERS}")
SPECIAL = re.compile(r"<\|(?:startof|endof)text\|>")


def is_plain(text: str) -> bool:
    """True if all characters are below U+0180 and no special string is in the text."""
    if "<|" in text and SPECIAL.search(text):
        return False
    if text.isascii():
        return True
    # In UTF-8 the characters from U+0180 on begin with a byte of 0xC6 or more.
    return int(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).max()) < 0xC6


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(path: str):
    # One thread per task: Spark runs the tasks side by side, and every thread would keep memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces:
    """What a tokenizer's model makes of single pre-tokens."""

    def __init__(self, whole):
        self.model = whole.model
        self.symbols = byte_symbols()

    def __call__(self, word: str) -> list:
        if word.isascii():
            return self.model.tokenize(word.translate(self.symbols))
        return self.model.tokenize("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))


class WordCoder:
    """Ids of whole texts by the word-level tokenizer, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.whole = load(path)
        self.pieces = Pieces(self.whole)
        self.known: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.pieces(word)])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif is_plain(text):
                words = WORD_LEVEL.findall(text.lower())
                try:
                    out.append(b"".join([self.known[w] for w in words]))
                except KeyError:
                    if len(self.known) > REMEMBERED:
                        self.known.clear()
                    for w in set(words).difference(self.known):
                        self.known[w] = self._encode(w)
                    out.append(b"".join([self.known[w] for w in words]))
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
        return out


def byte_pretokens(whole, text: str | None) -> tuple[list[str], int]:
    """The byte-level pre-tokens of a text, and how many special strings stood between them."""
    if not text:
        return [], 0
    if is_plain(text):
        return BYTE_LEVEL.findall(text), 0
    words, parts = [], text.split("<|endoftext|>")
    for part in parts:
        if is_plain(part):
            words += BYTE_LEVEL.findall(part)
        else:
            words += [part[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(part)]
    return words, len(parts) - 1
