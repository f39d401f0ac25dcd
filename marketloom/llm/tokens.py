"""Ids of whole texts by a public ``tokenizers`` file, with a bounded memo of pre-tokens.

A text of Latin letters is split as the file's own pre-tokenizer splits it, and each distinct
pre-token goes to the library's model once for a task. Any other text is cut at white space that no
pre-token spans; its chunks of other letters go through the whole library. A text for which that cut
is not proven safe, or that holds the string of an added token, goes to the library whole, so the
ids always equal ``Tokenizer.encode``'s.

Memory is bounded: two generations of ``MEMO`` pre-tokens of at most ``LONGEST`` characters, freed
when the task ends.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from tokenizers import Tokenizer

MEMO, LONGEST = 200_000, 48
_ODD = re.compile(r"[\x00\x1c-\x1f᠎​]")


class Memo(dict):
    """key -> bytes of its ids, little-endian unsigned 32-bit; old keys fall out a generation later."""

    def __init__(self, encode, size: int = MEMO):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.encode(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = {}
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.old = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: Fixed value: how byte-level tokenizers with ``use_regex`` split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")


def latin_pattern(pattern: str) -> re.Pattern[str]:
    r"""``pattern`` for texts of ``_LATIN`` and their lower case: \p{L} and \p{N} become plain characters."""
    characters = sorted({x for c in map(chr, range(0x250)) for x in c + c.lower()})
    for kind in "LN":
        own, name = "".join(c for c in characters if unicodedata.category(c)[0] == kind), rf"\p{{{kind}}}"
        pattern = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(name, own), pattern.replace(f"[{name}]", name))  # noqa: B023
        pattern = pattern.replace(name, f"[{own}]")
    return re.compile(pattern)


class TextEncoder:
    """``encode(text)``: the ids of a text as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.to_char = self.tokenizer.model, str.maketrans(dict(enumerate(byte_characters())))
        self.blank = byte_characters()[32]
        config = json.loads(self.tokenizer.to_str())
        steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [config["pre_tokenizer"] or {"type": ""}])
        norms = [k["type"] for k in (config["normalizer"] or {}).get("normalizers", [])]
        kinds, first = [k["type"] for k in steps], steps[0]
        # the library finds these in a text before anything else; a file where it looks in normalised text is left to it
        self.added = ["" if t["normalized"] else t["content"] for t in config["added_tokens"]]
        self.drops_space = kinds == ["Split", "ByteLevel"] and first["behavior"] == "Removed"  # white space yields no ids
        self.pattern = None
        if kinds == ["ByteLevel"] and first["use_regex"] and not first["add_prefix_space"] and not config["normalizer"]:
            self.pattern = latin_pattern(BYTE_LEVEL)
        elif self.drops_space and first["invert"] and norms == ["NFC", "Replace", "Lowercase"]:
            self.pattern = latin_pattern(first["pattern"]["Regex"])
        self.pre_tokens, self.chunks = Memo(self.by_model), Memo(self.by_library, MEMO // 4)

    def by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def mapped(self, pre_token: str) -> str:
        """A character for each byte, as the model reads a pre-token."""
        if pre_token.isascii() and pre_token.isprintable():
            return pre_token.replace(" ", self.blank)
        return pre_token.encode().decode("latin-1").translate(self.to_char)

    def by_model(self, pre_token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(self.mapped(pre_token))]).tobytes()

    def by_pattern(self, text: str) -> bytes:
        """The ids of a text of Latin letters. Their composed forms are normal, so lower case is all that a normaliser changes."""
        return b"".join(map(self.pre_tokens.__getitem__, self.pattern.findall(text.lower() if self.drops_space else text)))

    def by_chunk(self, chunk: str) -> bytes:
        return self.by_pattern(chunk) if self.pattern and _LATIN.fullmatch(chunk) else self.chunks[chunk]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self.by_library(text)
        if self.pattern and _LATIN.fullmatch(text):
            return self.by_pattern(text)
        if _ODD.search(text):
            return self.by_library(text)
        words = text.split()
        if self.drops_space:
            return b"".join(map(self.by_chunk, words))
        # single blanks and line feeds between words: a blank belongs to the next word, a line feed stands alone
        if " ".join(words) != text.replace("\n", " "):
            return self.by_library(text)
        return b"".join(map(self.by_chunk, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


@cache
def _loaded(path: str) -> TextEncoder:
    """One encoder for each file in a Python worker: the vocabulary, without the memo."""
    return TextEncoder(path)


@contextmanager
def encoder(path: str) -> Iterator[TextEncoder]:
    """The encoder of a file for one task; its memo is freed at the end."""
    own = _loaded(path)
    try:
        yield own
    finally:
        own.pre_tokens.forget()
        own.chunks.forget()
        pa.default_memory_pool().release_unused()
