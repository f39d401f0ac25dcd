"""Byte-level BPE through a sentencepiece model written straight from a rank vocabulary.

The model file is the protocol buffer that sentencepiece reads: one piece for each token, its bytes
mapped one to one to printable characters, scored by its negative rank, model type BPE, identity
normalisation. sentencepiece then merges the neighbouring pair of the best score, which is the pair
of the lowest rank. Pre-tokens are encoded separately; a pre-token that is itself a token is its id.
Decoding maps each id to its piece and the piece's characters back to bytes.

Null and empty texts have no ids. Any text decodes to its own UTF-8 bytes. Each row depends on its text
alone, so repeated rows get equal results; other columns are not read, and empty tables give no rows.
The ids of one very long text are held by one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import _ODD, Memo, byte_characters


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from lines of base64 and rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[k] for k in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the unknown piece comes last."""
    chars = byte_characters()
    # Field numbers and enumerations of the sentencepiece model format.
    unknown_type, bpe_type = 2, 2
    piece, score, kind = 1, 2, 3
    model_pieces, trainer, normaliser = 1, 2, 3
    model_type, vocab_size = 3, 4
    name, dummy_prefix, trim_space, escape_space = 1, 3, 4, 5

    score_tag = _varint(score << 3 | 5)
    body = [
        _message(model_pieces, _message(piece, "".join(map(chars.__getitem__, token)).encode()) + score_tag + struct.pack("<f", -rank))
        for rank, token in enumerate(tokens)
    ]
    body.append(_message(model_pieces, _message(piece, b"<unk>") + score_tag + struct.pack("<f", 0) + _number(kind, unknown_type)))
    body.append(_message(trainer, _number(model_type, bpe_type) + _number(vocab_size, len(tokens) + 1)))
    body.append(_message(normaliser, _message(name, b"identity") + _number(dummy_prefix, 0) + _number(trim_space, 0) + _number(escape_space, 0)))
    return b"".join(body)


class PieceCodec:
    """``encode(text)``: ids as bytes of little-endian unsigned 32-bit integers; ``decode`` inverts it."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ranks = {t: k for k, t in enumerate(self.tokens)}
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.to_char = str.maketrans(dict(enumerate(byte_characters())))
        back = {c: b for b, c in enumerate(byte_characters())}
        self.to_bytes = [bytes(map(back.__getitem__, self.model.id_to_piece(k))) for k in range(len(self.tokens))]
        self.memo = Memo(self.by_pattern)

    def pre_token(self, data: bytes) -> list[int]:
        known = self.ranks.get(data)
        return [known] if known is not None else self.model.encode(data.decode("latin-1").translate(self.to_char))

    def by_pattern(self, text: str) -> bytes:
        ids = [i for x in self.pattern.findall(text) for i in self.pre_token(x.encode())]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or " ".join(text.split()) != text.replace("\n", " "):
            return self.by_pattern(text)
        # single blanks and line feeds between words: no pre-token spans these cuts
        chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.memo.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.to_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> PieceCodec:
    """One codec for each vocabulary in a Python worker."""
    return PieceCodec(path, pattern)


def encode_ids(text: Column, path: str, pattern: str) -> Column:
    """The ids of each whole text, binary (little-endian unsigned 32-bit); null texts count as empty."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        try:
            for texts in batches:
                yield texts.map(own.encode)
        finally:
            own.memo.forget()

    return encode(text.cast("string"))


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that each row of ids stands for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(codec(path, pattern).decode)

    return decode(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """A struct for each text: n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes.

    One pass in one worker: neither ids nor decoded bytes travel.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        names = list(map(str, range(len(own.tokens))))
        try:
            for texts in batches:
                rows = []
                for t in texts:
                    ids = own.encode(t)
                    decimal = ",".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    rows.append((len(ids) // 4, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.memo.forget()

    return digests(text.cast("string"))
