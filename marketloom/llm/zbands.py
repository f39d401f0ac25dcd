"""Quality rules by compression bands.

zstandard ratios (bytes / compressed bytes) over the whole document and over fixed chunks; repeated
text compresses too well, noise not at all. How well ordinary prose compresses depends on its
length, so the limits are given for length bands.

Null and empty texts have no words and fail the base rules. Nothing is cut: every byte is in the
whole-document ratio and in one chunk. Each row is judged by its text alone, so repeated rows get equal
results; other columns, whatever their names, are not read. A very long text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, zstd_ratio double, bad_chunk_share double, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits in force from ``from_bytes`` on: (from_bytes, least ratio, largest ratio).

    ``chunk_limits`` hold for every chunk of ``chunk_bytes`` (a last part under half a chunk is
    joined to the one before). A document fails if its own ratio is outside its band, or over
    ``bad_chunks`` of its chunks are outside theirs.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.2),
        (128, 0.0, 2.4),
        (256, 1.05, 2.4),
        (512, 1.1, 2.5),
        (1024, 1.15, 2.7),
        (4096, 1.2, 3.0),
        (16384, 1.2, 3.5),
        (65536, 1.2, 4.2),
    )
    chunk_bytes: int = 2048
    chunk_limits: tuple[float, float] = (1.15, 2.9)
    bad_chunks: float = 0.25
    least_words: int = 20
    most_repeat_percent: int = 30
    level: int = 3


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words found twice or more; no hashing is involved."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    width, kinds = 1, len(ids)
    if kinds == n:
        return 0
    while width < window:  # codes of twice the width, made dense again before a product could overflow
        if width > 1 and kinds >= 1 << 31:
            code = np.unique(code, return_inverse=True)[1]
            kinds = n
        code, kinds, width = code[:-width] * kinds + code[width:], kinds * kinds, 2 * width
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    return int((np.cumsum(steps) > 0).sum())


def chunk_edges(n: int, size: int) -> list[tuple[int, int]]:
    edges = [(i, min(n, i + size)) for i in range(0, n, size)]
    if len(edges) > 1 and edges[-1][1] - edges[-1][0] < size // 2:
        edges[-2:] = [(edges[-2][0], n)]
    return edges


def measure(text: str | None, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = repeat_words(words)
    failed = n_words < bands.least_words or 100 * repeats > bands.most_repeat_percent * n_words
    ratio = len(raw) / len(zip_.compress(raw)) if raw else 0.0
    _, low, high = [b for b in bands.whole if len(raw) >= b[0]][-1]
    edges = chunk_edges(len(raw), bands.chunk_bytes) if len(raw) >= bands.chunk_bytes // 2 else []
    least, most = bands.chunk_limits
    bad = sum(not least <= (e - s) / len(zip_.compress(raw[s:e])) <= most for s, e in edges)
    share = bad / len(edges) if edges else 0.0
    kept = not failed and low <= ratio <= high and share <= bands.bad_chunks
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed, ratio, share, kept


def compression_bands(text: Column, bands: Bands = Bands()) -> Column:
    """A struct (``SCHEMA``) with base counts, ratios and the verdict ``kept`` for each whole text."""

    @F.pandas_udf(SCHEMA)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t, bands, zip_) for t in texts], columns=names)

    return rules(text.cast("string"))
