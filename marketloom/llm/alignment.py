"""Alignment of two tokenizers over the same text, by token spans.

The two libraries give spans: ``tokenizers`` the character offsets of each token, sentencepiece the
begin and end of each piece in its result message. A span that ends before the next one begins is a
coarse cut, and its place in the text is a byte offset. Between coarse cuts lie tokens that share a
character (parts of one multi-byte character have the span of all of it; byte-fallback pieces but the
last have none): their ends are refined by the lengths of their decoded bytes. Where tokens of both
end at the same byte, the text is cut into groups.

Texts are read as a space and the text, as sentencepiece puts one before each text. A text is also cut
at single blanks and line feeds between other characters, over which neither tokenizer has a token;
what lies between is aligned once for a task (two generations of ``tokens.MEMO`` parts are kept), marks at its end apart. A text with odd white space, or a file
for which that is not proven, is aligned whole.

Null and empty texts, and texts that either tokenizer does not give back byte for byte (U+2581 becomes
a space in pieces), have no tokens: zeros and ''. Strings of special tokens are plain text. Repeated
rows, also of one doc_id, are separate documents and all count; null doc_ids too. Ties: every link whose count
equals the highest of its B id is a best one. The ids of one very long text are held by one task. Only
doc_id and text are read; other columns, whatever their names, are not. Empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Scratch
from .tokens import _ODD, LONGEST, MEMO, TextEncoder, byte_characters

SPACE, BLANK = "▁", " "
#: A pair of ids in one number.
SHIFT = 32
#: A cut of a text whose white space is not single: before a single blank or line feed between other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Aligned(NamedTuple):
    """Tokens of a text and of its groups: ``a1,a2|b1;a3|b2`` and an (A id, B id) number for each link."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


NOTHING = Aligned(0, 0, 0, "", b"")
#: The same as a plain tuple, of which a memo can hold many without Python's collector walking through them.
Part = tuple[int, int, int, str, bytes]
#: Marks that may end a unit after a letter or digit; A begins a token there.
MARKS = ".,;:!?"


def joined(parts: Iterable[Part]) -> Part:
    n_a, n_b, n, groups, links = zip(*parts, strict=True)
    return sum(n_a), sum(n_b), sum(n), ";".join(groups), b"".join(links)


def flat_starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def refined(span_ends: np.ndarray, clean: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens of several texts, counted from each text's begin: coarse cuts where ``clean``, decoded ``sizes`` between them.

    The ends of a text are -1 if a coarse cut of it is not where the sizes lead.
    """
    starts = flat_starts(counts)
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = total[1:] - np.repeat(total[starts], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    wrong = np.bincount(text[clean & (ends != span_ends)], minlength=len(counts)) > 0
    return np.where(wrong[text], -1, ends)


class Aligner:
    """``align(text)`` by an A file of ``tokenizers`` and a B file of sentencepiece."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        own = {c: k for k, c in enumerate(byte_characters())}
        whole = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = whole | {i: bytes(map(own.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if byte else p.replace(SPACE, BLANK).encode() for p, byte in zip(pieces, self.b_byte, strict=True)]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int64), np.array(list(map(len, self.b_bytes)))
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.names = list(map(str, range(max(len(self.a_sizes), len(self.b_sizes)))))
        self.prefix, self.feed = self.b.piece_to_id(SPACE), self.b.piece_to_id("<0x0A>")
        # no piece goes on over a blank or a line feed, and the A file splits there
        apart = all("\n" not in p and SPACE not in p.lstrip(SPACE) for p in pieces) and not any(self.b.is_unused(i) for i in range(len(pieces)))
        self.reader = TextEncoder(a_path)
        self.cuts = apart and self.reader.pattern is not None and not self.reader.drops_space
        self.added = [t.content for t in self.a.get_added_tokens_decoder().values() if not t.special]
        # neighbours within pieces: over no other two characters does a piece go
        self.joined = {x for p in pieces for x in map("".join, zip(p, p[1:], strict=False))}
        # units of the newest two generations
        self.now: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}

    def a_tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of all texts by A, one after another, and the number of each text's tokens.

        The library's offsets are of characters; those of all texts become places in their bytes at once.
        """
        found = self.a.encode_batch(texts, add_special_tokens=False)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(f.ids for f in found), np.int64)
        begins, ends = np.fromiter(chain.from_iterable(chain.from_iterable(f.offsets for f in found)), np.int64).reshape(-1, 2).T
        clean = np.ones(len(ids), bool)
        clean[:-1] = begins[1:] >= ends[:-1]
        clean[(np.cumsum(counts) - 1)[counts > 0]] = True
        data = "".join(texts)
        if not data.isascii():
            points = np.frombuffer(data.encode("utf-32-le"), "<u4")
            at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
            first = np.repeat(flat_starts(np.fromiter(map(len, texts), np.int64, len(texts))), counts)
            ends = at[first + ends] - at[first]
        return ids, refined(ends, clean, self.a_sizes[ids], counts), counts

    def b_text(self, text: str) -> str:
        """What B gets for ``text``: B puts a space before it, which is the text's own first one, or else stays apart from it by a line feed."""
        return text[1:] if text[0] == BLANK else text if text[0] == "\n" else "\n" + text

    def b_pieces(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of B's pieces, whether an end is a coarse cut, and the number of each line's pieces."""
        ids: list[int] = []
        ends: list[int] = []
        counts = np.zeros(len(lines), np.int64)
        for k, x in enumerate(self.b.encode(lines, return_type="proto", num_threads=1)):
            pieces = x.pieces
            counts[k] = len(pieces)
            ids += [p.id for p in pieces]
            ends += [p.end for p in pieces]
        flat, at = np.array(ids, np.int64), np.array(ends, np.int64)
        # a piece begins where the one before it ends; byte-fallback pieces but the last have no span
        begins = np.concatenate([[0], at[:-1]])[: len(at)]
        begins[flat_starts(counts)[counts > 0]] = 0
        return flat, at, (at > begins) | ~self.b_byte[flat], counts

    def b_lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The same as ``b_tokens`` by one text with a line feed before each of ``texts``, over which no piece goes; None if the feeds are not found."""
        ids, ends, clean, _ = self.b_pieces(["\n" + "\n".join(texts)])
        sizes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        feed = (ids == self.feed) & np.isin(ends, begins)
        if ids[0] != self.prefix or not feed[1:2].all() or feed.sum() != len(texts):
            return None
        text = np.cumsum(feed) - 1
        keep = ~feed & (text >= 0)
        ids, text = ids[keep], text[keep]
        counts = np.bincount(text, minlength=len(texts))
        return ids, refined(ends[keep] - begins[text], clean[keep], self.b_sizes[ids], counts), counts

    def b_tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of all texts by B, one after another, and the number of each text's tokens."""
        if self.cuts and len(texts) > 1 and (found := self.b_lines(texts)):
            return found
        ids, ends, clean, counts = self.b_pieces(list(map(self.b_text, texts)))
        starts = flat_starts(counts)
        # pieces of what b_text puts before a text are left out
        skip = np.fromiter((0 if x[0] == BLANK else 1 if x[0] == "\n" else 2 for x in texts), np.int64, len(texts))
        padded = np.concatenate([ids, [-1, -1]])
        apart = (counts >= skip) & ((skip < 1) | (padded[starts] == self.prefix)) & ((skip < 2) | (padded[starts + 1] == self.feed))
        text = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(ids)) - starts[text]
        # a prefix that is not apart leaves a piece that no text gives back
        keep = np.where(apart[text], place >= skip[text], place == 0)
        ids, ends = np.where(apart[text], ids, self.prefix)[keep], np.where(apart[text], ends + 1 - skip[text], 0)[keep]
        counts = np.bincount(text[keep], minlength=len(texts))
        return ids, refined(ends, clean[keep], self.b_sizes[ids], counts), counts

    def whole(self, texts: list[str]) -> list[Part | None]:
        """Texts, or parts between cuts, by one call of each library; None for what a tokenizer does not give back."""
        if not texts:
            return []
        data = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        (a_ids, a_ends, a_counts), (b_ids, b_ends, b_counts) = self.a_tokens(texts), self.b_tokens(texts)
        back = np.ones(len(texts), bool)
        for ids, ends, counts, parts in ((a_ids, a_ends, a_counts, self.a_bytes), (b_ids, b_ends, b_counts, self.b_bytes)):
            last = np.cumsum(counts)
            own = (counts > 0) & (ends[np.maximum(last, 1) - 1] == sizes)
            back &= own
            given = list(map(parts.__getitem__, ids.tolist()))
            if not own.all() or b"".join(given) != b"".join(data):
                for k, (begin, end) in enumerate(zip((last - counts).tolist(), last.tolist(), strict=True)):
                    back[k] &= b"".join(given[begin:end]) == data[k]
        # places in all texts, each a byte further apart than it is long; common ones are links
        shift = np.cumsum(sizes + 1) - sizes
        a_at, b_at = a_ends + np.repeat(shift, a_counts), b_ends + np.repeat(shift, b_counts)
        a_text, b_text = np.repeat(np.arange(len(texts)), a_counts), np.repeat(np.arange(len(texts)), b_counts)
        a_use, b_use = np.flatnonzero(back[a_text]), np.flatnonzero(back[b_text])
        _, i, j = np.intersect1d(a_at[a_use], b_at[b_use], assume_unique=True, return_indices=True)
        i, j = a_use[i], b_use[j]
        links = a_ids[i] << SHIFT | b_ids[j]
        of = a_text[i]
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        previous = lambda x, begins: np.where(first, begins[of], np.concatenate([[0], x[:-1] + 1])) if len(x) else x
        x, y = previous(i, flat_starts(a_counts)), previous(j, flat_starts(b_counts))
        a_name, b_name = list(map(self.names.__getitem__, a_ids.tolist())), list(map(self.names.__getitem__, b_ids.tolist()))
        groups = [
            f"{a_name[p] if p == q else ','.join(a_name[p : q + 1])}|{b_name[r] if r == s else ','.join(b_name[r : s + 1])}"
            for p, q, r, s in zip(x.tolist(), i.tolist(), y.tolist(), j.tolist(), strict=True)
        ]
        n = np.bincount(of, minlength=len(texts))
        begins, raw = flat_starts(n).tolist(), links.tobytes()
        return [
            (na, nb, c, ";".join(groups[g : g + c]), raw[8 * g : 8 * (g + c)]) if ok else None
            for ok, na, nb, c, g in zip(back.tolist(), a_counts.tolist(), b_counts.tolist(), n.tolist(), begins, strict=True)
        ]

    def stem(self, text: str) -> int:
        """Where the marks at a unit's end begin, if no piece of B goes over from what is before them; else 0."""
        if text[-1] not in MARKS:
            return 0
        k = len(text.rstrip(MARKS))
        return k if k and text[k - 1].isalnum() and text[k - 1 : k + 1] not in self.joined else 0

    def look_up(self, units: Iterable[str], stems: bool = True) -> dict[str, Part | None]:
        """Alignments of distinct units; new ones are aligned in one go, their stems and the marks at their ends apart."""
        now, old = self.now, self.old
        out: dict[str, Part | None] = {}
        new = []
        for u in units:
            found = now.get(u, NOTHING)
            if found is NOTHING:
                found = old.get(u, NOTHING)
                if found is NOTHING:
                    new.append(u)
                    continue
                now[u] = found
            out[u] = found
        if not new:
            return out
        if stems:
            cuts = {u: k for u in new if (k := self.stem(u))}
            parts = self.look_up(dict.fromkeys([u for u in new if u not in cuts] + [x for u, k in cuts.items() for x in (u[:k], u[k:])]), False)
            for u in new:
                if (k := cuts.get(u)) is None:
                    out[u] = parts[u]
                    continue
                a, b = parts[u[:k]], parts[u[k:]]
                out[u] = None if a is None or b is None else (a[0] + b[0], a[1] + b[1], a[2] + b[2], f"{a[3]};{b[3]}", a[4] + b[4])
            new = list(cuts)
        else:
            out |= zip(new, self.whole(new), strict=True)
        if len(now) >= MEMO:
            self.old, self.now = now, {}
        self.now |= {u: out[u] for u in new if len(u) <= LONGEST}
        return out

    def forget(self) -> None:
        self.now, self.old = {}, {}

    def units_of(self, text: str) -> list[str]:
        """The parts of a space and ``text`` between cuts; none where cuts are not proven."""
        if not self.cuts or _ODD.search(text) or any(x in text for x in self.added):
            return []
        line = BLANK + text
        if " ".join(text.split()) == text.replace("\n", " "):
            return line.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:]
        return _CUT.split(line)

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """All texts; what they have in common is aligned once."""
        units = [self.units_of(t) if t else [] for t in texts]
        parts = self.look_up(dict.fromkeys(chain.from_iterable(units)))
        out = []
        for text, own in zip(texts, units, strict=True):
            found = list(map(parts.__getitem__, own))
            if found and None not in found:
                out.append(Aligned(*joined(found)))
            else:
                out.append(Aligned(*(self.whole([BLANK + text])[0] or NOTHING)) if text else NOTHING)
        return out


@cache
def _loaded(a_path: str, b_path: str) -> Aligner:
    """One aligner for each pair of files in a Python worker: the vocabularies; the parts it keeps are freed with each task."""
    return Aligner(a_path, b_path)


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
#: Bytes of texts aligned together, and bytes of results in one batch.
TOGETHER, FLUSH = 1 << 18, 1 << 22


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, text`` to ``COLUMNS``: groups in full, each distinct pair of linked ids (A << 32 | B) and how often it is linked."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, size = _loaded(a_path, b_path), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            columns, rows, size = list(zip(*rows, strict=True)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        try:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                # documents of about so many bytes together
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist(), batch.num_rows]
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    some = batch.slice(begin, end - begin)
                    for doc_id, found in zip(some.column(0).to_pylist(), own.align(some.column(1).to_pylist()), strict=True):
                        pairs, times = np.unique(np.frombuffer(found.links, "<i8"), return_counts=True)
                        rows.append((doc_id, found.n_a, found.n_b, found.n_groups, len(found.links) // 8, found.groups, pairs, times))
                        size += len(found.groups) + 16 * len(pairs)
                        if size >= FLUSH:
                            yield flush()
            if rows:
                yield flush()
        finally:
            own.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


#: Pairs up to which the table of counts is sent to the tasks (some 40 bytes each); a longer one meets the links in a shuffle.
BROADCAST_PAIRS = 1_000_000


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best`` over all links: best where the count is the highest of the pair's B id."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_p.*")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    counts = counts.withColumn("_b", b_id)
    most = counts.groupBy(F.col("_b").alias("_id")).agg(F.max("count").alias("_most"))
    return counts.join(most, F.col("_b") == F.col("_id")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def with_counts(rows: DataFrame, label: str = "alignment") -> DataFrame:
    """Alignment rows with n_best and count_sum instead of pairs and times; other columns stay, as stored once."""
    run = Scratch(rows.sparkSession, label)
    rows = run.saved(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    counts = run.saved(pair_counts(rows), "pairs")
    few = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_row", "_p.*")
    each = each.join(few, F.col("pairs") == F.col("pair"))
    sums = each.groupBy(F.col("_row").alias("_r")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    out = rows.drop("pairs", "times").join(sums, F.col("_row") == F.col("_r"), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_best", "count_sum")}).drop("_row", "_r")
