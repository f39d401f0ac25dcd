"""Main text of pages by site style trees.

The pages of a host are merged into one tree: an element is known by its path of tags and classes,
and the tree counts on how many pages it occurs, in which presentations (sequences of child tags)
and with which contents (text blocks). With p_i the share of the i-th variant among the m pages of
an element, its importance is the entropy -sum p_i log_m p_i for presentations, and one less the mean
entropy of its blocks for contents: what every page repeats says nothing about any of them. A branch
counts ``1 - mix`` of its parent's presentation and ``mix`` of its contents. Hosts with few pages are
smoothed by the tree of all hosts. Blocks of branches under ``limit`` are removed from each page.

Names are a prior, not a verdict. An element whose tag or class names a role (navigation, adverts,
forms, ...) marks what it holds as noise, ``article`` and ``main`` as main text; the innermost mark
counts. A mark is worth ``smoothing`` pages of importance 0 or 1, so it decides alone on branches of
a page or two; besides, what a noise branch lacks to importance 1 counts ``1 / noise_weight`` fold,
and the importance of an article branch ``1 / article_weight`` fold. At the given weights and on many
pages a noise branch stays from 0.82 on, an article branch goes below 0.24.

Null and empty html give an empty text. Pages are read whole; unclosed and stray tags are tolerated.
Of a block, character references are decoded, white space becomes one blank; a ``br`` is white space.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hostrank import host_of
from .shared import saved

# Fixed values of HTML: elements with raw content, without content, set within a line, and those
# that an opening tag of their own kind or of a block ends.
RAW = frozenset("script style textarea noscript template title svg iframe object select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

# Names of roles that are not main text.
NOISE_TAGS = frozenset("nav footer aside form header dialog menu figure figcaption".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer gdpr header menu modal nav navbar "
    "navigation newsletter notice overlay pagination popup promo promoted recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget".split()
)
MAIN_TAGS = frozenset(["article", "main"])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: str
    text: str
    noise: bool
    article: bool


def roles(tag: str, attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return sorted({w for m in _ROLE.findall(attributes) for w in _WORD.findall("".join(m).lower())})


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks in page order, and for each element path that holds blocks or elements its child tags."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, noise, article
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, noise, article = stack[-1]
                blocks.append(Block(path, text, noise, article))

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if found is None:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if found[1]:
            if any(tag == s[0] for s in stack[1:]):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        while len(stack) > 1 and (stack[-1][0] in CLOSED_BY_BLOCK or (tag == stack[-1][0] and tag in CLOSED_BY_SAME)):
            stack.pop()
        words = roles(tag, found[3])
        _, path, noise, article = stack[-1]
        children.setdefault(path, []).append(tag)
        if (tag in NOISE_TAGS and not (article and tag in ("header", "figure", "figcaption"))) or not NOISE_WORDS.isdisjoint(words):
            noise, article = True, False
        elif tag in MAIN_TAGS:
            noise, article = False, True
        stack.append((tag, f"{path}/{tag}" + ("." + ".".join(words) if words else ""), noise, article))
    flush()
    return blocks, children


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def parent(path: str) -> str:
    return path.rpartition("/")[0]


COUNTS = "host string, path long, of long, kind string, variant long, pages long, first long"


def page_counts(pages: DataFrame) -> DataFrame:
    """For each page and path the variants on it: blocks (kind c) and child sequences (kind s)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                blocks, children = parse(page)
                seen: set = set()
                variants = [(b.path, "c", b.text) for b in blocks]
                variants += [(p, "s", " ".join(children.get(p, ()))) for p in {parent(b.path) for b in blocks}]
                for path, kind, text in variants:
                    key = (host, _hash(path), _hash(parent(path)), kind, _hash(text))
                    if key in seen:
                        continue
                    first = (path, kind) not in seen
                    seen.update((key, (path, kind)))
                    row = rows.setdefault(key, [0, 0])
                    row[0] += 1
                    row[1] += first
            columns = list(zip(*(k + tuple(v) for k, v in rows.items()), strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return pages.select("host", "html").mapInArrow(count, COUNTS)


def importances(counts: DataFrame, by: list[str]) -> DataFrame:
    """For each path of the trees named by ``by``: m pages, content and presentation importance.

    Uses sums only, so hot hosts are added up before they are shuffled.
    """
    variants = counts.groupBy(*by, "path", "of", "kind", "variant").agg(F.sum("pages").alias("n"), F.sum("first").alias("first"))
    c = F.col("n").cast("double")
    paths = variants.groupBy(*by, "path", "of", "kind").agg(F.sum("first").alias("m"), F.sum(c).alias("total"), F.sum(c * F.log(c)).alias("logs"))
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    # content: a block on c of m pages has entropy log_m c; presentation: -sum p log_m p
    content = 1 - F.col("logs") / F.col("total") / base
    style = (F.log("total") - F.col("logs") / F.col("total")) / base
    return paths.withColumn("importance", F.when(F.col("m") <= 1, 1.0).when(F.col("kind") == "c", content).otherwise(F.least(F.lit(1.0), style)))


def branch_table(pages: DataFrame, mix: float = 0.7, smoothing: float = 20.0) -> DataFrame:
    """``host, path, importance, known`` of all branches that hold blocks.

    ``known`` is the weight of the importance against a mark by name: m / (m + smoothing) for a
    branch on m pages of all hosts.
    """
    counts = saved(importances_input(pages), "style-tree")
    own = importances(counts, ["host"])
    everywhere = importances(counts, []).select(F.col("path").alias("_p"), F.col("kind").alias("_k"), F.col("importance").alias("_all"), (F.col("m") / (F.col("m") + smoothing)).alias("known"))
    own = own.join(everywhere, (F.col("path") == F.col("_p")) & (F.col("kind") == F.col("_k")))
    own = own.withColumn("importance", (F.col("m") * F.col("importance") + smoothing * F.col("_all")) / (F.col("m") + smoothing))
    content = own.where(F.col("kind") == "c").select("host", "path", "of", "known", F.col("importance").alias("content"))
    style = own.where(F.col("kind") == "s").select(F.col("host").alias("_h"), F.col("path").alias("_s"), F.col("importance").alias("style"))
    both = content.join(style, (F.col("host") == F.col("_h")) & (F.col("of") == F.col("_s")), "left")
    return both.select("host", "path", (mix * F.col("content") + (1 - mix) * F.coalesce("style", F.lit(1.0))).alias("importance"), "known")


def importances_input(pages: DataFrame) -> DataFrame:
    """``page_counts`` added up over pages."""
    keys = ["host", "path", "of", "kind", "variant"]
    return page_counts(pages).groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum("first").alias("first"))


#: What a mark by name leaves to the tree: noise needs more importance, an article less.
NOISE_WEIGHT, ARTICLE_WEIGHT = 0.3, 0.6


def main_text(html: Column, branches: Column, limit: float = 0.4, noise_weight: float = NOISE_WEIGHT, article_weight: float = ARTICLE_WEIGHT) -> Column:
    """The text of each page: its blocks whose branch has at least ``limit``, joined by line feeds.

    ``branches`` maps paths to arrays of importance and ``known``.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for page, table in zip(pages, tables, strict=True):
            if not page:
                out.append("")
                continue
            known = dict(table) if table is not None else {}
            kept = []
            for b in parse(page)[0]:
                worth, weight = known.get(_hash(b.path), (1.0, 0.0))
                if b.noise:
                    worth = 1 - (1 - weight * worth) / noise_weight
                elif b.article:
                    worth = (weight * worth + 1 - weight) / article_weight
                if worth >= limit:
                    kept.append(b.text)
            out.append("\n".join(kept))
        return pd.Series(out, dtype=object)

    return extract(html, branches)


#: Hosts up to which the branch tables are sent to every task; larger ones meet their pages by a join.
BROADCAST_HOSTS = 20_000


def extract_main_text(pages: DataFrame, limit: float = 0.4) -> DataFrame:
    """``page_id, url, html`` to page_id, url and text."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    # only branches that some mark by name decides otherwise than for unknown branches; few repeat so often on a host
    worth, known = F.col("importance"), F.col("known")
    told = (worth < limit) | (1 - (1 - known * worth) / NOISE_WEIGHT >= limit) | ((known * worth + 1 - known) / ARTICLE_WEIGHT < limit)
    table = branch_table(pages).where(told)
    tables = table.groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("path", F.array("importance", "known")))).alias("_branches"))
    tables = saved(tables, "branches")
    size = tables.agg(F.count("*").alias("hosts"), F.sum(F.size("_branches")).alias("branches")).first()
    small = size["hosts"] <= BROADCAST_HOSTS and (size["branches"] or 0) <= 25 * BROADCAST_HOSTS
    joined = pages.join(F.broadcast(tables) if small else tables, F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "url", main_text(F.col("html"), F.col("_branches"), limit).alias("text"))
