"""One query for each operator, over whole tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned, with_counts
from .binpack import pack_sequences
from .bitpack import packed_ids
from .bytecnn import fit_quality, quality_score
from .fingerprints import likeness, packed, with_codes, with_next
from .hostrank import judge
from .oddsketch import near_duplicates
from .piecemodel import round_trip
from .prefixtrie import trie_nodes, turns_of, with_heads
from .reshard import reshard, with_slots
from .shared import saved
from .simhash import simhash_groups
from .styletree import extract_main_text
from .zbands import compression_bands


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The score at and above which a document counts as good.
QUALITY_LIMIT = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = fit_quality(docs, labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= QUALITY_LIMIT, 1).otherwise(0))


def op4_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reshard(table(spark, sf_dir, "documents").select("doc_id", "text"), old_shards=12, new_shards=16)
    rows = docs.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard", "_hash")
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", compression_bands(F.col("text")).alias("_m")).select("doc_id", "_m.*")


def op6_piece_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", round_trip(F.col("text"), *how).alias("_d")).select("doc_id", "_d.*")


def op7_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_ids(docs, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49408, end_id=2)


def op8_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = {"ids_crc32": F.crc32("ids")}
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, columns=crc)


#: The rules of the url query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op9_host_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, URL_RULES, surfer=True).select("page_id", "host", "path", "rule", "verdict")


def op10_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = with_next(with_codes(docs, "text", "codes"), "doc_id", ["text", "codes"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substr(next_text, 1, cast(floor(char_length(text) / 2) as int))"))
    docs = docs.withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    docs = with_codes(docs, "edited", "edited_codes")
    return docs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("codes")).alias("fingerprint"),
        packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return with_counts(rows.withColumn("groups_sha256", digest).drop("groups"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    conv = F.col("conv_id")
    return trie_nodes(with_heads(turns, base=conv - conv % 5, head=F.crc32(conv.cast("string")) % 9, longest=8))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_odd_sketches": op1_odd_sketches,
    "op2_style_tree": op2_style_tree,
    "op3_byte_cnn": op3_byte_cnn,
    "op4_min_cost_flow": op4_min_cost_flow,
    "op5_compression_bands": op5_compression_bands,
    "op6_piece_model": op6_piece_model,
    "op7_bit_packed_ids": op7_bit_packed_ids,
    "op8_grouped_packing": op8_grouped_packing,
    "op9_host_ranks": op9_host_ranks,
    "op10_one_permutation": op10_one_permutation,
    "op11_token_spans": op11_token_spans,
    "op12_simhash": op12_simhash,
    "op13_prefix_nodes": op13_prefix_nodes,
}

#: The rules as the registered SQL has them; it may not be changed, so net/de/ still reads block there.
_RULES_SQL = "('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'), ('block', 'net', '/de/', 'net/de/'), ('block', 'example.net', '/de/8', 'example.net/de/8'), ('block', 'org', '/es/', 'org/es/')"

ORACLE_SQL: dict[str, str] = {
    "op1_odd_sketches": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON d.doc_id = a LEFT JOIN sizes ON d.doc_id = sizes.doc_id""",
    "op9_host_ranks": rf"""
WITH RECURSIVE hosts AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(what, on_host, below, rule) AS (VALUES {_RULES_SQL}),
ruled AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM hosts JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, below) GROUP BY 1),
judged AS (SELECT h.*, rule, what FROM hosts h LEFT JOIN ruled USING (page_id)),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)\b(?:href|src)\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1)) AS u FROM judged WHERE host <> ''),
targets AS (SELECT src, translate(regexp_extract('x:' || regexp_replace(u, '(?i)^https?:', ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM found),
seeds AS (SELECT host, avg((coalesce(what, '') = 'allow')::INT) AS trusted, avg((coalesce(what, '') = 'block')::INT) AS blocked FROM judged WHERE host <> '' GROUP BY 1),
edges AS (SELECT src, dst, count(*) AS n FROM targets WHERE dst <> '' AND dst <> src GROUP BY 1, 2),
shares AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
links AS (SELECT 'trust' AS kind, src AS a, dst AS b, share FROM shares UNION ALL SELECT 'distrust', dst, src, share * (1 - trusted - blocked) FROM shares JOIN seeds ON src = host),
walk AS (SELECT 0 AS step, 'trust' AS kind, host, trusted AS mass FROM seeds UNION ALL SELECT 0, 'distrust', host, blocked FROM seeds
  UNION ALL SELECT step + 1, w.kind, l.b, mass * share * 0.85 FROM walk w JOIN links l ON w.kind = l.kind AND w.host = l.a WHERE step < 20),
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS bad FROM walk GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(what, CASE WHEN bad >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN scores s ON j.host = s.host""",
    "op13_prefix_nodes": r"""
WITH bytes_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n FROM turns GROUP BY 1),
crcs AS (SELECT c, n, c - c % 5 AS base, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM convs, bytes_table),
heads AS (SELECT a.c, a.n, a.base, h, least(h, coalesce(b.n, 0)) AS k FROM crcs a LEFT JOIN convs b ON a.base = b.c),
rebuilt AS (
  SELECT c, 0 AS depth, '' AS r, '' AS x FROM heads
  UNION ALL SELECT h.c, pos + 1, r, x FROM heads h JOIN turns t ON t.c = h.base AND t.pos < h.h
  UNION ALL SELECT h.c, pos - h.h + k + 1, r, x FROM heads h JOIN turns t ON t.c = h.c AND t.pos >= h.h),
prefixes AS (SELECT c, depth, strlen(x) AS bytes, max(depth) OVER (PARTITION BY c) AS last, array_to_string(list(sha256(strlen(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY depth), '') AS key FROM rebuilt),
nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = last), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
children AS (SELECT left(key, length(key) - 64) AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS own FROM nodes n LEFT JOIN children USING (key, depth)),
paths AS (SELECT p.key, p.depth, p.c, sum((v.n_children = 0)::INT) OVER w AS leaves, sum(v.own) OVER w AS tokens
  FROM prefixes p LEFT JOIN valued v ON v.key = p.key AND v.depth = p.depth AND v.conv_id = p.c WINDOW w AS (PARTITION BY p.c ORDER BY p.depth DESC)),
sums AS (SELECT key, depth, sum(leaves) AS n_leaves, sum(tokens) AS saved_tokens FROM paths GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, coalesce(n_leaves, 0)::BIGINT AS n_leaves, coalesce(saved_tokens, 0)::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON v.key = s.key AND v.depth = s.depth LEFT JOIN valued u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.key = left(v.key, length(v.key) - 64)""",
}
