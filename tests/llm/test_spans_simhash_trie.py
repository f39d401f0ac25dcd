"""Alignment, SimHash and prefix trie against brute force, with nulls, empties, copies and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import alignment, prefixtrie, queries, simhash
from marketloom.llm.tokens import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    words = ["the", "the,", "12.", "x_.", "é!", "end...", "straße", "naïve", "日本語", "𐍈x", "don't", "12.5", "<|endoftext|>", "<s>", "<0x41>", "ABC", "x" * 60, "é", "ﬁ"]
    found = [None, "", " ", "\n", "  lead", "trail \n", "a▁b", "one\ttab", "two  blanks", "a b", "a​b", "\x00z", "᠎", "same text here", "same text here", "Same Text Here"]
    found += [rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    found += [" ".join(rng.choice(words) for _ in range(20)) + rng.choice(["", "\n\n", " ▁"]) for _ in range(20)]
    return [*found, "long words " * 4000 + "𐍈"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(7 * k + 1, t, "en", 1, "x") for k, t in enumerate(texts())]
    rows += [(None, "same text here", "en", 1, "x"), (8, "repeated id", "en", 2, "y"), rows[20], rows[20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, pair int, rep string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    return path


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def brute_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = {c: k for k, c in enumerate(byte_characters())}
    vocabulary = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    a_bytes = lambda i: bytes(own[c] for c in vocabulary[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def one(text):
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [list(map(f, x)) for f, x in zip((a_bytes, b_bytes), ids, strict=True)]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return [], [], [], []
        ends = [{sum(map(len, p[: k + 1])): k for k in range(len(p))} if len(p) < 3000 else dict(zip(np.cumsum(list(map(len, p))).tolist(), range(len(p)), strict=True)) for p in parts]
        groups, links, x, y = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][end], ends[1][end]
            groups.append(f"{','.join(map(str, ids[0][x : i + 1]))}|{','.join(map(str, ids[1][y : j + 1]))}")
            links.append((ids[0][i], ids[1][j]))
            x, y = i + 1, j + 1
        return *ids, groups, links

    found = [(doc_id, *one(text)) for doc_id, text in rows]
    count = collections.Counter(x for r in found for x in r[4])
    most = collections.defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(x), len(y), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), digest(g)) for i, x, y, g, k in found]


def test_op11_against_brute_force(spark, folder, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = ordered(brute_alignment(rows))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(tuple(r[c] for c in columns) for r in queries.QUERIES["op11_token_spans"](spark, folder).collect()) == want
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[1] > 0 for r in want) > 80
    # pair counts that are too many to send to the tasks
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert ordered(tuple(r[c] for c in columns) for r in queries.QUERIES["op11_token_spans"](spark, folder).collect()) == want


def test_op11_cut_texts_as_whole_ones():
    own = alignment.Aligner(A, B)
    assert own.cuts
    whole = [tuple(own.whole([" " + t])[0] or alignment.NOTHING) if t else tuple(alignment.NOTHING) for t in texts()]
    assert list(map(tuple, own.align(texts()))) == whole
    assert [tuple(own.align([t])[0]) for t in texts()] == whole
    # a mark after a letter is a part of its own, as no piece goes over; none is after a blank
    assert own.stem(" the,") == 4 and own.stem(" ,") == 0 and own.stem(" the") == 0


def test_op11_spans_are_refined_by_decoded_bytes():
    own = alignment.Aligner(A, B)
    # one character of four byte pieces and of several byte-level tokens; texts with and without a blank of their own
    parts = [" 𐍈", " 日é", "𐍈", "\nx", " plain"]
    for find, sizes in ((own.a_tokens, own.a_sizes), (own.b_tokens, own.b_sizes)):
        ids, ends, counts = find(parts)
        at = 0
        for text, n in zip(parts, counts.tolist(), strict=True):
            assert ends[at : at + n].tolist() == np.cumsum(sizes[ids[at : at + n]]).tolist() and ends[at + n - 1] == len(text.encode())
            at += n
    assert own.b_tokens([" 𐍈"])[1].tolist() == [1, 2, 3, 4, 5]
    yes = np.array([True, True])
    assert alignment.refined(np.array([2, 5]), yes, np.array([2, 2]), np.array([2])).tolist() == [-1, -1]
    assert alignment.refined(np.array([3, 3, 4, 9]), np.array([False, True, True, True]), np.array([2, 1, 1, 9]), np.array([3, 1])).tolist() == [2, 3, 4, 9]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """Components over (doc_id, fingerprint) rows; a doc_id joins its rows."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [(i, f) for i, f in rows if i is not None]
    for k, (i, f) in enumerate(some):
        for j, g in some[k + 1 :]:
            if (f ^ g).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op12_against_brute_force(spark, folder):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    owner = brute_groups(rows)
    got = queries.QUERIES["op12_simhash"](spark, folder).collect()
    assert ordered((r.doc_id, r.fingerprint, r.component_id) for r in got) == ordered((i, f"{f:016x}", owner.get(i)) for i, f in rows)


def test_op12_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(6):
        own = [rng.choice(words) for _ in range(300)]
        for k in range(30):
            edited = list(own)
            for _ in range(k // 6):
                edited[rng.randrange(300)] = rng.choice(words)
            rows.append((100 * base + k, " ".join(edited)))
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups([(i, brute_fingerprint(t)) for i, t in rows])
    assert got == want and 6 <= len(set(want.values())) < len(rows) - 30


@pytest.mark.parametrize("block", [4096, 16])
def test_op12_links_of_clustered_fingerprints(spark, monkeypatch, block):
    # many fingerprints of few bits' difference round few centres, so that keys are shared by many
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(3)]
    found = set()
    for _ in range(250):
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64)
        found.add(f)
    rows = list(enumerate(found))
    classes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "rep long, fingerprint long")
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links_of(simhash.key_members(classes)).collect():
        assert (rows[r.a][1] ^ rows[r.b][1]).bit_count() <= 3
        x, y = find(r.a), find(r.b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i, _ in rows} == brute_groups(rows)


def test_op12_every_near_pair_has_a_chain():
    rng = random.Random(1)
    assert [simhash.budget(n) for n in range(1, 9)] == [0, 0, 1, 1, 1, 2, 2, 3] and len({m for _, m in simhash.KEYS}) == 24
    for _ in range(3000):
        x = 0
        for _ in range(rng.randint(0, 3)):
            x |= 1 << rng.randrange(64)
        starts = [i for i, mask in simhash.KEYS if not x & mask and len(simhash.within_budgets(np.array([x], np.uint64), i))]
        assert starts
    for i in range(8):
        assert not len(simhash.within_budgets(np.array([0b1111 << 8 * i], np.uint64), i))


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, n string"


def make_turns(seed=0):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), -7, -5, 1003, 1000, 64, 62]:
        turns = [rng.choice(["hello", "", None, "naïve 日", "bye"]) for _ in range(rng.randint(1, 14))]
        rows += [(c, k, rng.choice(["user", "user", None]), t, k, "x") for k, t in enumerate(turns)]
    rows += [(31, None, "system", "first", 1, "x"), (None, 0, "user", "nobody", 1, "x"), (70, 0, "user", "copy", 1, "x"), (70, 0, "user", "copy", 1, "x")]
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    base = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in by}
    rebuilt = {c: by.get(base(c), [])[: head[c]] + v[head[c] :] for c, v in by.items()}
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, tokens = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            tokens[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(str(c) for c in m if len(rebuilt[c]) == len(k)) for k, m in members.items()}
    return [
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], tokens[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()
    ]


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talks"))
    spark.createDataFrame(make_turns(), CONVERSATIONS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_op13_against_brute_force_and_sql(spark, talks):
    want = ordered(brute_trie(make_turns()))
    got = queries.QUERIES["op13_prefix_nodes"](spark, talks).select(*TRIE).collect()
    assert ordered(map(tuple, got)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{talks}/conversations.parquet/*.parquet'")
    rows = con.sql(queries.ORACLE_SQL["op13_prefix_nodes"])
    at = [rows.columns.index(c) for c in TRIE]
    assert ordered(tuple(r[k] for k in at) for r in rows.fetchall()) == want
    assert min(r[0] for r in want) == -7 and max(r[3] for r in want) == 67


@pytest.mark.parametrize(("size", "shard_rows"), [(2, 20), (3, 1), (5, 1000)])
def test_op13_bands_of_long_conversations(spark, size, shard_rows):
    rows = [(c, k, "user", f"t{k % 3}" if c != 9 or k < 40 else "other", k, "x") for c, n in ((3, 200), (4, 200), (9, 120), (11, 7)) for k in range(n)]
    turns = prefixtrie.turns_of(spark.createDataFrame(rows, CONVERSATIONS))
    conv = F.col("conv_id")
    found = prefixtrie.trie_nodes(prefixtrie.with_heads(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8), size, shard_rows)
    assert ordered(map(tuple, found.select(*TRIE).collect())) == ordered(brute_trie(rows))


def test_op13_slots_are_minimal_and_verified():
    keys = np.random.default_rng(0).integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    table = prefixtrie.SlotTable(keys)
    assert sorted(table.find(keys).tolist()) == list(range(20_000))
    assert (table.find(keys + np.uint64(1)) == -1).all()
    assert (prefixtrie.SlotTable(keys[:0]).find(keys[:3]) == -1).all()


def test_op13_one_digest_with_two_contents_is_an_error(spark):
    part = lambda shard, c1: ("node", shard, 1, 1, 5, 6, 0, 0, c1, 0, 3, 1)
    with pytest.raises(Exception, match="two prefixes have one digest"):
        prefixtrie.summed_nodes(spark.createDataFrame([part(1, 8), part(2, 9)], prefixtrie.PARTS)).collect()


@pytest.mark.parametrize("name", ["op11_token_spans", "op12_simhash", "op13_prefix_nodes"])
def test_empty_tables(spark, empty_folder, name):
    assert queries.QUERIES[name](spark, empty_folder).collect() == []


def test_lines_of_one_text_give_what_texts_apart_give(monkeypatch):
    own = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" word", "\nLine", " café", " 日本\U0001f600", "...", " x1,", "\nü", " <0x41>", "▁a", " zwłoka"] * 3
    calls = []
    pieces = own.b_pieces
    monkeypatch.setattr(own, "b_pieces", lambda lines: calls.append(len(lines)) or pieces(lines))
    together = own.whole(texts)
    assert calls == [1]
    assert together == [own.whole([t])[0] for t in texts] and together[0] is not None
    monkeypatch.setattr(own, "b_lines", lambda texts: None)
    assert own.whole(texts) == together
