"""Parts that need no Spark, against brute force and exact round trips."""

import base64
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard

from marketloom.llm import binpack, bitpack, bytecnn, oddsketch, piecemodel, reshard, styletree, tokens, zbands


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x1F600, 0x200D, 0x85, 0xA0, 0x30A]] + [" "] * 60 + ["\n"] * 20 + ["'s", "'ll", "<|endoftext|>", "don't ", "  ", "1234"] * 8
    return ["", " ", "\n", "a", "a b\nc"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    own = tokens.TextEncoder(public_tokenizers.path(name))
    for text in odd_texts():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_piece_model_equals_tiktoken_and_decodes():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = piecemodel.PieceCodec(path, public_tokenizers.PATTERN)
    for text in odd_texts(seed=2):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    assert own.encode(None) == b""


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31])
def test_bits_round_trip_and_random_access(bits):
    import io

    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000).astype("<u4")
    assert bitpack.unpack(bitpack.pack(ids, bits), 1000, bits).tolist() == ids.tolist()
    lengths = np.array([0, 400, 1, 599])
    file = bitpack.PackedFile(io.BytesIO(bitpack.encode_file(np.arange(4), lengths, ids, bits, block=64)))
    assert file.span(100, 333).tolist() == ids[100:333].tolist()
    assert [len(file.document(k)) for k in range(4)] == lengths.tolist()


@pytest.mark.parametrize("n", [0, 1, 30, 2000])
def test_plan_places_every_piece_once(n):
    rng = random.Random(n)
    counts: dict[int, int] = {}
    for _ in range(n):
        length = min(1024, max(1, int(rng.expovariate(1 / 400))))
        counts[length] = counts.get(length, 0) + 1
    plan = binpack.plan_sequences(counts, 1024)
    filled: dict[int, list[tuple[int, int]]] = {}
    seen = {k: set() for k in counts}
    for length, first, count, sequence, offset in plan.rows:
        for i in range(count):
            assert first + i not in seen[length]
            seen[length].add(first + i)
            filled.setdefault(sequence + i, []).append((offset, length))
    assert all(len(seen[k]) == v for k, v in counts.items()) and len(filled) == plan.sequences
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(k * v for k, v in counts.items())
    assert plan.sequences <= 1.03 * -(-total // 1024) + 2


def test_min_cost_flow_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(20):
        supply = [rng.randint(0, 4) for _ in range(3)]
        total = sum(supply)
        cut = sorted(rng.randint(0, total) for _ in range(2))
        demand = [cut[0], cut[1] - cut[0], total - cut[1]]
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
        got = sum(f * c for fr, cr in zip(flow, cost, strict=True) for f, c in zip(fr, cr, strict=True))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, d in enumerate(demand) for _ in range(d)]
        best = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots))), default=0) if total <= 7 else got
        assert got == best


def brute_repeats(words, window=8):
    places = {}
    for i in range(len(words) - window + 1):
        places.setdefault(tuple(words[i : i + window]), []).append(i)
    hit = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(window)}
    return len(hit)


def test_repeat_words_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert zbands.repeat_words(words) == brute_repeats(words)


def test_bands_reject_repetition_and_noise_and_keep_prose():
    rng = random.Random(7)
    zip_ = zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600))
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)) + " x" * 30
    kept = lambda t: zbands.measure(t, zbands.Bands(), zip_)[-1]
    assert kept(prose) and not kept("spam words here " * 400) and not kept("") and not kept(None)
    assert zbands.measure(noise, zbands.Bands(), zip_)[6] < 2
    n_words, word_chars, symbols, dup_lines, *_ = zbands.measure("a # b\na # b\n\n\n", zbands.Bands(), zip_)
    assert (n_words, word_chars, symbols, dup_lines) == (6, 6, 2, 1)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    shape = bytecnn.Shape(chunk=32, overlap=8, width=4, stride=2, filters=5, hidden=4)
    net = bytecnn.Network.fresh(shape, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    chunks = rng.integers(0, 256, (5, 32)).astype(np.int16)
    starts, labels = np.array([0, 3]), np.array([1.0, 0.0])

    def loss():
        m = net.responses(chunks)
        z = net.logit(bytecnn.combined(m, starts))
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    net32 = bytecnn.Network(shape, {k: v.astype(np.float32) for k, v in net.weights.items()})
    grads = bytecnn.gradients(net32, chunks, starts, labels)
    net = net32
    for name in ("filters", "hidden", "out"):
        flat = net.weights[name].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 6)):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - grads[name].reshape(-1)[i]) < 2e-3


def test_network_learns_and_scores_every_text():
    rng = random.Random(4)
    good = [" ".join(rng.choice(["tree", "river", "stone", "cloud"]) for _ in range(rng.randint(5, 200))) for _ in range(150)]
    bad = ["".join(rng.choice("#$%&*") for _ in range(rng.randint(20, 900))) for _ in range(150)]
    labels = np.array([1] * 150 + [0] * 150)
    net = bytecnn.fit(good + bad, labels, 0.5, passes=2400)
    scores = net.score([*good, *bad, "", None])
    assert (scores[:150] >= 0.5).mean() > 0.95 and (scores[150:300] < 0.5).mean() > 0.95
    assert scores[-1] == scores[-2] == 0 and ((scores >= 0) & (scores <= 1)).all()
    assert bytecnn.fit(good, labels[:150], 0.8).score(["x", ""]).tolist() == [0.8, 0.0]
    covered = bytecnn.chunks_of(bytes(range(256)) * 9, bytecnn.Shape())
    assert set(range(256)) <= set(covered[-1].tolist()) and covered.shape[1] == 512


def test_odd_sketch_estimates_high_similarity():
    rng = random.Random(9)
    words = oddsketch.Words()
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    errors = []
    for k in (0, 1, 2, 4, 8):
        other = list(base)
        for i in rng.sample(range(400), k):
            other[i] = "x"
        one, two = (oddsketch.shingle_set(" ".join(t), 4, words) for t in (base, other))
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = (oddsketch.odd_sketch(oddsketch.samples_of(s)) for s in (one, two))
        d = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        estimate = 1 + oddsketch.SKETCH_BITS / (4 * oddsketch.SAMPLES) * np.log(max(1e-9, 1 - 2 * d / oddsketch.SKETCH_BITS))
        errors.append(abs(estimate - true))
    assert errors[0] == 0 and max(errors) < 0.15


def test_style_tree_parser():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a><li>B</ul></nav>
    <!-- ad --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>one<br>two<p>three &lt;x&gt;\n four</p><section id=comments><p>hi</p></section></article><footer>&copy;</footer>"""
    blocks, _ = styletree.parse(page)
    assert [(b.text, b.noise) for b in blocks] == [("Home", True), ("B", True), ("Buy", True), ("A & B", False), ("one two", False), ("three <x> four", False), ("hi", True), ("©", True)]
    for broken in ("", "<", "</p>", "<p", "<!--", "<script>", "<a href='x>y", "a<b", "<p><p></div></p>" * 50):
        styletree.parse(broken)


def test_crc_of_bytes_view():
    assert zlib.crc32(np.array([1, 2], "<u4")) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
