"""Coding of texts, decoded layers, suffix order and hashing without Spark."""

import base64
import gzip
import random
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from foldstone.llm import bpe_lexicon as bpe
from foldstone.llm import secret_scan as secrets
from foldstone.llm.common import batches, rolling, utf8_buffer, word_hashes
from foldstone.llm.hadamard_lsh import buckets, hadamard, rotate
from foldstone.llm.jaccard_join import Block, shingle_sets, spanning_links
from foldstone.llm.suffix_dedup import finer, repeated_starts, runs, two_stage_order
from foldstone.llm.toxicity import LabelModel

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_merges_like_the_library(vocab):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    merge = bpe.Merger(vocab.byte_ids, vocab.merges)
    words = regex.compile(bpe.SPLIT).findall
    rng = random.Random(1)
    letters = "abcdeghinorst ESTAN'sé ü ß日本\n\t.,!0123 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a" * 5000, "héllo" * 2000, "", " ", "\n\n x"]
    for text in texts:
        own = [i for p in bpe.pieces(text) for w in words(p) for i in merge(w.encode())]
        assert own == library.encode(text, add_special_tokens=False).ids


def test_automaton_numbers_words_and_shares_suffixes(tmp_path):
    words = sorted({w.encode() for w in "tap taps top tops stop stops a é état".split()})
    arrays = bpe.minimal_automaton(words)
    assert len(arrays["ends"]) < sum(len(w) for w in words)
    path = str(tmp_path / "x.bin")
    bpe.save(path, arrays)
    coder = bpe.Coder.__new__(bpe.Coder)
    coder.whole, views, _ = bpe.mapped(path)
    coder.v = {k: np.frombuffer(x, x.format) for k, x in views.items()}
    coder.sort_edges()
    assert coder.places(words).tolist() == list(range(len(words)))
    assert coder.places([b"", b"ta", b"tapss", b"z"]).tolist() == [-1] * 4
    assert coder.places([]).tolist() == []


def test_many_words_merge_like_one(vocab):
    merge = bpe.Merger(vocab.byte_ids, vocab.merges)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghinorst aéß日") for _ in range(rng.randrange(60))).encode()
             for _ in range(500)] + [b"", b"a", b"aaaaaaa", b"a" * 39, b"a" * 40, b"a" * 41]
    ids, sizes = merge.many(words)
    parts = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts == [merge(w) for w in words]
    assert [len(x) for x in merge.many([])] == [0, 0]


SECRET = "password=abcdef123456"


@pytest.mark.parametrize("wrap", [
    lambda b: base64.b64encode(b).decode(),
    lambda b: base64.b64encode(gzip.compress(b)).decode(),
    lambda b: base64.b64encode(base64.b64encode(zlib.compress(b))).decode(),
    lambda b: "".join(f"\\u{c:04x}" for c in b),
    lambda b: "".join(f"&#{c};" for c in b),
    lambda b: urllib.parse.quote(urllib.parse.quote(b)),
])
def test_secret_in_layers_maps_to_its_stretch(wrap):
    hidden = wrap(SECRET.encode())
    text = f"é\U0001F600 see {hidden} end"
    base, inner = secrets.scan(text)
    assert base == []
    assert any(kind == "assign" and hidden[5:15] in text[a:b] and text[a:b] in hidden
               for a, b, kind in inner)


def test_secret_edges():
    assert secrets.scan(None) == secrets.scan("") == ([], [])
    assert secrets.scan("API_KEY : 'abc") == ([], [])
    base, _ = secrets.scan("Token='abcdef' " + "f" * 24 + " AKIA" + "A" * 16)
    assert [k for *_, k in base] == ["assign", "hex", "access"]
    assert secrets.scan("to\u212aen=abcdef")[0] == []  # a Kelvin sign is no k
    bomb = base64.b64encode(zlib.compress(b"\0" * (secrets.MAX_LAYER + 10))).decode()
    assert (0, len(bomb), "packed") in secrets.scan(bomb)[1]


def test_words_hash_alike_anywhere():
    texts = pa.array(["A b c d e", None, "", "x a  B\tc d\ne y", "b" * 70])
    data, at = utf8_buffer(texts)
    h, first = word_hashes(data, at)
    assert first.tolist() == [0, 5, 5, 5, 12, 13]
    assert h[0:5].tolist() == h[6:11].tolist()
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [1, 0, 0, 3, 1]
    assert sets[0][0] in sets[3]


def test_long_text_in_blocks(monkeypatch):
    from foldstone.llm import common

    texts = pa.array(["one two three four five six " * 50, "seven" * 300 + " x", "q"])
    whole = word_hashes(*utf8_buffer(texts))
    monkeypatch.setattr(common, "_BLOCK", 64)
    parts = word_hashes(*utf8_buffer(texts))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_links_like_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        pool = [np.uint64(rng.randrange(1 << 60)) for _ in range(40)]
        sets = []
        for _ in range(rng.randrange(2, 14)):
            size = rng.choice([1, 4, 10, 20, 21, 22, 25])
            sets.append(np.unique(np.array(rng.sample(pool[:size + 3], size), np.uint64)))
        want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j
                and 100 * len(np.intersect1d(sets[i], sets[j]))
                >= 80 * len(np.union1d(sets[i], sets[j]))}
        block = Block(sets)
        assert {(i, j) for i in range(len(sets)) for j in block.links(i, 80)} == want

        def groups(links, n=len(sets)):
            root = list(range(n))
            for a, b in list(links) * n:
                root[a] = root[b] = min(root[a], root[b])
            return root

        assert groups(spanning_links(sets, 80)) == groups(want)


def test_two_stage_order_is_the_order_of_the_strings():
    rng, depth = random.Random(2), 8
    for _ in range(100):
        text = bytes(rng.choice(b"aab\x00\xfe") for _ in range(rng.randrange(9, 80))) + b"\xff"
        starts = range(len(text) - depth)
        want = np.array(sorted(rng.sample(starts, rng.randrange(1, len(starts) + 1))))
        got = two_stage_order(text, want, depth)
        assert sorted(got) == want.tolist()
        assert [text[i:i + depth] for i in got] == sorted(text[i:i + depth] for i in got)


def test_repeated_starts_like_counting():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.choice([3, 5, 8])
        pieces = [bytes(rng.choice(b"ababz\x00") for _ in range(rng.randrange(40)))
                  for _ in range(rng.randrange(1, 8))]
        seen = Counter(p[i:i + n] for p in pieces for i in range(len(p) - n + 1))
        want = [[i for i in range(len(p) - n + 1) if seen[p[i:i + n]] > 1] for p in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, n)] == want


def test_runs_cover_every_start_once_and_agree_on_equal_strings():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(120))) for _ in range(30)]
    texts += [texts[0] + texts[1], "aaaa" * 40, "", None]
    data, at = utf8_buffer(pa.array(texts))
    length, gram = 40, 8
    anchor_of, name_of, seen = {}, {}, set()
    for text, first, last, place, anchor in zip(*(c.tolist() for c in runs(data, at, length, gram))):
        for s in range(first, last + 1):
            assert (text, s) not in seen
            seen.add((text, s))
            piece = texts[text][s:s + length]
            assert anchor_of.setdefault(piece, (anchor, place - s)) == (anchor, place - s)
        # finer names: every start once, equal strings alike, and in classes of one name for each
        run = {"first": first, "last": last, "place": place, "anchor": anchor - (1 << 63)}
        for width in (32, 5, 1):
            parts = list(finer(texts[text].encode(), run, width, length, gram))
            assert sorted(s for _, a, b in parts for s in range(a, b + 1)) == list(range(first, last + 1))
            for name, a, b in parts:
                for s in range(a, b + 1):
                    piece = texts[text][s:s + length]
                    assert name_of.setdefault((width, piece), name) == name
    assert seen == {(i, s) for i, t in enumerate(texts)
                    for s in range(len(t or "") - length + 1)}
    ones = {name for (width, _), name in name_of.items() if width == 1}
    assert len(ones) == len(anchor_of)


def test_rolling_and_batches():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = rolling(data, 3)
    assert h[0] == h[3] == h[6] and len(set(h[:3].tolist())) == 3 and len(rolling(data[:2], 3)) == 0
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    cut = list(batches([batch], 12))
    assert sum(b.num_rows for b in cut) == 5 and len(cut) > 1
    assert list(batches([batch.slice(0, 0)])) == []


def test_rotation_keeps_lengths_and_near_vectors_meet():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 12))
    assert np.allclose(np.linalg.norm(rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))
    y = rng.normal(size=(3, 8))
    assert np.allclose(hadamard(hadamard(y)), y)
    near = x + 0.01 * rng.normal(size=x.shape)
    a, b = buckets(x), buckets(near)
    assert np.mean([(set(p.ravel()) & set(q.ravel())) != set() for p, q in zip(a, b)]) > 0.9


def test_label_model_recovers_accuracies_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    accuracy = [0.9, 0.8, 0.75, 0.85]
    votes = np.stack([np.where(rng.random(len(y)) < a, y, ~y) * 2 - 1 for a in accuracy], 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(patterns, counts)
    assert np.allclose(model.accuracies, accuracy, atol=0.06)
    assert abs(model.prior[1] - 0.2) < 0.05
    twice = np.concatenate([votes, votes[:, 1:2]], 1)  # one voter copied
    p2, c2 = np.unique(twice, axis=0, return_counts=True)
    again = LabelModel(p2, c2)
    assert again.correlations[1, 4] > 0.9 and again.weights[1] < 0.7
