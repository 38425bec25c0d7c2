"""Main text, hard negatives and token alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldstone.llm import hard_negatives as hn
from foldstone.llm import queries
from foldstone.llm.host_boilerplate import MIN_PAGES, MIN_TOKENS, boilerplate, main_text, read_pages
from foldstone.llm.page_blocks import read_page
from foldstone.llm.queries_alignment import piece_path
from foldstone.llm.queries_bpe import vocabulary_path
from foldstone.llm.token_alignment import align_tokens, piece_bytes
from foldstone.workload.check import compare, connect

from ..conftest import DATA

# hard negatives


def plain_negatives(rows, every=100, positives=5, negatives=10):
    best = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other)
                        for i, (other, w) in best.items() if i != a)
        for s, p, other in [r for r in ranked if r[2] == label][:positives]:
            fits = [r for r in ranked if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n=700, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.choice((-1.0, 0.0, 0.25, 0.5, 1.0)) for _ in range(6)])
            for i in range(n)]
    rows += [(n, None, [1.0] * 6), (n + 1, 1, None), (100 * n, 1, [1.0, None] * 3),
             (n + 3, 2, [float("nan")] * 6), (n + 4, 2, [float("inf")] * 6), (None, 1, [1.0] * 6),
             (n + 5, 0, []), (n + 6, 0, [1.0, 1.0]), rows[5], rows[100], (200, 2, [0.5] * 6),
             (-300, 0, [1.0] * 6), (100 * n + 100, 0, [])]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>") \
        .withColumn("id", F.lit("x")).withColumn("score", F.lit("y")).withColumn("v", F.lit(1))


@pytest.mark.parametrize("block, shared", [(1 << 20, 32 << 20), (4000, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, shared):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block)
    monkeypatch.setattr(hn, "SHARED_BYTES", shared)
    rows = vectors()
    found = hn.hard_negatives(vector_frame(spark, rows).repartition(3))
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    assert hn.hard_negatives(vector_frame(spark, [])).count() == 0
    rows = [(0, 1, [2.0**20, 1.0]), (1, 1, [2.0**20, 3.0]), (2, 2, [2.0**19, 7.0])]
    assert sorted(map(tuple, hn.hard_negatives(vector_frame(spark, rows)).collect())) == \
        plain_negatives(rows)


def test_hard_negatives_equal_sql(spark):
    name = "op12_hard_negatives"
    assert compare(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name]) is None


# alignment of two tokenizers


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    from foldstone.llm.bpe_lexicon import Vocabulary

    a_bytes = Vocabulary(vocabulary_path()).bytes_of
    docs = []
    for text in texts:
        want = (" " + text).encode() if text else b""
        sides = []
        for ids, of in ((a.encode(" " + (text or ""), add_special_tokens=False).ids,
                         lambda i: a_bytes[i]),
                        (b.encode(text or ""), lambda i: piece_bytes(b.id_to_piece(i)))):
            sides.append([(i, of(i)) for i in ids] if text else [])
        if any(b"".join(t for _, t in s) != want for s in sides):
            sides = [[], []]
        ends = [[0], [0]]
        for s, e in zip(sides, ends):
            for _, t in s:
                e.append(e[-1] + len(t))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for lo, hi in zip(cuts, cuts[1:]):
            groups.append([[i for (i, _), x in zip(s, e[1:]) if lo < x <= hi]
                           for s, e in zip(sides, ends)])
        docs.append((sides, groups))
    held = Counter()
    for _, groups in docs:
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    high = defaultdict(int)
    for (x, _), n in held.items():
        high[x] = max(high[x], n)
    out = []
    for (left, right), groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(left), len(right), len(groups), len(links),
                    sum(held[p] == high[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def token_texts():
    rng = random.Random(1)
    words = ["the", "Über", "ñandú", "naïve", "x1", "日本語", "\U0001F600", "don't", "12345", "a.b",
             "<|endoftext|>", "<s>", "▁", "Erverheit", "  ", "\n", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    return texts + [None, "", " ", "a", "﻿x", "a b", "<unk>", "x" * 3000, texts[0], texts[0],
                    "the " * 3000]


@pytest.mark.parametrize("shared", [1 << 20, 20, 0])
def test_alignment_equals_brute_force(spark, shared):
    texts = token_texts()
    ids = [i if i != 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string") \
        .withColumn("row", F.lit("a")).withColumn("pairs", F.lit("b")).repartition(3)
    found = align_tokens(docs, vocabulary_path(), piece_path(), shared=shared)
    mine = sorted(map(tuple, found.collect()), key=repr)
    assert mine == sorted(((i, *r) for i, r in zip(ids, plain_alignment(texts))), key=repr)
    assert any(r[1] == 0 for r in mine) and any(r[1] > 900 for r in mine)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokens(docs, vocabulary_path(), piece_path()).count() == 0


def test_large_groups_are_added_up_like_small_ones(monkeypatch):
    from foldstone.llm import token_alignment as ta

    a, b = ta.sides(vocabulary_path(), piece_path())
    texts = [t for t in token_texts()]
    whole = ta.align_batch(texts, a, b)
    monkeypatch.setattr(ta, "LINKS_AT_ONCE", 2)
    parts = ta.align_batch(texts, a, b)
    for name in whole:
        assert list(whole[name]) == list(parts[name])


# main text


FRAME = ("<div class=top><a href='/'>Home</a> <a href='/n'>All news of the region today</a> "
         "<span>open daily from nine to five call us any time you like</span></div>")
END = ("<p>Copyright of this page belongs to the publisher of this site , all rights kept "
       "for ever and ever and ever .</p>")


def bare(i, body):
    return f"<html><body>{FRAME}<div id=content>{body}</div>{END}<!-- {i} --></body></html>"


def site():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "ko", "ti", "re", "su"]) for _ in range(3))
    body = lambda: "".join(f"<p>{' '.join(word() for _ in range(20))}</p>" for _ in range(3))
    rows = [(i, f"http://hot.example.org/{i}", bare(i, body())) for i in range(40)]
    rows += [(100 + i, f"http://b{i % 2}.example.org/{i}", bare(i, body())) for i in range(3)]
    rows += [(200, "http://hot.example.org/a", f"<nav>x</nav><article><h1>T</h1>{END}</article>"),
             (201, None, None), (202, "http://hot.example.org/e", ""), (None, "nonsense", "plain & text"),
             rows[0], rows[0], (203, "http://hot.example.org/only", bare(0, ""))]
    return rows


def site_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string") \
        .withColumn("host", F.lit("h")).withColumn("text", F.lit("t")).withColumn("open", F.lit(1))


def plain_covered(read):
    """Tokens in runs on enough distinct pages of the host, by counting every run."""
    from foldstone.llm.host_boilerplate import break_token

    pages = {(r.host, r.k1, r.k2): list(r.stream) for r in read}
    on = defaultdict(set)
    runs = lambda s: ((p, tuple(s[p:p + MIN_TOKENS])) for p in range(len(s) - MIN_TOKENS + 1)
                      if break_token() not in s[p:p + MIN_TOKENS])
    for key, s in pages.items():
        for _, run in runs(s):
            on[key[0], run].add(key)
    out = {}
    for key, s in pages.items():
        out[key] = [False] * len(s)
        for p, run in runs(s):
            if len(on[key[0], run]) >= MIN_PAGES:
                out[key][p:p + MIN_TOKENS] = [True] * MIN_TOKENS
    return out


@pytest.mark.parametrize("block_tokens", [1 << 20, 300])
def test_boilerplate_equals_brute_force(spark, block_tokens):
    read = read_pages(site_frame(spark, site()))
    want = plain_covered(read.collect())
    opened = {(r.host, r.k1, r.k2) for r in read.filter("open").collect()}
    found = {(r.host, r.k1, r.k2): r.covered for r in
             boilerplate(read, block_tokens=block_tokens).collect()}
    assert found == {k: v for k, v in want.items() if k in opened}
    assert any(any(v) and not all(v) for v in found.values())


@pytest.mark.parametrize("block_tokens", [1 << 20, 300])
def test_unique_runs_are_kept(spark, block_tokens):
    rows = site()
    found = main_text(site_frame(spark, rows).repartition(3), block_tokens=block_tokens)
    texts = defaultdict(list)
    for r in found.collect():
        texts[r.id].append(r.text)
    assert sum(map(len, texts.values())) == len(rows)
    for i, _, source in rows[:40]:
        body = source.split("content>")[1].split("</div>")[0]
        assert set(texts[i]) == {"\n".join(x for x in body.replace("</p>", "").split("<p>") if x)}
    assert "Copyright" in texts[100][0]  # its host has too few pages to tell
    assert texts[200][0].startswith("T\nCopyright")  # an article stays whole
    assert texts[201] == [""] and texts[202] == [""] and texts[None] == ["plain & text"]
    assert main_text(site_frame(spark, [])).count() == 0


@pytest.mark.parametrize("source, want", [
    ("<article><h1>A &amp; b</h1><p>one<br>two <b>bo<i>ld</b></i>\n x</article>", "A & b|one two bold x"),
    ("<article><p>x<aside>no</aside><p>y<div class='comment-list'>no</div>z</article>q", "x|y|z"),
    ("<main><nav>no</nav><p>a<form>no</form></main><p>no", "a"),
    ("<article><ul><li>1<li class=ad>no<li>3</ul></article>", "1|3"),
    ("<article><p>cut off &copy and <a href='x", "cut off © and"),
    ("<article><script>var t='</p>';</script><style>p{}</style><!-- no --><p>yes", "yes"),
    ("<article><p>a</b>b</i></p></div>c</article>", "ab|c"),
    ("<article><p>a < b &lt; c &am &nbsp; d</article>", "a < b < c &am d"),
    ("<article><span class=share>no</span>kept<p hidden>no</p></article>", "kept"),
    ("<header>no</header><article><header><h1>T</h1></header><p>x</article><footer>no", "T|x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a|b|c"), ("<p>", ""), ("", ""), (None, ""),
])
def test_blocks_of_a_page(source, want):
    blocks = read_page(source).blocks
    top = max((b.level for b in blocks), default=0)
    assert "|".join(b.text for b in blocks if b.level == top) == want


def test_a_page_is_read_in_linear_time():
    import time

    for piece in ("<div>", "<p>x", "</div>", "<a href='", "<b", "<b><div>", "<!--", "&amp", "<li>y<ul>"):
        start = time.process_time()
        read_page(piece * 20_000)
        assert time.process_time() - start < 8, piece
