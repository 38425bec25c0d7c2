"""Every operator over a small table of awkward rows, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldstone.llm import ngram_quality, queries
from foldstone.llm.bpe_lexicon import compile_lexicon, decode, encode
from foldstone.llm.common import components
from foldstone.llm.hadamard_lsh import near_vectors
from foldstone.llm.jaccard_join import first_of_class, jaccard_classes
from foldstone.llm.pii_boost import find_personal
from foldstone.llm.poisson_mix import mix_sources
from foldstone.llm.secret_scan import find_secrets, redact, scan
from foldstone.llm.suffix_dedup import remove, repeats
from foldstone.llm.toxicity import toxicity
from foldstone.llm.warc_zstd import read_archives, write_archives
from foldstone.workload.check import compare, connect

from ..conftest import DATA
from . import brute

CLASH = {c: f"own {c}" for c in ("ids", "kept", "base", "key", "copy", "group", "row", "root", "p",
                                 "n_words", "perplexity", "decoded", "rate", "node", "_n")}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"`{c}` string" for c in CLASH))


def awkward():
    rng = random.Random(7)
    syllables = "ba de fi go lu ma ne pi ro su ta ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 160))) for _ in range(30)]
    near = []
    for t in texts[:6]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    passage = " ".join(word() for _ in range(90))
    texts += near + [texts[0]] * 3 + [f"{passage} tail {i}" for i in range(3)]
    texts += [None, "", " \n\t ", "one", "one two", "same line\nsame line\nother\n", "1" * 500,
              "mail a.b@c.de or +1 (234) 555-0100 ip 10.0.0.1 card 4539 5787 6362 1486",
              "key password=abcdef123 " + word() + " %70assword%3Dhidden99 \U0001F600",
              "$$$ %%% " * 40, "<|endoftext|> x  y z", "word " * 5000]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + ["b", None]),
             None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[31], (None, texts[1], "en", "b", 5), (None, None, None, None, None)]
    return [(*r, *CLASH.values()) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(rows):
    return [(r[0], r[1]) for r in rows]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (22, 21), (1, 5), (3, 3), (9, 8)]
    found = {r.node: r.root for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys((1, 5, 6, 7, 8, 9), 1), **dict.fromkeys((20, 21, 22), 20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encode_and_decode(docs, rows, empty):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    lexicon = compile_lexicon(docs, path, min_count=2, max_words=50)
    coded = encode(docs, lexicon)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "n_tokens"]
    got = sorted([(r.doc_id, r.ids, r.n_tokens, r.decoded)
                  for r in decode(coded, lexicon).select("doc_id", "ids", "n_tokens", "decoded")
                  .collect()], key=lambda r: (key(r[:1]), r[1]))
    want = []
    for i, t in texts_of(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=lambda r: (key(r[:1]), r[1]))
    assert encode(empty, compile_lexicon(empty, path)).count() == 0


def test_secrets(docs, rows, empty):
    found = find_secrets(docs)
    assert set(docs.columns) | {"inner"} == set(found.columns)
    got = {(r.doc_id, r.text): ([tuple(s) for s in r.base], [tuple(s) for s in r.inner])
           for r in found.collect()}
    for i, t in texts_of(rows):
        assert got[i, t] == tuple(scan(t))
    clean = redact(docs)
    assert clean.columns == docs.columns
    for r in clean.filter("text like '%key%'").collect():
        assert r.text.count("[secret]") == 2 and "hidden" not in r.text and "abcdef" not in r.text
    assert clean.filter("text is null").count() == 2 and redact(empty).count() == 0


def test_quality_counts_and_model(docs, rows, empty):
    got = ngram_quality.assess(docs)
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(rows)
    langs = {}
    for r in rows:
        langs.setdefault(r[2] or "", []).append(r[1])
    models = {lang: brute.KneserNey(t) for lang, t in langs.items()}
    for r in rows:
        g = by[r[0], r[1]]
        assert tuple(g[c] for c in ngram_quality.COUNTS) == brute.base_counts(r[1])
        want = models[r[2] or ""].perplexity(r[1])
        assert g.perplexity == pytest.approx(want, rel=1e-5) if want else g.perplexity is None
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    assert any(r.kept for r in by.values())
    assert ngram_quality.assess(empty).count() == 0


def test_quality_bands_reject_far_texts(spark):
    rng = random.Random(3)
    words = [a + b + c for a in "abcde" for b in "fghij" for c in "klmno"]
    usual = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    far = " ".join("".join(rng.choice("qxzjkw#%") for _ in range(5)) for _ in range(120))
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*usual, far])],
                                  "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in ngram_quality.assess(table).collect()}
    assert not kept.pop(60) and all(kept.values())


def test_jaccard_classes(docs, rows, empty):
    for chunk in (4096, 4):  # 4: blocks dealt in chunks
        found = jaccard_classes(docs, chunk=chunk)
        got = sorted([(r.id, r.n_shingles, r.component_id) for r in found.collect()], key=key)
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        first, sizes = brute.classes([r[1] for r in order])
        want = [(r[0], n, order[f][0]) for r, f, n in zip(order, first, sizes)]
        assert got == sorted(want, key=key)
    one = first_of_class(docs)
    assert one.columns == docs.columns
    blank = [r for r in order if not brute.shingles(r[1])]
    # rows without shingles are their own, but equal rows are one row
    assert one.count() == len({f for r, f in zip(order, first) if brute.shingles(r[1])}) \
        + len({(r[0], r[1] or "") for r in blank})
    assert jaccard_classes(empty).count() == 0


def test_jaccard_crowds(spark):
    """A passage in many documents, many near copies, and many copies, over several tasks."""
    rng = random.Random(11)
    word = lambda: str(rng.randrange(10**6))
    passage = " ".join(word() for _ in range(40))
    base = [word() for _ in range(60)]
    texts = [f"{passage} " + " ".join(word() for _ in range(50)) for _ in range(90)]
    for _ in range(90):
        w = list(base)
        w[rng.randrange(60)] = word()
        texts.append(" ".join(w))
    texts += [texts[0]] * 70
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    first, _ = brute.classes(texts)
    for chunk in (4096, 16):
        got = {r.id: r.component_id for r in jaccard_classes(table, chunk=chunk).collect()}
        assert got == dict(enumerate(first))


def test_mixing(docs, rows, empty):
    mixed = mix_sources(docs, seed=3)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    got = sorted([(r.doc_id, r.text, r.copy) for r in mixed.collect()], key=lambda r: key(
        (r[0], r[2])) + (r[1] or "",))
    rate = brute.rates([r[3] for r in rows])
    want = [(r[0], r[1], k + 1) for r in rows
            for k in range(brute.copies(r[0], r[1], rate[r[3]], 3))]
    assert got == sorted(want, key=lambda r: key((r[0], r[2])) + (r[1] or "",))
    assert mix_sources(empty).count() == 0
    many = mix_sources(docs.sparkSession.range(4000).selectExpr(
        "id as doc_id", "'t' as text", "if(id % 4 = 0, 'a', 'b') as source"),
        weights={"a": 3.0, "b": 1.0})
    counts = dict(many.groupBy("source").count().collect())
    assert abs(counts["a"] - 3000) < 200 and abs(counts["b"] - 1000) < 150
    assert mix_sources(docs, weights={"hot": 1.0}).filter("source = 'b' or source is null").count() == 0


def test_suffix_removal(docs, rows, empty, spark):
    for length, gram in ((400, 32), (40, 8)):
        found = remove(repeats(docs, length=length, gram=gram))
        got = sorted([(key((r.id,)), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                      for r in found.collect()])
        want = [(key((r[0],)), *k) for r, k in zip(rows, brute.kept_bytes(
            [r[1] for r in rows], length))]
        assert got == sorted(want)
    assert remove(repeats(empty)).count() == 0


def test_suffix_removal_with_a_frequent_phrase(spark):
    """A phrase in a third of the documents, with its own text around it and, in some, shared text."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, long_phrase = noise(30), noise(36)
    tails = [noise(25) for _ in range(4)]
    rows = []
    for i in range(240):
        text = noise(60)
        if i % 3 == 0:
            text += phrase + (tails[i % 4] if i % 5 == 0 else noise(25)) + noise(30)
        elif i % 3 == 1 and i % 2:
            text += long_phrase + noise(50)
        rows.append((i, text + noise(20), "k", 1))
    rows += [(500, "ab" * 200, "k", 1), (501, "x" * 90, "k", 1), rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string, place int")
    want = sorted((r[0], *k) for r, k in zip(rows, brute.kept_bytes([r[1] for r in rows], 40)))
    assert 10 < sum(1 for w in want if w[2]) < 200
    for split in (4, 20, 4096):  # both finer levels, one of them, none
        found = remove(repeats(table, length=40, gram=8, split=split))
        assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                      for r in found.collect()) == want


def test_vectors(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = []
    for i in range(160):
        v = [x + rng.gauss(0, 0.02) for x in base[i % 12]]
        rows.append((i, v, i % 2 if i % 7 else None))
    rows += [(200 + i, base[0], 0) for i in range(30)] + [(230, base[0], 0)] * 2
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 24, 0), (303, [float("nan")] * 24, 0),
             (304, [1.0, None] + [0.0] * 22, 0), (305, [1.0, 2.0], 0), (None, base[1], 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding "
                                  "array<double>, label int, node string, n string").repartition(3)
    for chunk in (512, 8):
        got = sorted([tuple(r) for r in near_vectors(table, chunk=chunk).collect()], key=key)
        good = [r[1] and all(x is not None and x == x for x in r[1]) and any(r[1])
                and r[2] is not None for r in rows]

        def cosine(a, b):
            dot = sum(x * y for x, y in zip(a, b))
            return dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

        n, root = [0] * len(rows), list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if good[i] and good[j] and rows[i][2] == rows[j][2] \
                        and len(rows[i][1]) == len(rows[j][1]) \
                        and (rows[i][1] == rows[j][1] or cosine(rows[i][1], rows[j][1]) >= 0.98):
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                least[find(i)] = min(r[0], least.get(find(i), r[0]))
        want = [(r[0], n[i], least.get(find(i))) for i, r in enumerate(rows)]
        assert got == sorted(want, key=key)
    assert near_vectors(table.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    page = lambda s: f"<p>{s}</p>" * 200
    rows = [(1, "http://a/\r\nx", page("a")), (2, "u", page("a")), (3, None, page("b")),
            (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (2, "u", page("a")),
            (None, "u", page("a")), (9, "u", "é\n\r\n\r\nWARC/1.1 " * 100)]
    pages = spark.createDataFrame([(*r, "z") for r in rows],
                                  "page_id long, url string, html string, payload string")
    manifest = write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = read_archives(manifest).collect()
    html = dict((r[0], r[2]) for r in rows)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in back], key=key)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == page("a") and i != 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(),
                     "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=key)
    for r in back:
        if r.record_type == "response":
            assert bytes(r.payload) == (html[r.page_id] or "").encode()
    assert read_archives(write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_personal_data(docs, rows, empty):
    found = {r.id: r for r in find_personal(docs).collect()}
    row = next(r for r in rows if r[1] and r[1].startswith("mail"))
    kinds = {s.kind: row[1][s.start:s.end] for s in found[row[0]].base}
    assert kinds == {"email": "a.b@c.de", "phone": "+1 (234) 555-0100", "ip": "10.0.0.1",
                     "card": "4539 5787 6362 1486"}
    assert find_personal(empty).count() == 0 and found[None] is not None


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    calm = [f"w{i}" .replace("w", rng.choice(["ba", "mo", "ti"])) for i in range(300)]
    rude = ["grumbo", "snarfle", "blurtix"]
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(c for c in rng.choice(calm) if c.isalpha()) + rng.choice("abcdefgh")
                 for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                words[rng.randrange(40)] = rng.choice(rude) + rng.choice(["", "en", "os"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "grumbo", "x")]
    labels += [(5000, None), (None, 1), (7, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(table, marks).collect()}
    assert len(got) == len(rows) and 0 <= got[5001].score < 0.3 and got[5000].predicted == 0
    held = [i for i in range(1500) if got[i].held_out]
    assert 250 < len(held) < 500
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.98 * len(held)
    # labels of held-out rows change nothing
    turned = marks.withColumn("toxic", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
        1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(table, turned).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert toxicity(table.limit(0), marks).count() == 0
    assert toxicity(table, marks.limit(0)).filter("score = 0").count() == len(rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name]) is None
