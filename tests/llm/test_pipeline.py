"""run() of the corpus pipeline against its plain version."""

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from foldstone.llm.ngram_quality import ABOVE, BELOW, BIN, LEAST_DOCS
from foldstone.llm.queries_mix import ALPHA, SEED
from foldstone.llm.secret_scan import scan

from . import brute


def fixture_rows():
    rng = random.Random(21)
    syllables = "ba de fi go lu ma ne pi ro su ta ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 120))) for _ in range(70)]
    for t in texts[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3]]
    texts += [" ".join(word() for _ in range(90)) + f" {s} end" for s in (
        "password=abcdef99", "cGFzc3dvcmQ9YWJjZGVmMTIzNDU2", "token: abcdefgh") * 2]
    texts += ["".join(rng.choice("QXZJ#%") for _ in range(4)) + " " + " ".join(
        "".join(rng.choice("QXZJKW#%") for _ in range(5)) for _ in range(90))]
    texts += ["too short", "", None, "one two three " * 40]
    return [(i, t, "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 5}", None if t is None
             else len(t)) for i, t in enumerate(texts)]


def plain(rows):
    # 1: rules and bands
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r[1])
    models = {lang: brute.KneserNey(t) for lang, t in by.items()}
    good, cells = [], defaultdict(list)
    for r in rows:
        n, *_, repeat = brute.base_counts(r[1])
        if n >= 50 and 100 * repeat <= 50 * n:
            log = math.log(models[r[2]].perplexity(r[1]))
            good.append((r, log))
            cells[r[2]].append(round(log / BIN))
    every = [c for own in cells.values() for c in own]
    limits = {}
    for lang, own in cells.items():
        own = own if len(own) >= LEAST_DOCS else every
        m = statistics.median_low(own)
        spread = max(1.4826 * statistics.median_low([abs(c - m) for c in own]), 20.0)
        limits[lang] = ((m - BELOW * spread) * BIN, (m + ABOVE * spread) * BIN)
    rows = [r for r, log in good if limits[r[2]][0] <= log <= limits[r[2]][1]]
    # 2: the first of each class
    first, _ = brute.classes([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    # 3: secrets
    clean = []
    for r in rows:
        out, at = "", 0
        for a, b in sorted((a, b) for part in scan(r[1]) for a, b, _ in part):
            if a >= at:
                out += r[1][at:a] + "[secret]"
            at = max(at, b)
        clean.append((r[0], out + r[1][at:], *r[2:]))
    # 4: copies
    rate = brute.rates([r[3] for r in clean], ALPHA)
    return [r for r in clean for _ in range(brute.copies(r[0], r[1], rate[r[3]], SEED))]


def test_run_like_the_plain_version(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = fixture_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.source, r.lang, r.n_tokens, tuple(r.ids))
                  for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    kept = plain(rows)
    for i, text, lang, source, _ in kept:
        ids = library.encode(text, add_special_tokens=False).ids
        want[i, source, lang, len(ids), tuple(ids)] += 1
    assert got == want and sum(got.values()) > 30
    texts = {i: t for i, t, *_ in kept}
    assert any("[secret]" in t for t in texts.values())


def test_stages_keep_columns_and_stand_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "a"), (1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b")],
        "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").filter("n_tokens = 0").count() == 3
