"""Checks that would have failed before the findings of round 3 were mended."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldstone.llm import host_boilerplate, jaccard_join, ngram_quality, suffix_dedup

from . import brute


def test_common_shingles_are_counted_without_a_row_each(spark, monkeypatch):
    texts = [f"a shared opening of some words then {i} and {i * 7} differ" for i in range(120)]
    texts += ["", " \n", None, "few words", *["the same text in many rows over and over"] * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.coalesce("text", F.lit("")).alias("text")).repartition(5)
    made = []
    whole = jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df: made.append(
        df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    got = jaccard_join.common_shingles(rows)
    bound = int(jaccard_join.COUNTED * 2.0**64)
    counts = Counter(int(h) for s in jaccard_join.shingle_sets(pa.array(texts)) for h in s)
    want = sorted(h for h, n in counts.items() if h < bound and n > jaccard_join.LONG_LIST)
    assert want and got.tolist() == want and got.dtype == np.uint64
    assert "HashAggregate" not in made[0]


def test_equal_runs_of_a_batch_are_handed_on_once(spark, monkeypatch):
    """A line over and over in many texts, copies, and texts that share a part of either."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, copied = noise(23), noise(150)
    texts = [noise(rng.randrange(30)) + line * 60 + noise(20) for _ in range(40)] + [copied] * 60
    texts += [copied[:70] + noise(30), noise(9) + line * 2, "", None, "x" * 300, noise(45), "é" * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((i, *k) for (i, _), k in zip(rows, brute.kept_bytes([t for _, t in rows], 40)))
    sizes = []
    whole = suffix_dedup.met_again
    monkeypatch.setattr(suffix_dedup, "met_again",
                        lambda found, *a: sizes.append(found.count()) or whole(found, *a))
    for split in (4, 4096):
        sizes.clear()
        found = suffix_dedup.remove(suffix_dedup.repeats(table, length=40, gram=8, split=split))
        assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                      for r in found.collect()) == want
        assert sizes[0] < 1000  # each of the 60 lines of 40 texts and each copy was a run before


def test_quality_stage_stores_each_text_once(spark, monkeypatch):
    stored = []
    whole = ngram_quality.staged
    monkeypatch.setattr(ngram_quality, "staged", lambda df: stored.append(df.schema) or whole(df))
    docs = spark.createDataFrame(
        [(i, f"{'words of a plain text ' * 3}{i} " * 6, "en", "s", 9) for i in range(5)] + [
            (9, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    with_texts = [[f.name for f in s if f.name in ("row", "text")] for s in stored]
    assert [x for x in with_texts if x] == [["row"]]


@pytest.mark.parametrize("block_tokens, shared", [(1 << 20, 1 << 20), (60, 0)])
def test_runs_of_the_host_are_dropped_from_articles(spark, monkeypatch, block_tokens, shared):
    """A notice that others have in a footer goes; what only articles share, or few have, stays."""
    monkeypatch.setattr(host_boilerplate, "SHARED_RUNS", shared)
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice, quote, lead, half = words(15), words(30), words(20), words(12)
    own = [f"{words(25)} & more" for _ in range(5)]
    page = lambda blocks, end: ("<article>" + "".join(f"<p>{b.replace('&', '&amp;')}</p>" for b in blocks)
                                + f"</article><footer><p>{end}</footer>")
    articles = [[own[0], notice, quote], [own[1], quote, notice], [notice, own[2], quote],
                [lead, own[3]], [own[4], f"{half} {words(13)}"]]
    rows = [(i, f"http://a.org/{i}", page(b, lead)) for i, b in enumerate(articles)]
    rows += [(10 + i, f"http://a.org/f{i}", f"<p>{words(20)}<footer>{notice} {half}") for i in range(3)]
    rows += [(20 + i, f"http://b.org/{i}", page(articles[i], lead)) for i in range(3)]  # no footer has it there
    rows += [(30 + i, f"http://c.org/{i}", page([own[0], notice], notice + f" {i}")) for i in range(4)]
    rows += [(40 + i, f"http://d.org/{i}", page([notice], words(14))) for i in range(2)]
    rows += [(70 + i, f"http://e.org/{i}", page([words(20), notice if i < 4 else lead], notice))
             for i in range(9)]
    rows += [(50, "http://a.org/n", page([notice], "x")), (0, "http://a.org/0", rows[0][2]), (60, None, None)]
    found = host_boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"),
                                       block_tokens=block_tokens).collect()
    assert len(found) == len(rows)
    texts = {r.id: r.text for r in found}
    assert texts[0] == f"{own[0]}\n{quote}" and texts[1] == f"{own[1]}\n{quote}"
    assert texts[2] == f"{own[2]}\n{quote}"
    assert texts[3] == f"{lead}\n{own[3]}" and texts[4] == "\n".join(articles[4])
    assert [texts[20 + i] for i in range(3)] == ["\n".join(b) for b in articles[:3]]
    assert all(texts[30 + i] == f"{own[0]}\n{notice}" for i in range(4))  # one article, shown four times
    assert all(texts[70 + i].endswith(notice) for i in range(4))  # in 4 of 9 articles
    assert texts[50] == notice and texts[60] == ""  # all of an article is never dropped


def test_a_bitmap_of_runs_holds_them_all(spark):
    runs = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 7).alias("host"),
                                    F.xxhash64("id").alias("w1"), F.col("id").alias("w2"))
    told, bits = host_boilerplate._bitmap(runs)
    told = np.unpackbits(np.frombuffer(told, np.uint8), bitorder="little")
    places = [r[0] & (bits - 1) for r in runs.select(F.col("w1").bitwiseXOR(F.xxhash64("host"))).collect()]
    assert len(told) == bits and set(np.flatnonzero(told)) == set(places)
    assert host_boilerplate._bitmap(runs.limit(0))[0] == b""
