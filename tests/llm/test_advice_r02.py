"""Whole results where earlier code cut them."""

import base64
import bz2
import gzip
import lzma
import math
import random
import zlib

import pytest
import zstandard

from foldstone.llm import ngram_quality
from foldstone.llm import secret_scan as secrets

from . import brute


def test_perplexities_do_not_depend_on_the_size_of_the_shipped_file(spark):
    rng = random.Random(17)
    letters = "abcdefghijklmnoprstuvwxyzäöß"  # q gets three letters before it: no count is absent
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
                         for _ in range(60)) + " aqa bqb cqc", ["en", None][i % 2]) for i in range(40)]
    rows += [(40, "nul\0word " * 3 + "plain 日本 " * 30, "en"), (41, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    models = {lang: brute.KneserNey([t for _, t, own in rows if (own or "") == lang])
              for lang in ("en", "")}
    for most in (0, 500, ngram_quality.MAX_NGRAMS):
        got = {r.doc_id: r for r in ngram_quality.assess(docs, max_ngrams=most).collect()}
        assert len(got) == len(rows)
        for i, t, lang in rows:
            want = models[lang or ""].perplexity(t)
            assert got[i].perplexity == (pytest.approx(want, rel=1e-6) if want else None)


@pytest.mark.parametrize("hidden", [
    "token\\u003d" + "aB3" * 400,
    "secret&quot;:&quot;" + "eyJh.bG_c" * 200,
    "password%3A hunter22x",
    'api%5Fkey = "abcdef123',
    "password%20%3A%20&quot;" + "q7" * 300,
    "&#116;oken" + " " * 700 + "= abcdef123",
])
def test_escaped_secrets_are_found_to_their_ends(hidden):
    text = f"é, see ({hidden}), and 100% of a &amp; b"
    base, inner = secrets.scan(text)
    at = text.index(hidden)
    assert base == [] and (at, at + len(hidden), "assign") in inner


NOISE = random.Random(4).randbytes(300).hex().encode() + b"\n"
HIDDEN = b"password=abcdef123456"


@pytest.mark.parametrize("text", [
    base64.encodebytes(gzip.compress(NOISE + HIDDEN)).decode(),
    base64.encodebytes(b"x" * 50 + b" " + HIDDEN + b" " + b"y" * 99).decode().replace("\n", "\r\n  "),
    base64.encodebytes(gzip.compress(NOISE + HIDDEN)).decode().replace("\n", "\\n"),
    gzip.compress(HIDDEN).hex("\n", 8),
    "path/" + base64.b64encode(gzip.compress(HIDDEN)).decode(),
    "id_" + base64.urlsafe_b64encode(HIDDEN).decode(),
    "ab" + base64.b64encode(HIDDEN).decode(),
    base64.b64encode(b"\x0c\x00\x1b\x7f\xff" + HIDDEN).decode(),
    base64.b64encode("päss ".encode() + HIDDEN.decode().encode("utf-16-le")).decode(),
    *(base64.b64encode(pack(b"nothing") + pack(HIDDEN)).decode() for pack in (
        gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress)),
])
def test_encoded_data_is_read_in_every_way(text):
    base, inner = secrets.scan(f"é: {text}, end")
    assert [s for s in inner if s[2] == "assign"] and not [s for s in base if s[2] == "assign"]


def test_packed_chains_have_no_fixed_depth():
    data = HIDDEN
    for _ in range(80):
        data = zlib.compress(data)
    text = base64.b64encode(data).decode()
    assert (0, len(text), "assign") in secrets.scan(text)[1]


def test_bands_follow_one_rule_at_every_size(spark):
    sizes = {"one": 1, "under": 28, "over": 30, "large": 400}
    rows = [(lang, 2.0 * 2 ** k * (1 + 0.002 * (i % 20))) for k, (lang, n) in enumerate(sizes.items())
            for i in range(n)]
    scored = spark.createDataFrame([(*r, 90, 0) for r in [*rows, ("under", 30.0)]],
                                   "lang string, perplexity double, n_words long, n_repeat_words long")
    limits = {r.lang: (r.low, r.high) for r in ngram_quality.bands(scored).collect()}
    inside = lambda lang, x: limits[lang][0] <= math.log(x) <= limits[lang][1]
    assert all(inside(*r) for r in rows) and not inside("under", 30.0)
