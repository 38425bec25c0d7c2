"""Quality rules: counts of a text's words and lines, then bands of n-gram perplexity.

The model is an interpolated modified Kneser-Ney model of the characters of words (with marks for
a word's begin and end), one for each language.  Tasks count the n-grams of highest order of all
texts; Spark adds them up and derives lower orders, discounts, probabilities and back-off weights
with joins and groupings.  The whole model stays a table in the shared folder.  Its most frequent
n-grams of highest order are also sorted arrays of 64-bit hashes, memory-mapped on the executors and
searched by bisection; n-grams of documents that are not among them are joined to the table, so the
size of the arrays changes no result.  A document is rejected when its perplexity leaves the band of
its language, which is set around the median of all documents that pass the plain rules.

Nulls: a null text has no words and fails the plain rules, a null language is a language of its own.
Columns of the input with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .bpe_lexicon import mapped, save
from .common import batches, bounded_batches, mix, releasing, staged, WORD

ORDER = 5
START, END = "\x02", "\x03"
#: N-grams shipped to executors; those of least count beyond it are joined to the model's table.
MAX_NGRAMS = 2_000_000
#: Columns between scoring and joining: row, sum of known logarithms, letters, n-grams still open.
_ROW, _LOG, _LETTERS, _OPEN = (f"_llm_{c}" for c in ("row", "log", "letters", "open"))
#: A band reaches so many scaled median deviations below and above the median of the logarithm.
BELOW, ABOVE = 6.0, 6.0
#: The deviation of all languages together counts as much in a language's own as so many documents.
LEAST_DOCS = 30
BIN = 0.001
#: Words taken at a time, and words whose scores a worker remembers.
SLICE, CACHE_WORDS = 20_000, 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WORDS = re.compile(WORD).findall
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    n = len(words)
    seen, dup = set(), 0
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in seen:
                dup += bool(_WORDS(line))
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded words one after another, and the places of predicted ones."""
    text = "".join([START * (order - 1) + w + END for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + order
    ends = np.cumsum(sizes)
    own = np.ones(len(codes), bool)
    for k in range(order - 1):
        own[ends - sizes + k] = False
    return codes, np.flatnonzero(own)


def _gram_hashes(codes: np.ndarray, at: np.ndarray, order: int, lang: str) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 .. order that end at the given places."""
    salt = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]
    letters = mix(codes.astype(np.uint64) + np.uint64(1))
    up = np.uint64(0x9E3779B97F4A7C15)
    out, total, factor = [], np.full(len(at), salt, np.uint64), np.uint64(1)
    for k in range(order):
        with np.errstate(over="ignore"):
            factor = factor * up
        total = total + letters[at - k] * factor
        out.append(mix(total + np.uint64(k)))
    return out


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                order: int = ORDER, flush: int = 250_000) -> DataFrame:
    """(lang, gram, n): n-grams of the highest order in all words of all texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in ((lang, dict(some)) for lang, all_ in seen.items()
                                for some in batched(all_.items(), SLICE)):
                codes, at = _codes(list(words), order)
                times = np.repeat(np.fromiter(words.values(), np.int64, len(words)),
                                  np.fromiter(map(len, words), np.int64, len(words)) + 1)
                keys = _gram_hashes(codes, at, order, lang)[-1]
                _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                n = np.bincount(inverse, times).astype(np.int64)
                letters = codes[at[first][:, None] + np.arange(1 - order, 1)]
                grams = np.ascontiguousarray(letters).view(f"<U{order}").ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(grams.tolist(), pa.string()),
                     pa.array(n)], ["lang", "gram", "n"])
            seen.clear()

        for batch in parts:
            for text, lang in zip(batch.column(0), batch.column(1)):
                seen[lang.as_py() or ""].update(_WORDS((text.as_py() or "").replace("\0", " ")))
                if sum(map(len, seen.values())) > flush:
                    yield from out()
        yield from out()

    return (docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .mapInArrow(releasing(count), "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, n, logp, logb): n-grams of all orders with probability and back-off.

    ``logb`` is the weight given to shorter n-grams after ``gram`` as a context (0 if it is none).
    Below the highest order ``n`` counts the different letters before an n-gram, except
    that n-grams at a word's begin, which nothing can precede, keep their occurrences.
    """
    levels = {order: staged(grams)}
    for k in range(order - 1, 0, -1):
        cut = levels[k + 1].withColumn("gram", F.substring("gram", 2, k))
        pads = F.col("gram") == START * k  # never predicted
        levels[k] = cut.groupBy("lang", "gram").agg(F.sum("n").alias("s"), F.count("*").alias("c")) \
            .select("lang", "gram", F.when(F.substring("gram", 1, 1) == START, F.col("s"))
                    .otherwise(F.col("c")).alias("n")).filter(~pads)
    done, lower = None, None
    for k in range(1, order + 1):
        level = staged(levels[k]) if k < order else levels[k]
        tally = [F.count_if(F.col("n") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        of = level.groupBy("lang").agg(*tally)
        y = F.when(F.col("t1") + 2 * F.col("t2") > 0,
                   F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.0)

        def cut_of(i: int, y: Column = y) -> Column:
            """Discount of n-grams seen i times (3: or oftener), between 0 and i."""
            value = i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")
            return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.when(
                F.col(f"t{i}") > 0, value))), F.lit(0.5)).alias(f"d{i}")

        of = of.select("lang", *[cut_of(i) for i in (1, 2, 3)])
        # one row per language: broadcast by Spark when its measured size allows
        parts = level.withColumn("ctx", F.substring("gram", 1, k - 1)).join(of, "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(
            F.col("d3"))
        ctx = parts.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum(d).alias("mass"),
                                               F.count("*").alias("kinds"))
        both = parts.join(ctx, ["lang", "ctx"]).select(
            "lang", "gram", "n", ((F.col("n") - d) / F.col("total")).alias("alpha"),
            (F.col("mass") / F.col("total")).alias("gamma"), "kinds",
            F.substring("gram", 2, k - 1).alias("short"))
        if lower is None:  # below single letters: all letters alike, one place kept for unseen ones
            p = both.withColumn("p", F.col("alpha") + F.col("gamma") / (F.col("kinds") + 1))
        else:
            p = both.join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q")),
                          ["lang", "short"]).withColumn("p", F.col("alpha") + F.col("gamma") * F.col("q"))
        level_p = staged(p.select("lang", "gram", "n", "p"))
        weights = ctx.select("lang", F.col("ctx").alias("gram"), F.lit(k - 1).alias("k"),
                             F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("logp"),
                             F.log(F.col("mass") / F.col("total")).alias("logb"),
                             F.log(F.col("mass") / F.col("total") / (F.col("kinds") + 1)).alias("rest"))
        rows = level_p.select("lang", "gram", F.lit(k).alias("k"), "n", F.log("p").alias("logp"),
                              F.lit(None).cast("double").alias("logb"),
                              F.lit(None).cast("double").alias("rest")).unionByName(weights)
        done = rows if done is None else done.unionByName(rows)
        lower = level_p
    return done.groupBy("lang", "k", "gram").agg(
        F.max("n").alias("n"), F.max("logp").alias("logp"), F.max("logb").alias("logb"),
        F.max("rest").alias("rest"))


def store(model: DataFrame, order: int = ORDER, max_ngrams: int = MAX_NGRAMS) -> str:
    """Write sorted hash arrays of the most frequent n-grams to a file of the session; its name there."""
    spark = model.sparkSession
    top = model.filter(F.col("k") == order)
    size = F.floor(F.log2(F.col("n") + 1.0) * 16).cast("int")
    least, room = 0, max_ngrams
    for r in top.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        room -= r["count"]
        if room < 0:
            least = r["size"] + 1
            break

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys = np.zeros(batch.num_rows, np.uint64)
            groups = defaultdict(list)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                groups[lang].append(i)
            grams = batch.column(1).to_pylist()
            for lang, own in groups.items():
                text = "".join([grams[i] for i in own])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                keys[own] = _gram_hashes(codes, np.arange(order - 1, len(codes), order), order, lang)[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column(2)], ["key", "logp"])

    table = top.filter(size >= least).select("lang", "gram", F.col("logp").cast("float")).mapInArrow(
        releasing(hashes), "key long, logp float").toArrow()  # at most max_ngrams rows
    keys = table.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    name = f"ngrams-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="ngrams-"), name)
    save(path, {"keys": keys[by].view(np.int64),
                "logp": table.column("logp").to_numpy()[by].view(np.int32)})
    spark.sparkContext.addFile(path)
    return name


class Model:
    """Scores of words under the n-grams of a stored file; the others are left open."""

    def __init__(self, path: str, order: int = ORDER):
        _, views, _ = mapped(path)
        self.keys = np.frombuffer(views["keys"], np.uint64)
        self.logp = np.frombuffer(views["logp"], np.float32)
        self.order = order
        self.caches: dict[str, dict[str, float]] = defaultdict(dict)
        self.open: dict[str, dict[str, list[str]]] = defaultdict(dict)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """log p of n-grams of the highest order; NaN if the file does not hold them."""
        if len(self.keys) == 0:
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.logp[at].astype(np.float64), np.nan)

    def learn(self, words: list[str], lang: str) -> None:
        """Put the scores of words into the language's cache, and their n-grams left open."""
        codes, at = _codes(words, self.order)
        keys = _gram_hashes(codes, at, self.order, lang)[-1]
        unique, inverse = np.unique(keys, return_inverse=True)
        logs = self.find(unique)[inverse]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        absent = np.flatnonzero(np.isnan(logs))
        whose = np.searchsorted(starts, absent, "right") - 1
        for a, j in zip(at[absent].tolist(), whose.tolist()):
            gram = "".join(map(chr, codes[a - self.order + 1:a + 1].tolist()))
            self.open[lang].setdefault(words[j], []).append(gram)
        logs[absent] = 0.0
        self.caches[lang].update(zip(words, np.add.reduceat(logs, starts).tolist()))

    def sums(self, docs: list[list[str]], langs: list[str]) -> list[tuple[float, int, Counter]]:
        """Of each document: known logarithms added up, letters, and its n-grams left open."""
        if sum(map(len, self.caches.values())) > CACHE_WORDS:
            self.caches.clear()
            self.open.clear()
        for lang in set(langs):
            cache = self.caches[lang]
            fresh = set(chain.from_iterable(d for d, own in zip(docs, langs) if own == lang))
            fresh.difference_update(cache)
            for some in batched(fresh, SLICE):
                self.learn(list(some), lang)
        out = []
        for d, lang in zip(docs, langs):
            left, open_ = Counter(), self.open[lang]
            if open_:
                for w in d:
                    if w in open_:
                        left.update(open_[w])
            out.append((math.fsum(map(self.caches[lang].__getitem__, d)), sum(map(len, d)) + len(d),
                        left))
        return out


def score(docs: DataFrame, stored: str, model: DataFrame, text_col: str = "text",
          lang_col: str = "lang", order: int = ORDER, keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts and ``perplexity`` (null without words)."""
    names = (*COUNTS, "perplexity")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = StructType(kept + [StructField(c, LongType()) for c in COUNTS]
                        + [StructField(_LOG, DoubleType()), StructField(_LETTERS, LongType()),
                           StructField(_OPEN, ArrayType(StructType.fromDDL("gram string, n long")))])
    kind = pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(SparkFiles.get(stored), order)
        for batch in batches(parts, 1 << 20, text_col):
            place = batch.schema.get_field_index
            texts = [t or "" for t in batch.column(place(text_col)).to_pylist()]
            words = [_WORDS(t) for t in texts]
            langs = [str(x) if x is not None else "" for x in batch.column(place(lang_col)).to_pylist()]
            counts = np.array([base_counts(t, w) for t, w in zip(texts, words)], np.int64)
            logs, letters, left = zip(*scorer.sums(words, langs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(place(f.name)) for f in kept]
                + [pa.array(np.ascontiguousarray(c)) for c in counts.T]
                + [pa.array(logs, pa.float64()), pa.array(letters, pa.int64()),
                   pa.array([[{"gram": g, "n": n} for g, n in x.items()] for x in left], kind)],
                [*[f.name for f in kept], *COUNTS, _LOG, _LETTERS, _OPEN])

    scored = staged(docs.mapInArrow(releasing(run), schema).withColumn(_ROW, F.monotonically_increasing_id()))
    log = F.col(_LOG)
    if scored.filter(F.size(_OPEN) > 0).limit(1).count():
        lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang")
        left = scored.select(_ROW, lang, F.inline(_OPEN))
        more = staged(left.join(open_grams(left, model, order), ["lang", "gram"]).groupBy(_ROW)
                      .agg(F.sum(F.col("n") * F.col("logp")).alias("_llm_more")))
        scored = scored.join(more, _ROW, "left")
        log = log + F.coalesce(F.col("_llm_more"), F.lit(0.0))
    ppl = F.when(F.col(_LETTERS) > 0, F.exp(F.least(F.lit(700.0), -log / F.col(_LETTERS))))
    return scored.select(*[F.col(f"`{f.name}`") for f in kept], *COUNTS, ppl.alias("perplexity"))


def open_grams(left: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) of the n-grams of highest order in ``left``, from the model's whole table.

    N-grams that were never counted get those of shorter ones and the weights of their contexts.
    """
    top = model.filter(F.col("k") == order).select("lang", "gram", F.col("logp").cast("float"))
    found = staged(left.select("lang", "gram").distinct().join(top, ["lang", "gram"], "left"))
    end = lambda k, back: F.substring("gram", order - k + 1 - back, k)
    parts = [F.struct(F.lit(k).alias("k"), F.lit(back).alias("back"), end(k, back).alias("part"))
             for k in range(1, order) for back in (0, 1)]
    parts.append(F.struct(F.lit(0).alias("k"), F.lit(0).alias("back"), F.lit("").alias("part")))
    rows = model.select("lang", "k", F.col("gram").alias("part"), "logp", "logb", "rest")
    value = lambda c, k, back: F.max(F.when(
        (F.col("k") == k) & (F.col("back") == back), F.col(c)))
    shorter = (found.filter("logp is null").select("lang", "gram", F.inline(F.array(*parts)))
               .join(rows, ["lang", "k", "part"], "left").groupBy("lang", "gram")
               .agg(*[value("logp", k, 0).alias(f"p{k}") for k in range(1, order)],
                    *[value("logb", k, 1).alias(f"b{k}") for k in range(1, order)],
                    value("rest", 0, 0).alias("rest")))
    weight, ways = F.lit(0.0), []
    for k in range(order - 1, 0, -1):
        weight = weight + F.coalesce(F.col(f"b{k}"), F.lit(0.0))
        ways.append(weight + F.col(f"p{k}"))
    ways.append(weight + F.coalesce(F.col("rest"), F.lit(math.log(1e-6))))
    return found.filter("logp is not null").select("lang", "gram", F.col("logp").cast("double")).union(
        shorter.select("lang", "gram", F.coalesce(*ways).alias("logp")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored: DataFrame, lang_col: str = "lang", below: float = BELOW,
          above: float = ABOVE) -> DataFrame:
    """(lang, low, high) of log perplexity: median -+ deviations, from a histogram of all documents.

    Each language has its own median; its deviation is shrunk towards that of all languages, each
    around its own median, the less the more documents it has.
    """
    spark = scored.sparkSession
    cell = F.round(F.log("perplexity") / BIN).cast("long")
    hist = (scored.filter(~base_failed()).groupBy(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), cell.alias("cell"))
        .count().collect())  # cells of a thousandth of a logarithm, for each language
    by: dict[str, Counter] = defaultdict(Counter)
    for r in hist:
        by[r.lang][r.cell] += r["count"]

    def middle(cells: Counter) -> float:
        half, run = sum(cells.values()) / 2, 0
        for c in sorted(cells):
            run += cells[c]
            if run >= half:
                return c
        return 0

    centres = {lang: middle(cells) for lang, cells in by.items()}
    gaps: dict[str, Counter] = defaultdict(Counter)
    for lang, cells in by.items():
        for c, n in cells.items():
            gaps[lang][abs(c - centres[lang])] += n
    pooled = middle(sum(gaps.values(), Counter()))

    def band(lang: str) -> tuple[str, float, float]:
        n, m = sum(by[lang].values()), centres[lang]
        deviation = (n * middle(gaps[lang]) + LEAST_DOCS * pooled) / (n + LEAST_DOCS)
        spread = max(1.4826 * deviation, 20.0)
        return lang, (m - below * spread) * BIN, (m + above * spread) * BIN

    rows = [band(lang) for lang in by]
    return spark.createDataFrame(rows, "lang string, low double, high double")


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
           keep_text: bool = True, below: float = BELOW, above: float = ABOVE,
           max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """``docs`` with counts, ``perplexity``, ``base_failed`` and ``kept``."""
    given, docs = docs, docs.select(*[
        F.col(f"`{c}`") for c in docs.columns if c not in ("base_failed", "kept")])
    with bounded_batches(docs.sparkSession):
        model = staged(kneser_ney(count_grams(given, text_col, lang_col, order), order))
        stored = store(model, order, max_ngrams)
        scored = score(docs, stored, model, text_col, lang_col, order, keep_text)
    limits = bands(scored, lang_col, below, above).select(
        F.col("lang").alias("_lang"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    inside = F.log("perplexity").between(F.col("_low"), F.col("_high"))
    return (scored.join(limits, F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
                        == F.col("_lang"), "left")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
            .drop("_lang", "_low", "_high"))


RESULT = (*COUNTS, "base_failed", "kept")
