"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings that labelled training rows tie to the label, from a bounded
   sample of labels (``SAMPLE_ROWS``); labels of held-out rows are never read.
2. Voters: the lexicon dealt out to several voters, and voters on patterns (how many entries, how
   dense, none at all, shouting).  Every document is voted on.
3. Label model: votes of all documents are counted by pattern (a bounded number of patterns).  EM
   estimates each voter's behaviour in either class without labels; voters whose votes correlate
   beyond what the class explains share their weight.
4. A logistic regression on lexicon hits learns the posterior labels of a bounded sample of rows
   outside the held-out part, and scores every document.

Null and empty texts have no hits and get the score of the intercept alone.  A null id counts as an
empty text in the split.  Several labels of one id: toxic if any says so; null labels are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import batches, staged

SAMPLE_ROWS = 20_000  # labels read to build the lexicon
FIT_ROWS = 30_000  # posterior labels that the classifier is fitted on
LEXICON = 600  # entries at most
LEAST_SHARE = 0.7  # of the rows with an entry that are toxic
LEAST_GAIN = 15.0  # evidence of an entry in nats, above the logarithm of the number of candidates
LEXICON_VOTERS = 6
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
MANY = 5  # hits counted one by one as features

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def terms(text: str) -> tuple[set[str], int, int]:
    """Distinct words and word beginnings, words, and shouted words.

    A beginning has a star for each different word that has it, up to three.
    """
    words = _LETTERS.findall(text)
    distinct = set(words)
    low = {w.lower() for w in distinct}
    out = set(low)
    for n in BEGINNINGS:
        for begin, times in Counter([w[:n] for w in low if len(w) >= n]).items():
            out.update((begin + "*", begin + "**", begin + "***")[:times])
    return out, len(words), sum(1 for w in distinct if len(w) > 3 and w.isupper())


def lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
            size: int = LEXICON) -> list[str]:
    """Entries most tied to the label among rows outside the held-out part."""
    marks = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
             .select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            both = [pa.array([c[k] for k in names], pa.int64()) for c in seen]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *both],
                                              ["term", "clean", "toxic"])

        for batch in parts:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text or "")[0]
                found.add("")  # counts the rows
                seen[int(toxic > 0)].update(found)
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out()
        yield out()

    # at most sample_rows ids: small enough for every task
    counts = (docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("l_id"))
              .select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long")
              .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counts = staged(counts)
    total = counts.filter("term = ''").agg(F.sum("clean").alias("clean"),
                                           F.sum("toxic").alias("toxic")).first()
    if not total or not total.toxic:
        return []
    base = (total.toxic + 1) / (total.clean + total.toxic + 2)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(share / base)
    chosen = (counts.filter((F.col("term") != "") & (gain >= LEAST_GAIN)
                            & (share >= max(LEAST_SHARE, 3 * base)))
              .orderBy(gain.desc(), "term").limit(size).collect())
    return [r.term for r in chosen]


def votes_of(hits: list[int], words: int, shouted: int) -> list[int]:
    """1: toxic, -1: clean, 0: no opinion; lexicon voters first."""
    out = [0] * LEXICON_VOTERS
    for h in hits:
        out[h % LEXICON_VOTERS] = 1
    n = len(hits)
    out.append(1 if n >= 4 else -1 if n <= 1 else 0)
    out.append(1 if n * 150 >= words > 0 and n else 0)
    out.append(-1 if n == 0 else 0)
    out.append(-1 if n == 0 and words >= 20 else 0)
    out.append(1 if shouted * 3 >= words > 0 and n else 0)
    return out


def vote(docs: DataFrame, entries: list[str]) -> DataFrame:
    """doc_id, held_out, hits (array<int>) and votes (array<int>) of every row."""
    place = {t: i for i, t in enumerate(entries)}  # at most LEXICON entries
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = ArrayType(IntegerType())
    schema = StructType([*(f for f in rows.schema.fields if f.name != "text"),
                         StructField("hits", kind), StructField("votes", kind)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in batches(parts, 4 << 20):
            hits, votes = [], []
            for text in batch.column("text").to_pylist():
                found, n, loud = terms(text or "")
                own = sorted(place[t] for t in found & known)
                hits.append(own)
                votes.append(votes_of(own, n, loud))
            small = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(hits, small),
                 pa.array(votes, small)], ["doc_id", "held_out", "hits", "votes"])

    return rows.mapInArrow(run, schema)


class LabelModel:
    """Two classes and voters with three answers, fitted by EM to counted patterns of votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        self.v, self.n = patterns + 1, counts.astype(np.float64)
        m, k = self.v.shape
        for_, against = (patterns > 0).sum(1), (patterns < 0).sum(1)
        q = np.clip((for_ + 0.2) / (for_ + against + 1.0), 0.02, 0.98)
        self.weights = np.ones(k)
        for step in range(rounds):
            self._maximise(q)
            if step % 10 == 9:
                self.weights = self._shares(q)
            q = self.posterior()
        self.correlations = self._correlations(q)
        self.accuracies = self._accuracies()

    def _maximise(self, q: np.ndarray) -> None:
        w = np.stack([self.n * (1 - q), self.n * q])
        self.prior = np.clip(w.sum(1) / w.sum(), 1e-3, 1 - 1e-3)
        self.theta = np.empty((2, self.v.shape[1], 3))
        for a in range(3):
            self.theta[:, :, a] = w @ (self.v == a) + 0.5
        self.theta /= self.theta.sum(2, keepdims=True)

    def posterior(self) -> np.ndarray:
        """P(toxic) of each pattern."""
        logs = np.log(self.prior)[:, None] + sum(
            self.weights[j] * np.log(self.theta[:, j, self.v[:, j]]) for j in range(self.v.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def _correlations(self, q: np.ndarray) -> np.ndarray:
        """Correlation of voters that the class leaves unexplained, the mean over the classes."""
        x = self.v - 1.0
        out = np.zeros((x.shape[1],) * 2)
        for share, w in ((self.prior[0], self.n * (1 - q)), (self.prior[1], self.n * q)):
            mean = w @ x / max(w.sum(), 1e-9)
            centred = x - mean
            cov = (centred * w[:, None]).T @ centred / max(w.sum(), 1e-9)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            out += share * cov / dev[:, None] / dev[None, :]
        return out

    def _shares(self, q: np.ndarray) -> np.ndarray:
        rho = np.abs(self._correlations(q))
        np.fill_diagonal(rho, 0)
        return 1 / (1 + np.where(rho > 0.2, rho, 0).sum(1))

    def _accuracies(self) -> np.ndarray:
        """P(vote is right | it is cast)."""
        right = self.prior[1] * self.theta[1, :, 2] + self.prior[0] * self.theta[0, :, 0]
        wrong = self.prior[0] * self.theta[0, :, 2] + self.prior[1] * self.theta[1, :, 0]
        return right / np.maximum(right + wrong, 1e-12)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, votes: one row for each row of ``docs``."""
    spark = docs.sparkSession
    entries = lexicon(docs, labels, sample_rows)
    voted = staged(vote(docs, entries))
    if not entries:  # nothing toxic was labelled: no score can be learned
        return voted.select("doc_id", "held_out", F.lit(0.0).alias("score"),
                            F.lit(0).alias("predicted"), "votes")
    # voters answer alike in at most 2**6 * 3 * 2**4 ways, so few patterns reach the driver
    tally = voted.groupBy("votes").count().collect()
    model = LabelModel(np.array([r.votes for r in tally]), np.array([r["count"] for r in tally]))
    soft = spark.createDataFrame(
        [(r.votes, float(p)) for r, p in zip(tally, model.posterior())],
        "p_votes array<int>, p double")
    free = voted.filter(~F.col("held_out"))
    mark = F.xxhash64("doc_id", F.lit("fit"))
    # a share of the hash range that holds about fit_rows rows
    part = min(1.0, fit_rows / max(1, free.count()))
    sample = free.filter(F.pmod(mark, F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    # a hit each, and how many there are
    terms_of = F.concat(F.transform("hits", lambda i: i.cast("string")), F.transform(
        F.sequence(F.lit(0), F.least(F.size("hits"), F.lit(MANY))),
        lambda i: F.concat(F.lit("n"), i.cast("string"))))
    both = (sample.join(F.broadcast(soft), F.col("votes") == F.col("p_votes"))
            .select(terms_of.alias("names"), F.explode(F.array(
                F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")),
                F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w")))).alias("e"))
            .select("names", "e.y", "e.w").groupBy("names", "y").agg(F.sum("w").alias("w"))
            .filter("w > 1e-6"))
    vectors = CountVectorizerModel.from_vocabulary(
        [*map(str, range(len(entries))), *(f"n{i}" for i in range(MANY + 1))], inputCol="names", outputCol="x")
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4,
                             standardization=False, maxIter=60).fit(
        vectors.transform(staged(both)))
    scored = fit.transform(vectors.transform(voted.withColumn("names", terms_of)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "held_out", score.alias("score"),
                         F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"), "votes")
