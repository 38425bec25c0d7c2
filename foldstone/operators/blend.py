"""Blending model predictions: fixed weights, averages, and weight searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions.scalar import grid_points, weighted_sum
from foldstone.operators.metrics import composite, confusion, f1_of, label_of, roc_auc

#: Bins of a candidate's histogram in the first and the second round, and cells of all that a task holds.
HISTOGRAM_BINS = (1 << 11, 1 << 16)
HISTOGRAM_CELLS = 1 << 21


def to_wide(predictions: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key with a column per model, from the long (keys, model, p) table."""
    return predictions.groupBy(*keys).pivot("model", list(models)).agg(F.avg("p"))


def fold_average(
    predictions: DataFrame, key: str = "record_id", by: Sequence[str] = ("model",)
) -> DataFrame:
    """Average a row's predictions over folds and seeds: (key, by..., p, members)."""
    return predictions.groupBy(key, *by).agg(
        F.avg("p").alias("p"), F.count("*").alias("members"))


def blend(wide: DataFrame, models: Sequence[str], weights: Sequence[float], name: str = "p"):
    """Add the weighted sum of model columns."""
    return wide.withColumn(name, weighted_sum(list(models)[:len(weights)], weights))


def simplex(models: int, grid: tuple[float, float, int] = K.SIMPLEX_GRID) -> list[tuple]:
    """All weight tuples whose free weights lie on the grid; the last weight is the remainder and
    tuples where it is negative are left out."""
    points = grid_points(*grid)
    tuples = [()]
    for _ in range(models - 1):
        tuples = [(*t, w) for t in tuples for w in points]
    full = [(*t, 1.0 - reduce(lambda a, b: a + b, t)) for t in tuples]
    return [t for t in full if t[-1] >= 0]


def _candidate_array(candidates: Sequence[Sequence[float]], only: Sequence[int] | None = None):
    rows = ", ".join(
        "struct({} as candidate, array({}) as w)".format(
            i, ", ".join(f"{float(x)!r}D" for x in w)) for i, w in enumerate(candidates)
        if only is None or i in only)
    return F.expr(f"array({rows})")


def _blended(wide: DataFrame, models: Sequence[str], weights) -> DataFrame:
    """(y, candidate, p): each row once per candidate.  Candidates are a short fixed list."""
    p = reduce(lambda a, b: a + b, [F.col("w")[i] * F.col(m) for i, m in enumerate(models)])
    return wide.select("y", *models, F.inline(weights)).select("y", "candidate", p.alias("p"))


def _with_weights(scored: DataFrame, candidates: Sequence[Sequence[float]]) -> DataFrame:
    entry = F.element_at(_candidate_array(candidates), F.col("candidate") + 1)
    return scored.withColumn("w", entry["w"])


def blend_scores(
    wide: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]],
    y: str = "target",
) -> DataFrame:
    """(candidate, w, f1, auc, score) of every candidate weight tuple, in list order."""
    rows = _blended(wide.where(F.col(y).isNotNull()).withColumn("y", F.col(y)), models,
                    _candidate_array(candidates))
    return _with_weights(_scored(rows), candidates)


def _scored(rows: DataFrame) -> DataFrame:
    """(candidate, f1, auc, score); one row per candidate on both sides of the join."""
    scored = confusion(rows, "y", "p", ["candidate"]).join(
        F.broadcast(roc_auc(rows, "y", "p", ["candidate"])), "candidate")
    return scored.select("candidate", "f1", "auc").withColumn(
        "score", composite(F.col("f1"), F.col("auc")))


def first_best(scored: DataFrame) -> DataFrame:
    """The best candidate; the earliest wins a tie (scores compare to ten places, so that the
    order in which doubles were added up does not decide)."""
    return scored.withColumn("__rank", F.round("score", 10)).orderBy(
        F.desc("__rank"), "candidate").limit(1).drop("__rank")


def auc_limits(
    known: DataFrame, models: Sequence[str], candidates: dict[int, Sequence[float]], bins: int
) -> DataFrame:
    """(candidate, f1, low, high): exact F1 and bounds on AUC from a score histogram.

    Pairs in different bins are decided; pairs within a bin count nothing for the lower and one
    for the upper bound.  A task adds up the histograms of all candidates over its rows, so rows
    are neither multiplied nor shuffled.  Rows without a score count for F1 alone, as in the scores.
    """
    names = ["candidate", "slot", "pos", "neg", "tp", "fp", "positives"]
    width, threshold = len(models), K.LABEL_THRESHOLD  # tasks need no module of this package

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {i: np.zeros(2 * bins, np.int64) for i in candidates}
        sums = {i: np.zeros(3, np.int64) for i in candidates}  # tp, fp, positives
        rows = 0
        for batch in parts:
            rows += batch.num_rows
            label = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            scores = [batch.column(f"m{k}").to_numpy(zero_copy_only=False)
                      for k in range(width)]  # a missing one becomes NaN
            for i, w in candidates.items():
                p = reduce(np.add, [x * m for x, m in zip(w, scores)])
                hits = label[p >= threshold]
                sums[i] += (hits.sum(), len(hits) - hits.sum(), label.sum())
                some = ~np.isnan(p)
                slot = np.clip(p[some] * bins, 0, bins - 1).astype(np.int64)
                cells[i] += np.bincount(2 * slot + label[some], minlength=2 * bins)
        for i in candidates if rows else ():
            neg, pos = cells[i].reshape(bins, 2).T
            slot = np.flatnonzero(pos + neg)
            none = np.zeros(len(slot), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                none + i, slot, pos[slot], neg[slot], none, none, none)], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([c], np.int64)) for c in (
                i, 0, 0, 0, *sums[i])], names)

    narrow = known.select((F.col("y") == 1).cast("int").alias("y"), *[
        F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(models)])
    cells = (narrow.mapInArrow(count, ", ".join(f"{n} long" for n in names))
             .groupBy("candidate", "slot").agg(*[F.sum(n).alias(n) for n in names[2:]]))
    # as many rows per candidate as bins at most
    below = Window.partitionBy("candidate").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = cells.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pos = F.col("pos").cast("double")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy("candidate").agg(
        f1_of(F.sum("tp"), F.sum("fp"), F.sum("positives") - F.sum("tp")).alias("f1"),
        F.try_divide(F.sum(pos * F.col("under")), pairs).alias("low"),
        F.try_divide(F.sum(pos * (F.col("under") + F.col("neg"))), pairs).alias("high"))


def may_win(
    known: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]]
) -> list[int]:
    """Candidates whose score may be the best: a coarse histogram of all, a finer one of the rest."""
    alive = list(range(len(candidates)))
    for bins in HISTOGRAM_BINS:
        if len(alive) < 2:
            break
        limits = auc_limits(known, models, {i: candidates[i] for i in alive},
                            max(2, min(bins, HISTOGRAM_CELLS // len(alive)))).select(
            "candidate", composite(F.col("f1"), F.col("low")).alias("least"),
            composite(F.col("f1"), F.col("high")).alias("most")).collect()  # a row per candidate
        bound = [r for r in limits if r["least"] is not None]
        floor = max((r["least"] for r in bound), default=0.0)
        alive = sorted(r["candidate"] for r in bound if r["most"] >= floor - 1e-9)
    return alive


def search_blend(
    wide: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]],
    y: str = "target",
) -> DataFrame:
    """One row (candidate, w, f1, auc, score): the best of many weight tuples.

    Exact AUC needs an ordering per candidate, so it is computed only for candidates whose score
    could still be the best given histogram bounds on AUC.  The result is exactly that of scoring
    all of them.
    """
    known = wide.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), *models)
    alive = may_win(known, models, candidates)
    rows = _blended(known if alive else known.limit(0), models,
                    _candidate_array(candidates, alive or None))
    return first_best(_with_weights(_scored(rows), candidates))
