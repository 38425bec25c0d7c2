"""Scores of probability predictions: F1, exact ROC-AUC, their weighted sum, class reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions.scalar import present
from foldstone.operators.ranks import all_equal, prefix_sums


def label_of(p: Column, threshold: float = K.LABEL_THRESHOLD) -> Column:
    """1 where the probability reaches the threshold; missing and NaN give 0."""
    return F.coalesce(present(p.cast("double")) >= F.lit(threshold), F.lit(False)).cast("int")


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), 0 where that has no denominator."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).cast("double")


def composite(f1: Column, auc: Column) -> Column:
    return F.lit(K.F1_WEIGHT) * f1 + F.lit(K.AUC_WEIGHT) * auc


def confusion(
    df: DataFrame, y: str = "target", p: str = "p", by: Sequence[str] = (),
    threshold: float = K.LABEL_THRESHOLD,
) -> DataFrame:
    """(by..., tp, fp, fn, tn, f1) in one pass; rows without a label are left out."""
    hit, label = label_of(F.col(p), threshold) == 1, F.col(y) == 1
    return df.where(F.col(y).isNotNull()).groupBy(*by).agg(
        F.count_if(hit & label).alias("tp"),
        F.count_if(hit & ~label).alias("fp"),
        F.count_if(~hit & label).alias("fn"),
        F.count_if(~hit & ~label).alias("tn"),
    ).withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))


def roc_auc(df: DataFrame, y: str = "target", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): chance that a positive outranks a negative, ties counting half.

    Rows collapse to one per distinct score before anything is ordered.  NULL when only one class
    is present.
    """
    by = list(by)
    label = F.col(y).cast("int")
    per_score = (
        df.where(F.col(y).isNotNull()).select(*by, label.alias("y"), present(
            F.col(p).cast("double")).alias("p"))
        .where("p is not null").groupBy(*by, "p")
        .agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    )
    ranked = prefix_sums(per_score, by, "p", ["neg"])
    # Products of two counts pass the range of a long at scale: sum them as doubles.
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(wins), pairs).alias("auc"))


def score_metrics(
    df: DataFrame, y: str = "target", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., f1, auc, score) with score = 0.60 f1 + 0.40 auc."""
    by = list(by)
    left, right = confusion(df, y, p, by), roc_auc(df, y, p, by)
    joined = left.alias("a").join(right.alias("b"), all_equal("a", "b", by)) if by else (
        left.withColumn("auc", right.scalar()))
    out = joined.select(*[F.col(f"a.{c}").alias(c) for c in by], "f1", "auc") if by else (
        joined.select("f1", "auc"))
    return out.withColumn("score", composite(F.col("f1"), F.col("auc")))


def classification_report(
    df: DataFrame, y: str = "target", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., label, precision, recall, f1, support) for labels 0 and 1."""
    counts = confusion(df, y, p, by)

    def rows(label, tp, fp, fn):
        tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
        zero = F.lit(0.0)
        return F.struct(
            F.lit(label).alias("label"),
            F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
            F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
            f1_of(tp, fp, fn).alias("f1"),
            (tp + fn).alias("support"))

    return counts.select(*by, F.inline(F.array(
        rows(0, "tn", "fn", "fp"), rows(1, "tp", "fp", "fn"))))
