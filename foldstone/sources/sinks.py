"""Writing predictions and tuning results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators.metrics import label_of


def prediction_template(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(id, label, score) with the constants 0 and 0.5 for every record."""
    return records.select(F.col(key).alias("id"), F.lit(0).alias("label"),
                          F.lit(0.5).alias("score"))


def to_predictions(scores: DataFrame, key: str = "record_id", p: str = "p") -> DataFrame:
    """(id, label, score) with label = (score >= 0.5)."""
    return scores.select(F.col(key).alias("id"), label_of(F.col(p)).alias("label"),
                         F.col(p).alias("score"))


def write_predictions(
    predictions: DataFrame, paths: str | Sequence[str], single_file: bool = False,
    ordered: bool = True,
) -> None:
    """Write (id, label, score) as CSV with the file's column names to one or more folders.

    The rows are computed once for all paths.  ``single_file`` is for small hand-in sets only.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = predictions.select(F.col("id").alias("ID"), F.col("label").alias("TargetF1"),
                             F.col("score").alias("TargetRAUC"))
    if ordered:
        out = out.orderBy("ID")
    if single_file:
        out = out.coalesce(1)
    if len(paths) > 1:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    for path in paths:
        out.write.mode("overwrite").option("header", True).csv(path)
    if len(paths) > 1:
        out.unpersist()


def write_trials(trials: DataFrame, path: str) -> None:
    """Tuning results (model, score, params map) as JSON lines."""
    trials.write.mode("overwrite").json(path)


def better(raw_score: float | None, calibrated_score: float | None) -> str:
    """Which predictions to hand in: ``calibrated`` only if it scores strictly higher."""
    if calibrated_score is None:
        return "raw"
    return "calibrated" if raw_score is None or calibrated_score > raw_score else "raw"


