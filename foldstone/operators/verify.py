"""Checks of a prediction set and profiles of several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators.metrics import label_of


def verify_predictions(predictions: DataFrame, template: DataFrame) -> DataFrame:
    """One row of checks: row counts, columns, missing cells, label counts, score range, and
    whether every label equals (score >= 0.5).  Both sides carry (id, label, score)."""
    expected = template.agg(F.count("*")).scalar()
    cells = sum((F.count_if(F.col(c).isNull()) for c in predictions.columns[1:]),
                F.count_if(F.col(predictions.columns[0]).isNull()))
    return predictions.agg(
        F.count("*").alias("rows"),
        cells.alias("missing_cells"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.avg("score").alias("score_mean"),
        F.coalesce(F.bool_and(F.coalesce(
            F.col("label") == label_of(F.col("score")), F.lit(False))), F.lit(True))
        .alias("threshold_ok"),
    ).withColumns({
        "expected_rows": expected,
        "columns_ok": F.lit(predictions.columns == template.columns),
    }).withColumn("shape_ok", (F.col("rows") == F.col("expected_rows")) & F.col("columns_ok"))


def profile_prediction_sets(predictions: DataFrame, source: str = "source") -> DataFrame:
    """(source, rows, positives, positive_share, mean_score) per prediction set."""
    return predictions.groupBy(source).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.try_divide(F.count_if(F.col("label") == 1), F.count("*")).alias("positive_share"),
        F.avg("score").alias("mean_score"))
