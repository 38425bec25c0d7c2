"""Spatial clusters: k-means with restarts on a few coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.plans.grid import WORKERS, together


def _points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = df.withColumns(
        {f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__point").transform(
        filled).drop(*[f"__{c}" for c in columns])


def fit_clusters(
    df: DataFrame, columns: Sequence[str] = ("latitude", "longitude"), k: int = K.CLUSTERS,
    restarts: int = K.CLUSTER_RESTARTS, seed: int = K.SEED, workers: int = WORKERS,
) -> KMeansModel:
    """The fit with the lowest cost of several seeds, which run side by side.

    Equal points collapse to one weighted row first, so a place holding a third of all records is
    one row.  Fit on training rows only; pass the union of both splits to fit on all.
    """
    points = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    weighted = points.groupBy(*columns).agg(F.count("*").cast("double").alias("rows"))
    rows = _points(weighted, columns).select("__point", "rows").persist()
    rows.count()  # stored once for all restarts
    fits = together(df.sparkSession, [
        lambda i=i: KMeans(k=k, seed=seed + i, featuresCol="__point", weightCol="rows",
                           predictionCol="cluster").fit(rows) for i in range(restarts)], workers)
    rows.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)  # the first of equal ones


def assign_clusters(
    model: KMeansModel, df: DataFrame, columns: Sequence[str] = ("latitude", "longitude"),
    name: str = "spatial_cluster",
) -> DataFrame:
    return model.transform(_points(df, columns)).withColumnRenamed("cluster", name).drop("__point")
