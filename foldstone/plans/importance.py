"""Which features matter: model importances and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators.metrics import roc_auc
from foldstone.operators.ranks import hash_rank
from foldstone.plans.models import score


def feature_importance(spark, model, features: Sequence[str], top: int = 15) -> DataFrame:
    """(feature, importance), largest first; one row per feature of a fitted tree model."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances, strict=True)]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def permuted(df: DataFrame, features: Sequence[str], repeats: int, seed: int = K.SEED) -> DataFrame:
    """Each row once per (feature, repeat) with that feature's value taken from another row.

    A permutation is a join of two seeded orders of the same rows on their rank; ranks are built in
    hash ranges, so no task orders all rows.
    """
    cases = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"))
                      for f in features for r in range(repeats)])
    long = df.withColumn("__case", F.explode(cases)).select(*df.columns, "__case.*")
    case = ["feature", "repeat"]
    taken = F.lit(None).cast("double")
    for f in features:
        taken = F.when(F.col("feature") == f, F.col(f).cast("double")).otherwise(taken)
    # Seeds differ per repeat because the case is part of the hashed text.
    ids = ["record_id", *case]
    givers = hash_rank(long.withColumn("__v", taken).select("record_id", *case, "__v"),
                       "__rank", ids, f"give{seed}", part=case).select(*case, "__rank", "__v")
    takers = hash_rank(long, "__rank", ids, f"take{seed}", part=case)
    mixed = takers.join(givers, [*case, "__rank"])
    return mixed.withColumns({
        f: F.when(F.col("feature") == f, F.col("__v")).otherwise(F.col(f).cast("double"))
        for f in features}).drop("__v", "__rank")


def permutation_importance(
    model, df: DataFrame, features: Sequence[str], repeats: int = 10, seed: int = K.SEED
) -> DataFrame:
    """(feature, importance, deviation): mean and spread of the AUC lost when a feature's values
    are shuffled between rows.  ``df`` carries record_id, target and the filled features."""
    base = roc_auc(score(model, df, features)).scalar()
    rows = permuted(df.select("record_id", "target", *features), features, repeats, seed)
    auc = roc_auc(score(model, rows, features), by=["feature", "repeat"])
    lost = auc.withColumn("lost", base - F.col("auc"))
    return lost.groupBy("feature").agg(
        F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("deviation"))
