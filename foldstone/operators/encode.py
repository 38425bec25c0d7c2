"""Encodings of categories: smoothed target means (out of fold and full) and dense codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators.joins import counted, lookup_join
from foldstone.operators.ranks import prefix_sums


def _cells(columns: Sequence[str]):
    return F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("key"))
                     for c in columns])


def target_encode_oof(
    df: DataFrame, columns: Sequence[str], target: str = "target", fold: str = "fold",
    smoothing: float = K.SMOOTHING, prior: str = "all",
) -> DataFrame:
    """Add ``<column>_te``: the smoothed target mean over the folds a row is not in.

    Sums per (column, value, fold) for all columns come from one scan and one shuffle; the sums
    over the other folds are total minus own.  ``prior="all"`` shrinks to the mean of all rows;
    ``prior="fold"`` to the mean of the other folds, which keeps the row's own fold out entirely.
    """
    a = F.lit(float(smoothing))
    every = df.where(F.col(target).isNotNull())
    stats = every.select(target, fold, F.inline(_cells(columns))).where("key is not null").groupBy(
        "name", "key", fold).agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    one_key = Window.partitionBy("name", "key")
    rest_sum = F.sum("s").over(one_key) - F.col("s")
    rest_n = F.sum("n").over(one_key) - F.col("n")
    if prior == "all":
        # The mean stays a scalar of its own: one value, known once, also used for new keys.
        mean = every.agg(F.avg(target)).scalar()
        df = df.withColumn("__prior", mean)
    else:
        per_fold = every.groupBy(fold).agg(F.sum(target).alias("s"), F.count("*").alias("n"))
        whole = Window.partitionBy(F.lit(0))  # one row per fold
        priors = per_fold.select(fold, F.try_divide(
            F.sum("s").over(whole) - F.col("s"), F.sum("n").over(whole) - F.col("n"))
            .alias("__prior"))
        df = df.join(F.broadcast(priors), fold, "left")
    table, small = counted(
        stats.select("name", "key", fold, rest_sum.alias("s"), rest_n.alias("n")))
    for c in columns:
        part = table.where(F.col("name") == c).select(
            F.col("key").alias("__key"), fold, F.col("s").alias("__s"), F.col("n").alias("__n"))
        df = df.withColumn("__key", F.col(c).cast("string"))
        df = lookup_join(df, part, ["__key", fold], small=small).withColumn(
            f"{c}_te",
            F.coalesce((F.col("__s") + a * F.col("__prior")) / (F.col("__n") + a),
                       F.col("__prior"))).drop("__key", "__s", "__n")
    return df.drop("__prior")


def target_means(
    train: DataFrame, columns: Sequence[str], target: str = "target",
    smoothing: float = K.SMOOTHING,
) -> DataFrame:
    """(name, key, rows, encoding): smoothed mean per value over all training rows."""
    a = F.lit(float(smoothing))
    known = train.where(F.col(target).isNotNull())
    mean = known.agg(F.avg(target)).scalar()
    return known.select(target, F.inline(_cells(columns))).where("key is not null").groupBy(
        "name", "key").agg(F.sum(target).alias("s"), F.count("*").alias("rows")).select(
        "name", "key", "rows", ((F.col("s") + a * mean) / (F.col("rows") + a)).alias("encoding"))


def target_encode_full(
    train: DataFrame, apply_to: DataFrame, columns: Sequence[str], target: str = "target",
    smoothing: float = K.SMOOTHING,
) -> DataFrame:
    """Add ``<column>_te`` to unlabelled rows from all training rows; new values get the mean."""
    table, small = counted(target_means(train, columns, target, smoothing))
    mean = train.where(F.col(target).isNotNull()).agg(F.avg(target)).scalar()
    for c in columns:
        part = table.where(F.col("name") == c).select(
            F.col("key").alias("__key"), F.col("encoding").alias("__e"))
        apply_to = lookup_join(
            apply_to.withColumn("__key", F.col(c).cast("string")), part, ["__key"],
            small=small).withColumn(f"{c}_te", F.col("__e")).drop("__key", "__e")
    return apply_to.withColumn("__prior", mean).withColumns(
        {f"{c}_te": F.coalesce(F.col(f"{c}_te"), F.col("__prior")) for c in columns}
    ).drop("__prior")


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, code): position of each distinct value in sorted order, from 0."""
    distinct = df.where(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("value")).agg(F.lit(1).alias("one"))
    return prefix_sums(distinct, [], "value", ["one"]).select(
        "value", F.col("one_before").cast("int").alias(name))


def with_category_code(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the code of a category; missing is -1."""
    table = category_codes(df, column, name).withColumnRenamed("value", column)
    return lookup_join(df, table, [column]).withColumn(name, F.coalesce(name, F.lit(-1)))
