"""Deterministic fold assignment: a seeded hash decides the order, ranks decide the folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators.joins import lookup_join
from foldstone.operators.ranks import hash_rank


def stratified_folds(
    df: DataFrame, key: str = "record_id", target: str = "target", k: int = K.FOLDS,
    seed: int = K.SEED, name: str = "fold",
) -> DataFrame:
    """Add a fold number 0..k-1; within each label, fold sizes differ by at most one."""
    ranked = hash_rank(df, "__rank", [key], seed, part=[target])
    return ranked.withColumn(name, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def stratified_split(
    df: DataFrame, key: str = "record_id", target: str = "target", share: float = 0.2,
    seed: int = K.SEED,
) -> DataFrame:
    """Add ``part``: ``valid`` for ``share`` of every label, else ``fit``."""
    sizes = df.groupBy(target).agg(F.count("*").alias("__n"))
    ranked = lookup_join(hash_rank(df, "__rank", [key], seed, part=[target]), sizes, [target])
    part = F.when(F.col("__rank") <= F.col("__n") * F.lit(share), "valid").otherwise("fit")
    return ranked.withColumn("part", part).drop("__rank", "__n")


def group_folds(
    df: DataFrame, group: str, target: str = "target", k: int = K.FOLDS, seed: int = K.SEED
) -> DataFrame:
    """(group, rows, positives, fold): whole groups dealt out in turn, most positives first, so
    that no group is split and positives stay balanced.  Join back on the group to use it."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("rows"), F.sum(target).alias("positives"))
    ranked = hash_rank(sizes, "__rank", [group], seed,
                       order=[("positives", False), ("rows", False)])
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def greedy_group_folds(
    df: DataFrame, group: str, target: str = "target", k: int = K.FOLDS, seed: int = K.SEED
) -> DataFrame:
    """(group, rows, positives, fold): whole groups, each fold's rows and positives kept level.

    Groups of one shape (rows, positives) are interchangeable, so only shapes are planned: of the m
    groups of a shape every fold gets m // k, and what is left over goes, heaviest shape first, to
    the fold with the least load so far, the lowest number winning ties.  A load is the share of
    all positives plus the share of all rows, in whole numbers.  The plan's state grows with the
    shapes, not with the groups; which group of a shape goes where is a seeded hash's decision.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("positives"))
    shapes = sizes.groupBy("rows", "positives").agg(F.count("*").alias("n")).collect()
    plan = df.sparkSession.createDataFrame(
        _leftovers([tuple(s) for s in shapes], k),
        "rows long, positives long, __even long, __left array<int>")
    ranked = lookup_join(
        hash_rank(sizes, "__rank", [group], seed, part=["rows", "positives"]), plan,
        ["rows", "positives"])
    at = F.col("__rank") - 1
    fold = F.when(at < F.col("__even"), at % k).otherwise(F.get(
        F.col("__left"), (at - F.col("__even")).cast("int")))
    return ranked.select(group, "rows", "positives", fold.cast("int").alias("fold"))


def _leftovers(shapes: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(rows, positives, groups dealt evenly, folds of the others) of shapes (rows, positives, n)."""
    all_rows = sum(r * n for r, _, n in shapes)
    all_positives = max(sum(p * n for _, p, n in shapes), 1)
    load, out = [0] * k, []

    def weight(rows: int, positives: int) -> int:
        return positives * all_rows + rows * all_positives

    for rows, positives, n in sorted(shapes, key=lambda s: (-weight(*s[:2]), -s[0])):
        left = []
        for _ in range(n % k):
            fold = load.index(min(load))
            load[fold] += weight(rows, positives)
            left.append(fold)
        out.append((rows, positives, n - n % k, left))
    return out


def complement_rates(df: DataFrame, fold: str = "fold", target: str = "target") -> DataFrame:
    """(fold, rows, rate) over the rows outside each fold: totals minus the fold's own sums, so one
    pass serves every fold."""
    own = df.groupBy(fold).agg(
        F.count("*").alias("n"), F.count(target).alias("m"), F.sum(target).alias("s"))
    every = Window.partitionBy(F.lit(0))  # one row per fold
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "m", "s")}
    return own.select(fold, rest["n"].alias("rows"), F.try_divide(rest["s"], rest["m"])
                      .alias("rate"))


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """(target, rows, weight) with weight = n / (classes * rows of the class)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("rows"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn(
        "weight", F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows")))
