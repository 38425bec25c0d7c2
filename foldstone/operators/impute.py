"""Filling, scaling and one-hot coding with statistics fitted on one frame, applied to any.

Fitted statistics are a few numbers per column, so they come to the driver and enter the applied
plan as literals: applying is a narrow projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.operators.encode import category_codes
from foldstone.operators.joins import lookup_join
from foldstone.operators.quantiles import SKETCH_ACCURACY, exact_quantiles, melt
from foldstone.operators.ranks import prefix_sums

#: The most columns that ``one_hot`` adds.
MAX_FLAGS = 1_000
#: Parts of all rows on either side of the middle, of which ``fold_medians`` takes the least that will do.
MARGINS = (0.0005, 0.002, 0.01, 0.05, 0.25)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; columns without any value are absent."""
    rows = exact_quantiles(df, columns, [0.5]).select("name", "value").collect()
    return {r["name"]: r["value"] for r in rows}


def fold_medians(
    df: DataFrame, columns: Sequence[str], k: int, fold: str = "fold",
) -> list[dict[str, float]]:
    """For each fold 0..k-1 the exact median per column of the rows outside it.

    Rows without a fold are outside every fold; columns without any value there are absent.  All
    folds share three scans: a sketch of all rows brackets every column's medians, the rows below
    each bracket are counted for each fold, and values inside it are ranked with one count per fold.
    A bracket that misses the median of any fold is opened to all values.
    """
    columns, folds = list(columns), range(k)
    outside = [~F.col(fold).eqNullSafe(F.lit(f)) for f in folds]
    probs = [0.5 + side * m for m in MARGINS for side in (-1, 1)]
    sketch = melt(df, columns).groupBy("name").agg(
        F.count("*").alias("n"), F.percentile_approx("value", probs, SKETCH_ACCURACY).alias("q"))
    brackets = {}
    for r in sketch.collect():
        # a fold's median strays from that of all rows by chance, and the sketch by its accuracy
        need = 2.0 / SKETCH_ACCURACY + 3.0 / math.sqrt(r["n"])
        at = next((i for i, m in enumerate(MARGINS) if m >= need), None)
        brackets[r["name"]] = (-math.inf, math.inf) if at is None else tuple(r["q"][2 * at:2 * at + 2])
    if not brackets:
        return [{} for _ in folds]

    def cells() -> DataFrame:
        marked = F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"),
                     F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
            for c, (lo, hi) in brackets.items()])
        return df.select(fold, F.inline(marked)).where(
            F.col("value").isNotNull() & ~F.isnan("value"))

    tests = {"n": F.lit(True), "below": F.col("value") < F.col("lo"),
             "upto": F.col("value") <= F.col("hi")}
    counts = {r["name"]: r for r in cells().groupBy("name").agg(*[
        F.array(*[F.count_if(o & test) for o in outside]).alias(name)
        for name, test in tests.items()]).collect()}
    marks = []
    for c, r in counts.items():
        places = [0.5 * (n - 1) for n in r["n"]]
        sure = all(b <= math.floor(p) and math.ceil(p) < u
                   for n, p, b, u in zip(r["n"], places, r["below"], r["upto"], strict=True) if n)
        if not sure:
            brackets[c] = (-math.inf, math.inf)
        marks.append((c, list(r["below"]) if sure else [0] * k, places))
    inside = cells().where(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy(
        "name", "value").agg(*[F.count_if(o).alias(f"m{f}") for f, o in zip(folds, outside)])
    ranked = prefix_sums(inside, ["name"], "value", [f"m{f}" for f in folds])
    marked = ranked.join(F.broadcast(df.sparkSession.createDataFrame(  # one row per column
        marks, "name string, below array<long>, place array<double>")), "name")

    def value_at(f: int, rank) -> Column:
        before = F.col("below")[f] + F.col(f"m{f}_before")
        return F.max(F.when((before <= rank) & (rank < before + F.col(f"m{f}")), F.col("value")))

    picked = marked.groupBy("name").agg(*[
        value_at(f, side(F.col("place")[f])).alias(f"{name}{f}")
        for f in folds for name, side in (("lo", F.floor), ("hi", F.ceil))]).collect()
    out: list[dict[str, float]] = [{} for _ in folds]
    for r in picked:
        for f in folds:
            if counts[r["name"]]["n"][f]:
                place = 0.5 * (counts[r["name"]]["n"][f] - 1)
                lo, hi = r[f"lo{f}"], r[f"hi{f}"]
                out[f][r["name"]] = lo + (hi - lo) * (place - math.floor(place))
    return out


def median_impute(fit: DataFrame, apply_to: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers with the exact medians of ``fit``."""
    found = medians(fit, columns)
    return apply_to.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(found[c])))
        for c in columns if c in found})


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, rows): most frequent value per column; the smallest wins a tie."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("name", "value").agg(
        F.count("*").alias("rows"))
    return counts.groupBy("name").agg(F.min(F.struct((-F.col("rows")).alias("r"), "value"))
                                      .alias("m")).select(
        "name", F.col("m.value").alias("value"), (-F.col("m.r")).alias("rows"))


def mode_impute(fit: DataFrame, apply_to: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing text with the most frequent value of ``fit``."""
    found = {r["name"]: r["value"] for r in modes(fit, columns).collect()}
    return apply_to.fillna({c: v for c, v in found.items()}, subset=list(columns))


def categories(df: DataFrame, column: str, most: int | None = None) -> list:
    """Sorted distinct values of a column; more than ``most``, if that is given, are refused."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct()
    found = (found if most is None else found.limit(most + 1)).collect()
    if most is not None and len(found) > most:
        raise ValueError(f"{column} has more than {most} values: use one_hot_sparse")
    return sorted(r[0] for r in found)


def one_hot(fit: DataFrame, apply_to: DataFrame, column: str) -> DataFrame:
    """Add one 0/1 column per value seen in ``fit``; other values are 0 everywhere.

    Columns of more than ``MAX_FLAGS`` values are refused, as no schema holds any number;
    ``one_hot_sparse`` takes any.
    """
    return apply_to.withColumns({
        f"{column}_{i}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
        for i, v in enumerate(categories(fit, column, MAX_FLAGS))})


def one_hot_sparse(fit: DataFrame, apply_to: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_flags``: a sparse vector with a 1 at the place of the value among the sorted
    values of ``fit``; other values and missing ones are all 0."""
    codes = category_codes(fit, column, "__at").withColumnRenamed("value", column)
    n = codes.count()
    # the place after the last one stands for any other value and is dropped
    coded = lookup_join(apply_to, codes, [column]).withColumn(
        "__at", F.coalesce("__at", F.lit(n)).cast("double"))
    places = fit.sparkSession.range(max(n, 1)).select(F.col("id").cast("double").alias("__at"))
    flags = OneHotEncoder(inputCol="__at", outputCol=f"{column}_flags", dropLast=True,
                          handleInvalid="keep")
    return flags.fit(places).transform(coded).drop("__at")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column."""
    row = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in columns
                   for n, f in (("avg", F.avg), ("std", F.stddev_pop))]).first()
    return {c: (row[f"avg_{c}"], row[f"std_{c}"]) for c in columns}


def standardize(fit: DataFrame, apply_to: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the population deviation of ``fit``; constant columns only centre."""
    return apply_moments(apply_to, moments(fit, columns))


def apply_moments(df: DataFrame, found: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
        for c, (m, s) in found.items() if m is not None})


def add_class_weight(df: DataFrame, target: str = "target", name: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class (a label column: a handful of values)."""
    from foldstone.operators.folds import class_weights

    table = {r[target]: r["weight"] for r in class_weights(df, target).collect()}
    case = F.lit(None).cast("double")
    for value, weight in table.items():
        case = F.when(F.col(target) == F.lit(value), F.lit(float(weight))).otherwise(case)
    return df.withColumn(name, case)


