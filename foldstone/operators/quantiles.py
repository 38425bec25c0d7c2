"""Exact interpolated quantiles of many columns at any size.

The built-in exact percentile holds every distinct value of a column in one task.  Here a sketch
first brackets each wanted rank; values below a bracket are only counted, values above it dropped,
and the few inside are ranked exactly.  A bracket that misses its rank is opened to all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators.joins import counted, lookup_join
from foldstone.operators.ranks import prefix_sums

SKETCH_ACCURACY = 10_000


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., name, value) of numeric columns, missing values left out."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*by, F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., name, prob, value): quantiles interpolated between the two nearest ranks.

    One way for all sizes: bracket, check that the bracket holds the ranks, open it if not, rank
    inside.  A missing group key is a group.
    """
    by = list(by)
    keys = [*by, "name"]
    long = melt(df, columns, by)
    margin = 2.0 / SKETCH_ACCURACY
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]

    def sketch(fractions):
        return F.percentile_approx("value", [float(f) for f in fractions], SKETCH_ACCURACY)

    groups = long.groupBy(*keys).agg(
        F.count("*").alias("n"), sketch(low).alias("low"), sketch(high).alias("high"))
    spec = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(float(p)).alias("prob"),
            (F.col("low")[i] if low[i] > 0 else F.lit(float("-inf"))).alias("lo"),
            (F.col("high")[i] if high[i] < 1 else F.lit(float("inf"))).alias("hi"),
            (F.lit(float(p)) * (F.col("n") - 1)).alias("place"),
        ) for i, p in enumerate(probs)])
    # One row per (by, column).
    marks, small = counted(groups.select(*keys, spec.alias("spec")))
    # How many values lie below each bracket and up to its end: one row per (by, column), combined
    # map-side.
    below = [F.count_if(F.col("value") < F.col("spec")[i]["lo"]) for i in range(len(probs))]
    upto = [F.count_if(F.col("value") <= F.col("spec")[i]["hi"]) for i in range(len(probs))]
    placed = lookup_join(long, marks, keys, "inner", small, null_safe=True)
    found = placed.groupBy(*keys).agg(
        F.first("spec").alias("spec"), F.array(*below).alias("below"), F.array(*upto).alias("upto"))

    def checked(s):
        first = F.get(F.col("below"), s["i"])
        holds = (first <= F.floor(s["place"])) & (F.ceil(s["place"]) < F.get(F.col("upto"), s["i"]))
        return F.struct(
            s["prob"].alias("prob"), s["place"].alias("place"),
            F.when(holds, s["lo"]).otherwise(F.lit(float("-inf"))).alias("lo"),
            F.when(holds, s["hi"]).otherwise(F.lit(float("inf"))).alias("hi"),
            F.when(holds, first).otherwise(F.lit(0)).alias("first"))

    sure, small = counted(found.select(*keys, F.transform("spec", checked).alias("spec")))
    inside = (
        lookup_join(long, sure, keys, "inner", small, null_safe=True)
        .select(*keys, "value", F.inline("spec"))
        .where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        .groupBy(*keys, "prob", "place", "first", "value").agg(F.count("*").alias("rows"))
    )
    ranked = prefix_sums(inside, [*keys, "prob", "place", "first"], "value", ["rows"])
    before = F.col("first") + F.col("rows_before")

    def holds(rank):
        return (before <= rank) & (rank < before + F.col("rows"))

    picked = ranked.groupBy(*keys, "prob").agg(
        F.max(F.when(holds(F.floor("place")), F.col("value"))).alias("lo"),
        F.max(F.when(holds(F.ceil("place")), F.col("value"))).alias("hi"),
        F.first(F.col("place") - F.floor("place")).alias("part"))
    return picked.select(
        *keys, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def wide_quantiles(quantiles: DataFrame, names: dict[float, str], by: Sequence[str]) -> DataFrame:
    """One row per (by..., name) with a column per quantile."""
    return quantiles.groupBy(*by, "name").agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n)
        for p, n in names.items()])


