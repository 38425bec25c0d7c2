"""Mutual information of numbers with a label from distances to nearest neighbours.

For each row: the distance to its k-th nearest row of the same label, and how many rows of any
label lie strictly nearer (for a distance of zero: at the same value).  With digamma averages of
both, information is psi(n) + avg psi(k) - avg psi(rows of the label) - avg psi(rows nearer).
Columns are one-dimensional, so both are questions of order and no pairs of rows are formed:

* equal values are one row with a count, however hot a value is;
* an order is cut into ranges that are worked on apart; a range is lent the k values before and
  after it, so neighbours across a border are found;
* rows within a radius are the difference of two running totals, looked up at the radius' ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.operators.quantiles import melt
from foldstone.operators.ranks import prefix_sums, range_number
from foldstone.session import checkpoint

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 on: the recurrence up to n + 8 and the series there."""
    x = n.cast("double") + 8.0
    near = F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) \
        - 1 / (252 * x * x * x * x * x * x) + 1 / (240 * x * x * x * x * x * x * x * x)
    for j in range(8):
        near = near - 1 / (n.cast("double") + float(j))
    return near


def neighbour_distances(
    counts: DataFrame, by: Sequence[str], k: int = NEIGHBOURS, value: str = "value", rows: str = "c",
) -> DataFrame:
    """Add ``radius``: the distance from a value to its k-th nearest row of the same keys.

    ``counts`` has one row per (by..., value) with its number of ``rows``.  A group of no more than
    k rows uses its farthest row; a row that is alone has no radius.
    """
    by = list(by)
    counts = checkpoint(range_number(counts, value, by, "__range"))
    inside = Window.partitionBy(*by, "__range")
    ends = (
        counts.withColumn("__up", F.row_number().over(inside.orderBy(value)))
        .withColumn("__down", F.row_number().over(inside.orderBy(F.desc(value))))
        .where(F.least("__up", "__down") <= k)
    )
    # At most 2 k rows of each range; they hold the k values on either side of every border.
    row = F.struct(F.col(value).alias("v"), F.col(rows).cast("long").alias("n"))
    along = Window.partitionBy(*by).orderBy(value)
    lent = ends.select(
        *by, "__range", "__up", "__down",
        F.collect_list(row).over(along.rowsBetween(-k, -1)).alias("before"),
        F.collect_list(row).over(along.rowsBetween(1, k)).alias("after"))
    lent = lent.select(*by, "__range", F.explode(F.concat(
        F.when(F.col("__up") == 1, F.col("before")).otherwise(F.array()),
        F.when(F.col("__down") == 1, F.col("after")).otherwise(F.array()))).alias("e"))
    both = counts.withColumn("__own", F.lit(True)).unionByName(
        lent.select(*by, "__range", F.col("e.v").alias(value), F.col("e.n").alias(rows)
                    ).withColumn("__own", F.lit(False)), allowMissingColumns=True)
    near = F.collect_list(row).over(
        Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(-k, k))
    # The rows at or nearer than each neighbour, the row itself left out; the first to reach k.
    apart = F.array_sort(F.transform(near, lambda e: F.struct(
        F.abs(e["v"] - F.col(value)).alias("d"), e["n"].alias("n"))))
    walked = F.aggregate(
        apart, F.struct(F.lit(-1).cast("long").alias("n"), F.lit(None).cast("double").alias("d")),
        lambda s, e: F.when(s["n"] >= k, s).otherwise(F.struct(
            (s["n"] + e["n"]).alias("n"),
            F.when(s["n"] + e["n"] > 0, e["d"]).alias("d"))))
    return both.withColumn("radius", walked["d"]).where("__own").drop("__own", "__range")


def within(points: DataFrame, values: DataFrame, by: Sequence[str], value: str = "value",
           rows: str = "c") -> DataFrame:
    """Add ``near``: the rows of ``values`` strictly within ``radius`` of a point, itself included.

    ``values`` has one row per (by..., value).  Points ask for totals at value - radius and
    value + radius; questions and values are one ordered set of places.
    """
    by = list(by)
    low, high = F.col(value) - F.col("radius"), F.col(value) + F.col("radius")
    asked = points.select(*by, F.explode(F.array(low, high)).alias("at"), F.lit(0).cast("long").alias("n"))
    places = asked.unionByName(values.select(*by, F.col(value).alias("at"),
                                             F.col(rows).cast("long").alias("n")))
    totals = prefix_sums(places.groupBy(*by, "at").agg(F.sum("n").alias("n")), by, "at", ["n"])
    totals = checkpoint(totals)  # joined twice
    upto = totals.select(*by, F.col("at").alias("__low"), (F.col("n_before") + F.col("n")).alias("__upto"))
    below = totals.select(*by, F.col("at").alias("__high"), "n", F.col("n_before").alias("__below"))
    placed = points.withColumns({"__low": low, "__high": high}).join(upto, [*by, "__low"]).join(
        below, [*by, "__high"])
    # at a radius of zero both ends are the value itself, whose rows all count
    inside = F.when(F.col("radius") == 0, F.col("n")).otherwise(F.col("__below") - F.col("__upto"))
    return placed.withColumn("near", inside).drop("__low", "__high", "__upto", "__below", "n")


def neighbour_information(
    df: DataFrame, columns: Sequence[str], target: str = "target", k: int = NEIGHBOURS,
) -> DataFrame:
    """(name, rows, mi): information in nats, not below 0, of each column with a label.

    Rows without a label or a value are left out, so fill values first where they shall count.
    Labels of one row are left out too.  A column without rows has none; one of a single value
    has 0.
    """
    labelled = df.where(F.col(target).isNotNull()).withColumn("__y", F.col(target))
    long = melt(labelled, list(columns), ["__y"]).withColumn(
        "value", F.col("value") + F.lit(0.0))  # one zero
    counts = checkpoint(long.groupBy("name", "__y", "value").agg(F.count("*").alias("c")))
    label = counts.groupBy("name", "__y").agg(F.sum("c").alias("ny")).where("ny > 1")
    # One row per column and label.
    counts = counts.join(F.broadcast(label), ["name", "__y"])
    values = counts.groupBy("name", "value").agg(F.sum("c").alias("c"))
    points = neighbour_distances(counts, ["name", "__y"], k)
    found = within(points, values, ["name"])
    used = F.least(F.lit(k), F.col("ny") - 1)
    share = lambda x: F.sum(x * F.col("c"))
    total = F.sum("c")
    return found.groupBy("name").agg(
        total.alias("rows"),
        (digamma(total) + (share(digamma(used)) - share(digamma(F.col("ny")))
                           - share(digamma(F.col("near")))) / total).alias("mi")
    ).select("name", "rows", F.greatest("mi", F.lit(0.0)).alias("mi"))
