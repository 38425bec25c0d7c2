"""Running totals and exact ranks without a one-task window.

A window without PARTITION BY, or over a two-valued label, sorts everything in one or two tasks.
Both helpers split the order into many ranges, rank inside each range, and add the total of the
ranges below, which is a small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 10


def all_equal(left: str, right: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of same-named columns of two aliased frames."""
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a & b, pairs)


def range_number(df: DataFrame, order: str, keys: Sequence[str], name: str) -> DataFrame:
    """Add the number of the value range each row falls in.

    Range limits are the order values of the rows with the smallest hashes: a uniform sample of at
    most 2**RANGE_BITS - 1 rows, kept as one array.  Equal order values always share a range, so
    ranges can be processed apart whatever the sample was.
    """
    limits = (
        df.select(F.col(order), F.xxhash64(order, *keys).alias("h"))
        .where(F.col(order).isNotNull())
        .orderBy("h", order)
        .limit(2**RANGE_BITS - 1)
        .agg(F.sort_array(F.collect_list(order)))
        .scalar()
    )
    steps = F.array(*[F.lit(2**i) for i in reversed(range(RANGE_BITS))])

    def search(low, step):
        reached = F.get(F.col("__limits"), low + step - 1) <= F.col(order)
        return F.when(reached, low + step).otherwise(low)

    return (
        df.withColumn("__limits", limits)
        .withColumn(name, F.aggregate(steps, F.lit(0), search))
        .drop("__limits")
    )


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]
) -> DataFrame:
    """For each measure add ``<measure>_before``: its sum over rows of the same keys whose order
    value is smaller.

    ``df`` must hold one row per (keys, order); pre-aggregate first so that repeated values, however
    hot, cost one row.  NULL orders first.
    """
    keys = list(keys)
    # Read three times (limits, range totals, ranks): keep the aggregate, spilling to disk.
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = range_number(df, order, keys, "__range")
    # A struct is never NULL and equals another with NULL in the same places, so plain equality on
    # it joins NULL keys too, and the join and the window below share one hash partitioning.
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "__range")
    ranged = ranged.select(*df.columns, group.alias("__g"))
    key = [F.col(f"__g.k{i}") for i in range(len(keys))]
    below = Window.partitionBy(*key).orderBy("__g.__range").rowsBetween(
        Window.unboundedPreceding, -1)
    # At most 2**RANGE_BITS rows per key.
    starts = (
        ranged.groupBy("__g")
        .agg(*[F.sum(m).alias(f"__{m}") for m in measures])
        .select("__g",
                *[F.coalesce(F.sum(f"__{m}").over(below), F.lit(0)).alias(f"__{m}_start")
                  for m in measures])
    )
    inside = Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "__g").select(
        *df.columns,
        *[(F.col(f"__{m}_start") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
          .alias(f"{m}_before") for m in measures],
    )


def hash_text(seed: int | str, *ids: str) -> Column:
    """md5 hex of ``seed:id[:id...]``; the same text hashes alike in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_rank(
    df: DataFrame,
    name: str,
    ids: Sequence[str],
    seed: int | str,
    part: Sequence[str] = (),
    order: Sequence[tuple[str, bool]] = (),
    hex_digits: int = 3,
) -> DataFrame:
    """Add the 1-based rank within ``part``, ordered by ``order`` (column, ascending?) and then by
    the md5 of the ids: a seeded shuffle that is the same on every run.

    The first hex digits of the hash cut each (part, order) group into 16**hex_digits even ranges,
    so no task sorts a whole class.  Counting ranges and ranking share one hash partitioning.
    """
    part = list(part)
    by = [c for c, _ in order]
    hashed = df.withColumn("__h", hash_text(seed, *ids)).withColumn(
        "__b", F.substring("__h", 1, hex_digits))
    # See prefix_sums for why the group is a struct.
    fields = {f"k{i}": c for i, c in enumerate([*part, *by])}
    group = F.struct(*[F.col(c).alias(k) for k, c in fields.items()], "__b")
    hashed = hashed.withColumn("__g", group).drop("__b")
    value_sort = [
        F.col(f"__v.k{len(part) + i}").asc() if up else F.col(f"__v.k{len(part) + i}").desc()
        for i, (_, up) in enumerate(order)] or [F.lit(0)]
    # Two levels: totals of the distinct order values, then of the hash ranges inside each value,
    # so that only the former, which are few, are ever ordered together.
    sizes = hashed.groupBy("__g").agg(F.count("*").alias("__n"))
    value = F.struct(*[F.col(f"__g.k{i}") for i in range(len(fields))], F.lit(0).alias("z"))
    earlier = Window.partitionBy(*[F.col(f"__v.k{i}") for i in range(len(part))]).orderBy(
        *[s for s in value_sort]).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (sizes.groupBy(value.alias("__v")).agg(F.sum("__n").alias("__m"))
              .select("__v", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__first")))
    within = Window.partitionBy("__v").orderBy("__g.__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__v", value).join(firsts, "__v").select(
        "__g", (F.col("__first") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__start"))
    inside = Window.partitionBy("__g").orderBy("__h", *ids)
    return (
        hashed.join(starts, "__g")
        .withColumn(name, F.col("__start") + F.row_number().over(inside))
        .drop("__h", "__g", "__start")
    )
