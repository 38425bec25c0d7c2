"""Joins and set comparisons between record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def enrich(records: DataFrame, enrichment: DataFrame, key: str = "record_id") -> DataFrame:
    """Left-join the one-row-per-key side table.

    Columns both sides carry are taken from the records.  Both sides shuffle on the key once;
    the right side is unique, so a hot key on the left can be split by AQE.
    """
    repeated = [c for c in enrichment.columns if c in records.columns and c != key]
    return records.join(enrichment.drop(*repeated), key, "left")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: empty for a valid enrichment table."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def counted(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The table, persisted, and whether it is small enough to broadcast.

    Materialising it gives its true size in bytes; later joins read the stored rows.
    """
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    table.count()
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return table, int(str(size)) <= max_bytes


def lookup_join(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
    small: bool | None = None, null_safe: bool = False,
) -> DataFrame:
    """Join an aggregate to many rows, broadcasting it only when measured as small.

    With ``null_safe`` a missing key finds the row of the missing key.

    Pass ``small`` when the table is part of one that ``counted`` has measured.  Larger tables
    are joined as Spark sees fit: the lookup side is unique per key, so AQE can split hot keys.
    """
    if small is None:
        table, small = counted(table)
    if null_safe:
        # a struct is never NULL and equals another with NULL in the same places
        table = table.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
                             .alias("__k"), *[c for c in table.columns if c not in on])
        df = df.withColumn("__k", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)]))
        on = ["__k"]
    return df.join(F.broadcast(table) if small else table, list(on), how).drop("__k")


def key_matches(
    left: DataFrame, right: DataFrame, keys: Sequence[str], further: Sequence[str] = ()
) -> DataFrame:
    """Keys found on both sides with row counts per side and the number of matching pairs.

    Counts are aggregated per key before anything meets, so a key shared by a third of all rows
    is one row here and the pairs are multiplied out, not produced.  NULL keys match NULL keys.
    With ``further`` keys ``exact_pairs`` counts the pairs that agree in those as well.
    """
    keys, every = list(keys), [*keys, *further]
    tagged = left.select(*every, F.lit(1).alias("__l")).unionByName(
        right.select(*every, F.lit(0).alias("__l")))
    counts = tagged.groupBy(*every).agg(
        F.sum("__l").alias("left_rows"), F.sum(F.lit(1) - F.col("__l")).alias("right_rows"))
    pairs = F.col("left_rows") * F.col("right_rows")
    both = "left_rows > 0 and right_rows > 0"
    if not further:
        return counts.where(both).withColumn("pairs", pairs)
    return counts.groupBy(*keys).agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"),
        F.sum(pairs).alias("exact_pairs")).where(both).select(
        *keys, "left_rows", "right_rows", pairs.alias("pairs"), "exact_pairs")


def match_levels(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys_used, matched, left_rows, right_rows, pairs) for the first 1, 2, ... of the keys.

    How fast matches thin out as keys are added tells a leak from chance.  Rows are counted per
    full key once and rolled up from there; levels without a match have a row of zeros.
    """
    keys = list(keys)
    counts = left.select(*keys, F.lit(1).alias("__l")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"))).groupBy(*keys).agg(
        F.sum("__l").alias("__left"), F.sum(F.lit(1) - F.col("__l")).alias("__right"))
    used = F.lit(len(keys)) - F.bit_count(F.grouping_id())
    rolled = counts.rollup(*keys).agg(used.alias("keys_used"), F.sum("__left").alias("l"),
                                      F.sum("__right").alias("r")).where("l > 0 and r > 0")
    found = rolled.groupBy("keys_used").agg(
        F.count("*").alias("matched"), F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"), F.sum(F.col("l") * F.col("r")).alias("pairs"))
    levels = left.sparkSession.range(1, len(keys) + 1).select(F.col("id").cast("int").alias("keys_used"))
    # one row per level on both sides
    return levels.join(F.broadcast(found), "keys_used", "left").fillna(0)


def matching_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys occur in ``right``, with how often they do there."""
    keys = list(keys)
    counts = right.groupBy(*keys).agg(F.count("*").alias("matches"))
    on = [left[k].eqNullSafe(counts[k]) for k in keys]
    return left.join(counts, on).select(*[left[c] for c in left.columns], counts["matches"])


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys on each side, shared keys, and shared / right (NULLs count)."""
    keys = list(keys)
    tagged = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    per_key = tagged.groupBy(*keys).agg(
        F.max("__l").alias("in_left"), F.max("__r").alias("in_right"))
    return per_key.agg(
        F.coalesce(F.sum("in_left"), F.lit(0)).alias("left_distinct"),
        F.coalesce(F.sum("in_right"), F.lit(0)).alias("right_distinct"),
        F.coalesce(F.sum(F.col("in_left") * F.col("in_right")), F.lit(0)).alias("shared"),
    ).withColumn("coverage", F.try_divide("shared", "right_distinct"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack the labelled and unlabelled tables with ``is_train``; absent columns become NULL."""
    return train.withColumn("is_train", F.lit(1)).unionByName(
        test.withColumn("is_train", F.lit(0)), allowMissingColumns=True)
