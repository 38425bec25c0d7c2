"""Aggregates over the days before a record's date, per place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone import constants as K


def _middle(ordered: Column) -> Column:
    """Median of a sorted array: at most one value per day of the window."""
    n = F.size(ordered)
    low, high = F.get(ordered, ((n - 1) / 2).cast("int")), F.get(ordered, (n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def daily_series(
    readings: DataFrame, place: str, day: str, value: str, measure=F.sum
) -> DataFrame:
    """(place, day, value): readings reduced to one row per place and day."""
    return readings.groupBy(place, F.col(day).cast("date").alias("day")).agg(
        measure(value).alias("value"))


def trailing_windows(
    records: DataFrame, series: DataFrame, place: str, day: str,
    lengths: Sequence[int] = K.TRAILING_DAYS, above: float = K.WET_DAY_ABOVE_MM,
    key: str = "record_id",
) -> DataFrame:
    """(key) with sum, mean, max, min, median and days above a limit for each window length.

    The window is [date - n, date): the record's own day is left out and days without a reading
    are simply absent.  Windows are evaluated once per distinct (place, date) and not per record:
    the wanted dates join the series as rows without a value, so dates the series lacks still get
    an answer.  A place holds one row per calendar day at most, which bounds each window partition.
    """
    records = records.select(key, place, F.col(day).cast("date").alias("day"))
    wanted = records.where(F.col("day").isNotNull()).select(
        place, "day", F.lit(None).cast("double").alias("value"))
    days = (
        series.select(place, "day", F.col("value").cast("double"))
        .unionByName(wanted)
        # first non-missing: the series has one value per day, the wanted rows have none
        .groupBy(place, "day").agg(F.max("value").alias("value"))
        .withColumn("day_no", F.unix_date("day"))
    )
    measures: dict[str, Column] = {}
    for n in lengths:
        frame = Window.partitionBy(place).orderBy("day_no").rangeBetween(-n, -1)
        high = F.when(F.col("value") > above, 1).when(F.col("value").isNotNull(), 0)
        measures |= {
            f"sum_{n}d": F.sum("value").over(frame),
            f"mean_{n}d": F.avg("value").over(frame),
            f"max_{n}d": F.max("value").over(frame),
            f"min_{n}d": F.min("value").over(frame),
            f"median_{n}d": _middle(F.sort_array(F.collect_list("value").over(frame))),
            f"days_above_{n}d": F.coalesce(F.sum(high).over(frame), F.lit(0)),
        }
    windows = days.select(place, "day", *[m.alias(n) for n, m in measures.items()])
    return records.join(windows, [place, "day"], "left").select(key, *measures)
