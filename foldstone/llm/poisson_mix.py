"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a target share; the mean number of copies of its documents is
``share * size / own rows``.  A document's uniform number is a hash of its id, text and the seed; the
Poisson distribution function with that mean is inverted at it, the document is exploded by the
count, and all copies are dealt to partitions by another hash and sorted by it: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

#: Rates of all sources up to this size are sent to every task.
BROADCAST_BYTES = 8 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5: the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5,
          size: float | None = None, source: str = "source") -> DataFrame:
    """(source, rows, rate, cdf): one row per source; null is a source of its own.

    ``weights`` are target shares in any unit, a source without one gets none; without ``weights``
    the target is rows ** alpha.  ``size`` is the number of rows aimed at (default: as many as
    given).  ``cdf`` holds P(count <= k) up to where it is 1 in doubles.
    """
    known = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        want = F.pow(F.col("rows").cast("double"), F.lit(alpha))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()],
                                      "source string, want double")
        known = known.join(given, known.source.eqNullSafe(given.source), "left").select(
            known.source, "rows", F.coalesce("want", F.lit(0.0)).alias("given"))
        want = F.col("given")
    known = known.select("source", "rows", want.alias("want"))
    whole = known.agg(F.sum("want").alias("wants"), F.sum("rows").alias("all_rows"))
    aim = F.col("all_rows").cast("double") if size is None else F.lit(float(size))
    rate = F.when(F.col("wants") > 0, F.col("want") / F.col("wants") * aim
                  / F.col("rows")).otherwise(F.lit(0.0))
    known = (known.withColumns({c: whole.select(c).scalar() for c in ("wants", "all_rows")})
             .select("source", "rows", rate.alias("rate")))
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 25).cast("int")
    # log P(k) = k log(rate) - rate - log k!, summed from k = 0
    step = F.struct(F.lit(0.0).alias("logp"), F.lit(0.0).alias("sum"),
                    F.array().cast("array<double>").alias("all"))
    safe = F.when(F.col("rate") > 0, F.log("rate")).otherwise(F.lit(0.0))

    def add(acc: Column, k: Column) -> Column:
        logp = F.when(k == 0, -F.col("rate")).otherwise(
            acc["logp"] + safe - F.log(k.cast("double")))
        total = acc["sum"] + F.when((F.col("rate") > 0) | (k == 0), F.exp(logp)).otherwise(0.0)
        return F.struct(logp.alias("logp"), total.alias("sum"),
                        F.concat(acc["all"], F.array(total)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(0), top), step, add, lambda acc: acc["all"])
    return known.select("source", "rows", "rate", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5,
                size: float | None = None, seed: int = 7, id_col: str = "doc_id",
                text_col: str = "text", source: str = "source", copy_col: str = "copy",
                target_rows: int = 0) -> DataFrame:
    """The columns of ``docs`` plus ``copy_col`` (1, 2, ...), each row as often as drawn, shuffled.

    Null ids and texts count as empty in the hash; rows equal in id and text draw the same count;
    an empty table gives an empty one.  Columns of ``docs`` named like internal ones are safe, as
    those live in one struct; a column named ``copy_col`` is replaced.
    """
    kept = [c for c in docs.columns if c != copy_col]
    rate = rates(docs, weights, alpha, size, source).select(
        F.col("source").alias("_r_source"), F.struct("rate", "cdf").alias("_r"))
    text_mark = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    # One row per source.  Measured, it is sent to all tasks and no row is shuffled for it; beyond
    # that size it is an ordinary join, of which Spark can split the hot sources.
    rate = staged(rate)
    size_of = F.size("_r.cdf") * 8 + F.coalesce(F.length("_r_source"), F.lit(0)) * 4 + 64
    if (rate.agg(F.sum(size_of.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        rate = F.broadcast(rate)
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(
        rate, F.col(f"`{source}`").eqNullSafe(F.col("_r_source")))
    u = uniform(F.lit(seed), F.col(id_col), text_mark)
    n = F.size(F.filter(F.col("_r.cdf"), lambda p: p <= u))
    drawn = joined.withColumn("_n", n).filter("_n > 0")
    out = drawn.select(*[F.col(f"`{c}`") for c in kept],
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))
                       .alias(copy_col))
    deal = F.md5(F.concat_ws("|", F.lit(f"deal{seed}"), F.coalesce(
        F.col(id_col).cast("string"), F.lit("")), F.col(copy_col).cast("string")))
    parts = target_rows or partitions(docs.sparkSession)
    return (out.withColumn("_deal", deal).repartition(parts, "_deal")
            .sortWithinPartitions("_deal").drop("_deal"))
