"""Counts, rates, summaries and drift views of a record table.

Each view is one pass with partial aggregation; nothing but aggregates moves between executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.functions import scalar as S
from foldstone.operators.joins import counted, lookup_join
from foldstone.operators.quantiles import exact_quantiles, melt, wide_quantiles

QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def group_rate(df: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Rows and mean target per key; rows with a missing key are left out."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(target).alias("rows"), F.avg(target).alias("rate"))


def repeat_groups(df: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Groups with more than one row: rows, mean and sample deviation of the target."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(target).alias("rows"), F.avg(target).alias("rate"),
        F.stddev_samp(target).alias("deviation")).where("rows > 1")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, value, rows) for several columns in one scan; missing values left out."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(*by, F.inline(cells)).where("value is not null")
        .groupBy(*by, "name", "value").agg(F.count("*").alias("rows"))
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """(value, rows, share of all non-missing rows)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("rows"))
    total = df.agg(F.count(column)).scalar()
    return counts.withColumn("share", F.try_divide("rows", total))


def bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column per group."""
    return df.groupBy(*by).agg(*[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name) with count, mean, std, min, exact quartiles and max."""
    keys = [*by, "name"]
    basic = melt(df, columns, by).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quartiles = wide_quantiles(exact_quantiles(df, columns, list(QUARTILES), by), QUARTILES, by)
    return lookup_join(basic, quartiles, keys, null_safe=True)


def missing_summary(df: DataFrame, top: int = 30) -> DataFrame:
    """Columns with missing cells, most first: (name, missing)."""
    return (
        _per_column(df, lambda c: F.sum(F.col(c).isNull().cast("bigint")), "missing")
        .drop("rows").where("missing > 0").orderBy(F.desc("missing"), "name").limit(top)
    )


def table_profile(df: DataFrame) -> DataFrame:
    """(name, dtype, rows, non_null) per column from one pass."""
    kinds = dict(df.dtypes)
    dtype = F.create_map(*[F.lit(v) for c in df.columns for v in (c, kinds[c])])
    out = _per_column(df, lambda c: F.count(F.col(c)), "non_null", F.count("*"))
    return out.select("name", dtype[F.col("name")].alias("dtype"), "rows", "non_null")


def _per_column(df: DataFrame, measure, name: str, rows: Column | None = None) -> DataFrame:
    rows = F.lit(0) if rows is None else rows
    wide = df.agg(rows.alias("rows"), *[measure(c).alias(f"m{i}")
                                        for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias(name))
                      for i, c in enumerate(df.columns)])
    return wide.select("rows", F.inline(cells))


def conditional_rates(
    df: DataFrame, conditions: Mapping[str, Column], target: str = "target",
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., name, matched, share, rate): how many rows meet each condition and their mean
    target, all conditions in one pass."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    measures = []
    for i, c in enumerate(held.values()):
        measures += [F.count_if(c).alias(f"n{i}"), F.avg(F.when(c, F.col(target))).alias(f"r{i}")]
    wide = df.groupBy(*by).agg(F.count("*").alias("__rows"), *measures)
    cells = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("matched"),
                 F.try_divide(F.col(f"n{i}"), F.col("__rows")).alias("share"),
                 F.col(f"r{i}").alias("rate")) for i, n in enumerate(held)])
    return wide.select(*by, F.inline(cells))


def correlations(df: DataFrame, columns: Sequence[str], target: str = "target") -> DataFrame:
    """(name, corr): Pearson on rows where both are known; NULL for a constant column."""
    y = F.col(target).cast("double")
    measures = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
        measures.append(F.try_divide(F.covar_samp(x, y), spread).alias(f"c{i}"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("corr"))
                      for i, c in enumerate(columns)])
    return df.agg(*measures).select(F.inline(cells))


def ends(df: DataFrame, measure: str, k: int, name: str = "name") -> DataFrame:
    """The k largest and k smallest rows by a measure, tagged ``top`` / ``bottom``."""
    known = df.where(F.col(measure).isNotNull())
    top = known.orderBy(F.desc(measure), name).limit(k).withColumn("side", F.lit("top"))
    low = known.orderBy(F.asc(measure), name).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def banded_rate(
    df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str],
    target: str = "target",
) -> DataFrame:
    """(band, label, rows, rate) for every band, also those without rows."""
    rates = df.withColumn("band", S.bin_code(F.col(column), edges)).where(
        "band is not null").groupBy("band").agg(
        F.count(target).alias("rows"), F.avg(target).alias("rate"))
    bands = df.sparkSession.createDataFrame(list(enumerate(labels)), "band int, label string")
    # One row per band on both sides.
    return bands.join(F.broadcast(rates), "band", "left").fillna({"rows": 0})


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the column's own bounds: (by..., bin, rows), last bin closed.

    NaN is missing.
    """
    x = S.present(F.col(column).cast("double"))
    limits = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    placed = df.where(x.isNotNull()).select(*by, x.alias("x"), limits.alias("lim"))
    width = (F.col("lim.hi") - F.col("lim.lo")) / F.lit(float(bins))
    index = F.floor(F.try_divide(F.col("x") - F.col("lim.lo"), width))
    last = F.when(index < bins, index).otherwise(F.lit(bins - 1))
    slot = F.when(index.isNull(), F.lit(0)).otherwise(last)  # no width: one value
    return placed.select(*by, slot.cast("int").alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("rows"))


def group_context(
    df: DataFrame, groups: Sequence[str], measures: Sequence[str], with_std: bool = False
) -> DataFrame:
    """Add each measure's group mean and the row's deviation from it, for several groupings.

    Few groups hold very many rows, so a window would sort a third of the table in one task.
    Instead all groupings are averaged in one scan and looked up from the small result.
    """
    stats = [F.avg(m).alias(f"mean_{m}") for m in measures]
    if with_std:
        stats += [F.stddev_samp(m).alias(f"std_{m}") for m in measures]
    table, small = counted(df.groupingSets([[g] for g in groups], *groups).agg(
        F.grouping_id().alias("__set"), *stats))
    full = 2 ** len(groups) - 1
    for i, g in enumerate(groups):
        own = full - 2 ** (len(groups) - 1 - i)
        names = [F.col(f"mean_{m}").alias(f"{m}_mean_by_{g}") for m in measures]
        if with_std:
            names += [F.col(f"std_{m}").alias(f"{m}_std_by_{g}") for m in measures]
        part = table.where((F.col("__set") == own) & F.col(g).isNotNull()).select(g, *names)
        df = lookup_join(df, part, [g], small=small).withColumns({
            f"{m}_diff_from_{g}_mean": F.col(m) - F.col(f"{m}_mean_by_{g}") for m in measures})
    return df


def mutual_information(
    df: DataFrame, columns: Sequence[str], target: str = "target", bins: int = 10
) -> DataFrame:
    """(name, mi): mutual information in nats of equal-width bins of each column with a label.

    Missing values form a bin of their own.
    """
    columns = list(columns)
    limits = df.agg(*[f(S.present(F.col(c).cast("double"))).alias(f"{n}{i}")
                      for i, c in enumerate(columns)
                      for n, f in (("lo", F.min), ("hi", F.max))])
    box = limits.select(F.struct(*limits.columns)).scalar()
    boxed = df.where(F.col(target).isNotNull()).withColumn("__box", box)

    def code(i: int, c: str) -> Column:
        lo, hi = F.col(f"__box.lo{i}"), F.col(f"__box.hi{i}")
        x = S.present(F.col(c).cast("double"))
        at = F.floor(F.try_divide((x - lo) * bins, hi - lo))
        return (F.when(x.isNull(), F.lit(-1)).when(at.isNull(), F.lit(0))
                .when(at < bins, at).otherwise(F.lit(bins - 1)))

    cells = F.array(*[F.struct(F.lit(c).alias("name"), code(i, c).cast("int").alias("bin"))
                      for i, c in enumerate(columns)])
    joint = boxed.select(F.col(target).alias("y"), F.inline(cells)).groupBy(
        "name", "bin", "y").agg(F.count("*").alias("n"))
    # From here on at most columns x (bins + 1) x labels rows.
    per_bin = F.sum("n").over(Window.partitionBy("name", "bin"))
    per_y = F.sum("n").over(Window.partitionBy("name", "y"))
    total = F.sum("n").over(Window.partitionBy("name"))
    term = joint.select("name", "n", per_bin.alias("nb"), per_y.alias("ny"), total.alias("t"))
    share = F.col("n") / F.col("t")
    odds = F.col("n").cast("double") * F.col("t") / (F.col("nb").cast("double") * F.col("ny"))
    return term.groupBy("name").agg(F.sum(share * F.ln(odds)).alias("mi"))
