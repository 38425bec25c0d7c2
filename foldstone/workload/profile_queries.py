"""Profiles, drift and leak audits, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import scalar as S
from foldstone.operators import impute, joins, nearest, neighbour_info, profile
from foldstone.operators.quantiles import exact_quantiles, wide_quantiles
from foldstone.session import checkpoint
from foldstone.sources.tables import table
from foldstone.workload import fixtures as X
from foldstone.workload.feature_queries import PLACE_SQL, _age_case
from foldstone.workload.registry import query, tidy

NEIGHBOUR_DIMS = ("tavg_30d", "rain_sum_30d", "ndvi_30d", "elevation", "slope", "tmax_30d",
                  "tmin_30d")
NUMBERS = ("age", "avg_temperature", "precipitation", "rain_sum_30d", "elevation")


def _melt_sql(columns, source, keep=""):
    return " union all ".join(
        f"select {keep} '{c}' as name, cast({c} as double) as value from {source}"
        for c in columns)


@query("group_rate", X.with_views(
    "select cast(year(d) as int) as year, cast(month(d) as int) as month, age_group, "
    "count(target) as row_count, round(avg(target), 6) as rate, "
    "round(avg(rain_sum_30d), 6) as rain_mean, round(avg(elevation), 6) as elevation_mean "
    f"from (select *, {_age_case('age')} as age_group, try_cast(deathdate as date) as d from enriched "
    "where split = 'train') where age_group is not null group by all", "enriched"))
def group_rate(spark, sf):
    """Record count, target rate and enrichment averages per year, month and age band."""
    df = X.featured(spark, sf).where("split = 'train' and age_group is not null")
    return tidy(df.groupBy("year", "month", "age_group").agg(
        F.count("target").alias("row_count"), F.avg("target").alias("rate"),
        F.avg("rain_sum_30d").alias("rain_mean"), F.avg("elevation").alias("elevation_mean")))


@query("grid_cell_rate", X.with_views(
    "select lat, long, count(*) as row_count, round(avg(target), 6) as rate from (select target, "
    "round_even(latitude * 100e0, 0) / 100e0 as lat, round_even(longitude * 100e0, 0) / 100e0 "
    "as long from train) group by all", "train"))
def grid_cell_rate(spark, sf):
    cells = X.train(spark, sf).select(
        "target", S.half_even(F.col("latitude"), 2).alias("lat"),
        S.half_even(F.col("longitude"), 2).alias("long"))
    return tidy(profile.group_rate(cells, ["lat", "long"]).withColumnRenamed("rows", "row_count"))


@query("repeat_groups", X.with_views(
    f"select deathdate, district, count(*) as row_count, round(avg(target), 6) as rate, "
    f"round(stddev_samp(target), 6) as deviation from (select *, {PLACE_SQL} as district from train) "
    "group by all having count(*) > 1", "train"))
def repeat_groups(spark, sf):
    df = X.train(spark, sf).withColumn("district", S.place_part(F.col("location")))
    return tidy(profile.repeat_groups(df, ["deathdate", "district"])
                .withColumnRenamed("rows", "row_count"))


@query("value_counts", X.with_views(
    "select split, name, value, count(*) as row_count from ("
    "select split, 'zone' as name, zone as value from enriched union all "
    "select split, 'gender', gender from enriched union all "
    "select split, 'hot_days_30d', cast(hot_days_30d as varchar) from enriched) "
    "where value is not null group by all", "enriched"))
def value_counts(spark, sf):
    return profile.value_counts(
        X.enriched(spark, sf), ["zone", "gender", "hot_days_30d"], ["split"]
    ).withColumnRenamed("rows", "row_count")


@query("value_share", X.with_views(
    "select target as value, count(*) as row_count, "
    "round(count(*) / (sum(count(*)) over ()), 6) as share from train group by target", "train"))
def value_share(spark, sf):
    return tidy(profile.value_share(X.train(spark, sf), "target")
                .withColumnRenamed("rows", "row_count"))


@query("period_counts", X.with_views(
    "select split, cast(year(try_cast(deathdate as date)) as int) as year, count(*) as row_count "
    "from records group by all order by split, year", "records"))
def period_counts(spark, sf):
    df = X.records(spark, sf).select("split", F.year(S.parse_date(F.col("deathdate"))).alias("year"))
    return df.groupBy("split", "year").agg(F.count("*").alias("row_count")).orderBy(
        "split", "year")


@query("split_bounds", X.with_views(
    "select split, min(deathdate) as min_deathdate, max(deathdate) as max_deathdate, "
    "round(min(latitude), 6) as min_latitude, round(max(latitude), 6) as max_latitude, "
    "round(min(longitude), 6) as min_longitude, round(max(longitude), 6) as max_longitude "
    "from records group by split", "records"))
def split_bounds(spark, sf):
    return tidy(profile.bounds(
        X.records(spark, sf), ["deathdate", "latitude", "longitude"], ["split"]))


@query("describe_numeric", X.with_views(
    "select split, name, count(value) as row_count, round(avg(value), 6) as mean, "
    "round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, "
    "round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, "
    "round(quantile_cont(value, 0.75), 6) as q75 from melted group by split, name", "enriched",
    melted=_melt_sql(NUMBERS, "enriched", "split,")))
def describe_numeric(spark, sf):
    return tidy(profile.describe(X.enriched(spark, sf), NUMBERS, ["split"])
                .withColumnRenamed("rows", "row_count"))


@query("quantiles_by_rank", (
    "select l_returnflag, name, round(quantile_cont(value, 0.05), 6) as q05, "
    "round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.95), 6) as q95 from ("
    + _melt_sql(("l_extendedprice", "l_quantity", "l_discount"), "lineitem", "l_returnflag,")
    + ") group by all"))
def quantiles_by_rank(spark, sf):
    """The path for large groups: bracket by sketch, rank inside the bracket."""
    found = exact_quantiles(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"],
        [0.05, 0.5, 0.95], ["l_returnflag"])
    return tidy(wide_quantiles(found, {0.05: "q05", 0.5: "q50", 0.95: "q95"}, ["l_returnflag"]))


_MISSING = ("rain_sum_7d", "tavg_30d", "ndvi_90d", "elevation", "slope", "age", "zone")


@query("missing_summary", X.with_views(
    "select name, cast(missing as bigint) as missing from (" + " union all ".join(
        f"select '{c}' as name, count(*) - count({c}) as missing from enriched" for c in _MISSING)
    + ") where missing > 0 order by missing desc, name limit 30", "enriched"))
def missing_summary(spark, sf):
    return profile.missing_summary(X.enriched(spark, sf).select(*_MISSING))


_PROFILED = {"record_id": "bigint", "split": "string", "age": "double", "target": "int",
             "rain_sum_30d": "double", "rain_days_30d": "int", "location": "string"}


@query("table_profile", X.with_views(" union all ".join(
    f"select '{c}' as name, '{t}' as dtype, count(*) as row_count, count({c}) as non_null from enriched"
    for c, t in _PROFILED.items()), "enriched"))
def table_profile(spark, sf):
    return profile.table_profile(X.enriched(spark, sf).select(*_PROFILED)).withColumnRenamed(
        "rows", "row_count")


_CONDITIONS = {
    "age < 1": "age < 1", "age = 0": "age = 0", "age = 1": "age = 1", "age = 2": "age = 2",
    "age = 3": "age = 3", "age = 4": "age = 4", "age >= 5": "age >= 5", "age < 5": "age < 5",
}


@query("conditional_rates", X.with_views(" union all ".join(
    f"select split, '{n}' as name, cast(count(*) filter ({c}) as bigint) as matched, "
    f"round(count(*) filter ({c}) / count(*), 6) as share, "
    f"round(avg(target) filter ({c}), 6) as rate from records group by split"
    for n, c in _CONDITIONS.items()), "records"))
def conditional_rates(spark, sf):
    conditions = {n: F.expr(c) for n, c in _CONDITIONS.items()}
    return tidy(profile.conditional_rates(X.records(spark, sf), conditions, by=["split"]))


_CORRELATED = ("age", "avg_temperature", "max_temperature", "precipitation", "latitude",
               "longitude", "rain_sum_7d", "rain_sum_30d", "rain_sum_90d", "rain_days_30d",
               "max_daily_rain_30d", "tavg_7d", "tavg_30d", "tavg_90d", "tmax_30d", "tmin_30d",
               "hot_days_30d", "temp_range_mean_30d", "ndvi_30d", "ndvi_90d", "elevation", "slope",
               "rain_diff_7_30", "target")


@query("target_correlations", X.with_views(
    "select name, round(corr, 6) as corr, 'top' as side from (select * from found order by corr desc, "
    "name limit 10) union all select name, round(corr, 6), 'bottom' from (select * from found "
    "order by corr, name limit 10)", "enriched",
    fitted="select *, rain_sum_7d - rain_sum_30d / 4e0 as rain_diff_7_30 from enriched "
           "where split = 'train'",
    found=" union all ".join(
        f"select '{c}' as name, corr(cast({c} as double), cast(target as double)) as corr from fitted"
        for c in _CORRELATED)))
def target_correlations(spark, sf):
    df = X.enriched(spark, sf).where("split = 'train'").withColumn(
        "rain_diff_7_30", F.expr("rain_sum_7d - rain_sum_30d / 4e0"))
    # One row per column of the table.
    found = profile.correlations(df, _CORRELATED).persist()
    return tidy(profile.ends(found, "corr", 10))


_BANDS = list(zip(K.AGE_BAND_LABELS, K.AGE_BAND_EDGES[:-1], K.AGE_BAND_EDGES[1:], strict=True))


@query("binned_rate", X.with_views(
    "select band, label, count(target) as row_count, round(avg(target), 6) as rate from (values "
    + ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(_BANDS))
    + ") b(band, label, lo, hi) left join train on age > lo and age <= hi group by all", "train"))
def binned_rate(spark, sf):
    return tidy(profile.banded_rate(
        X.train(spark, sf), "age", K.AGE_BAND_EDGES, K.AGE_BAND_LABELS
    ).withColumnRenamed("rows", "row_count"))


@query("histogram", (
    "with lim as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) "
    "select l_returnflag, cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 30e0)), 29) as int) "
    "as bin, count(*) as row_count from lineitem, lim group by all"))
def histogram(spark, sf):
    return profile.histogram(
        table(spark, sf, "lineitem"), "l_extendedprice", 30, ["l_returnflag"]
    ).withColumnRenamed("rows", "row_count")


@query("mutual_information", X.with_views(
    "select name, round(sum(n / t * ln(n * t / (nb * ny))), 6) as mi from (select name, "
    "cast(n as double) n, cast(sum(n) over (partition by name, bin) as double) nb, "
    "cast(sum(n) over (partition by name, y) as double) ny, "
    "cast(sum(n) over (partition by name) as double) t from (select name, y, bin, count(*) n from "
    "(select name, y, case when value is null then -1 when hi = lo then 0 else "
    "least(floor((value - lo) * 10 / (hi - lo)), 9) end as bin from (select *, "
    "min(value) over (partition by name) lo, max(value) over (partition by name) hi from melted)) "
    "group by all)) group by name", "enriched",
    melted=_melt_sql(NUMBERS, "enriched where split = 'train'", "target as y,")))
def mutual_information(spark, sf):
    df = X.enriched(spark, sf).where("split = 'train'")
    return tidy(profile.mutual_information(df, NUMBERS))


_SPREAD = tuple(dict.fromkeys(NUMBERS + NEIGHBOUR_DIMS))


def _neighbours_sql(k: int = 3) -> str:
    """Plain form: sorted rows with the k rows on either side, totals by as-of joins."""
    filled = ", ".join(f"coalesce({c}, median({c}) over ()) as {c}" for c in _SPREAD)
    psi = lambda n: (f"(ln({n} + 8e0) - 1 / (2 * ({n} + 8e0)) - 1 / (12 * ({n} + 8e0) ** 2)"  # noqa: E731
                     f" + 1 / (120 * ({n} + 8e0) ** 4) - 1 / (252 * ({n} + 8e0) ** 6)"
                     + "".join(f" - 1 / ({n} + {j}e0)" for j in range(8)) + ")")
    reach = "least(" + ", ".join(
        f"case when lag(x, {j}) over w is not null and lead(x, {k - j}) over w is not null then "
        f"greatest(x - lag(x, {j}) over w, lead(x, {k - j}) over w - x) end"
        for j in range(k + 1)) + ")"
    return X.with_views(
        f"""select l.name, cast(sum(1) as bigint) as rows, round(greatest(0e0, {psi('count(*)')}
              + avg({psi('least(%d, ny - 1)' % k)}) - avg({psi('ny')})
              - avg({psi('case when r = 0 then same else below - upto end')})), 6) as mi
            from looked l group by l.name""", "enriched",
        filled=f"select record_id, target, {filled} from enriched where split = 'train'",
        long="select name, target as y, x + 0e0 as x from (" + " union all ".join(
            f"select '{c}' as name, target, cast({c} as double) as x from filled" for c in _SPREAD)
        + ") where target is not null",
        near=f"""select name, y, x, count(*) over (partition by name, y) as ny, {reach} as r
                 from long window w as (partition by name, y order by x)""",
        cum="""select name, x, n, sum(n) over (partition by name order by x) as upto from (
                 select name, x, count(*) as n from long group by name, x)""",
        looked="""select p.name, p.ny, p.r, v.n as same, coalesce(b.upto, 0) as below,
                    coalesce(a.upto, 0) as upto
                  from near p join cum v on p.name = v.name and p.x = v.x
                  asof left join cum a on p.name = a.name and p.x - p.r >= a.x
                  asof left join cum b on p.name = b.name and p.x + p.r > b.x""")


@query("neighbour_information", _neighbours_sql())
def neighbour_information(spark, sf):
    """Information with the label by distances to neighbours; missing values are medians."""
    df = X.enriched(spark, sf).where("split = 'train'").select("record_id", "target", *_SPREAD)
    return tidy(neighbour_info.neighbour_information(
        impute.median_impute(df, df, _SPREAD), _SPREAD))


_MEDIANS = ("age", "rain_sum_30d", "tavg_30d", "elevation", "slope")


@query("median_impute", X.with_views(
    "select record_id, " + ", ".join(
        f"round(coalesce({c}, (select median({c}) from enriched where split = 'train')), 6) as {c}"
        for c in _MEDIANS) + " from enriched", "enriched"))
def median_impute(spark, sf):
    df = X.enriched(spark, sf)
    out = impute.median_impute(df.where("split = 'train'"), df, _MEDIANS)
    return tidy(out.select("record_id", *_MEDIANS))


@query("mode_impute", X.with_views(
    "select record_id, coalesce(zone, (select zone from train where zone is not null group by zone "
    "order by count(*) desc, zone limit 1)) as zone, coalesce(season, (select season from seasoned "
    "where split = 'train' and season is not null group by season order by count(*) desc, season "
    "limit 1)) as season from seasoned", "train", "enriched",
    seasoned="select record_id, split, zone, case when rain_days_30d > 6 then 'long' "
             "when rain_days_30d > 2 then 'mid' when rain_days_30d > 0 then 'short' end as season "
             "from enriched"))
def mode_impute(spark, sf):
    season = F.expr("case when rain_days_30d > 6 then 'long' when rain_days_30d > 2 then 'mid' "
                    "when rain_days_30d > 0 then 'short' end")
    df = X.enriched(spark, sf).select("record_id", "split", "zone", season.alias("season"))
    out = impute.mode_impute(df.where("split = 'train'"), df, ["zone", "season"])
    return out.select("record_id", "zone", "season")


@query("one_hot", X.with_views(
    "select record_id, cast(zone = 'Peri-urban' as int) as zone_0, cast(zone = 'Rural' as int) "
    "as zone_1, cast(o_orderpriority = '1-URGENT' as int) as priority_0, "
    "cast(o_orderpriority = '2-HIGH' as int) as priority_1, "
    "cast(o_orderpriority = '3-MEDIUM' as int) as priority_2, "
    "cast(o_orderpriority = '4-NOT SPECIFIED' as int) as priority_3, "
    "cast(o_orderpriority = '5-LOW' as int) as priority_4 "
    "from records join orders on record_id = o_orderkey", "records"))
def one_hot(spark, sf):
    priority = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("priority"))
    df = X.records(spark, sf).select("record_id", "split", "zone").join(priority, "record_id")
    fit = df.where("split = 'train'")
    out = impute.one_hot(fit, impute.one_hot(fit, df, "zone"), "priority")
    return out.drop("split", "zone", "priority")


@query("standardize", X.with_views(
    "select record_id, " + ", ".join(
        f"round(({c} - (select avg({c}) from train)) / (select stddev_pop({c}) from train), 6) as {c}"
        for c in ("age", "avg_temperature", "precipitation")) + " from records", "train"))
def standardize(spark, sf):
    df = X.records(spark, sf)
    columns = ["age", "avg_temperature", "precipitation"]
    out = impute.standardize(df.where("split = 'train'"), df, columns)
    return tidy(out.select("record_id", *columns))


_LEAK_KEYS = ("age", "gender", "deathdate", "latitude", "longitude")
_LEAK_NAMES = ", ".join(_LEAK_KEYS)


@query("exact_match_leak", X.with_views(
    "select age, gender, deathdate, cast(sum(l) as bigint) as left_rows, "
    "cast(sum(r) as bigint) as right_rows, cast(sum(l) * sum(r) as bigint) as pairs, "
    "cast(sum(l * r) as bigint) as exact_pairs from ("
    "select count(*) filter (split = 'train') as l, count(*) filter (split = 'test') as r, "
    f"{_LEAK_NAMES} from records group by {_LEAK_NAMES}) "
    "group by age, gender, deathdate having left_rows > 0 and right_rows > 0", "records"))
def exact_match_leak(spark, sf):
    """Records of both splits that agree in age, gender and date, and how many of their pairs agree
    in place too, which is all five keys; missing keys match missing ones."""
    return joins.key_matches(X.train(spark, sf), X.test(spark, sf), _LEAK_KEYS[:3], _LEAK_KEYS[3:])


@query("match_leak_levels", X.with_views(" union all ".join(
    f"select {n} as keys_used, count(*) as matched, cast(coalesce(sum(l), 0) as bigint) as left_rows, "
    "cast(coalesce(sum(r), 0) as bigint) as right_rows, cast(coalesce(sum(l * r), 0) as bigint) as pairs "
    "from (select count(*) filter (split = 'train') as l, count(*) filter (split = 'test') as r "
    f"from records group by {', '.join(_LEAK_KEYS[:n])} having l > 0 and r > 0)"
    for n in range(1, len(_LEAK_KEYS) + 1)), "records"))
def match_leak_levels(spark, sf):
    """Matches between the splits on ever more of the five keys."""
    return joins.match_levels(X.train(spark, sf), X.test(spark, sf), _LEAK_KEYS)


@query("key_overlap", X.with_views(
    "select (select count(distinct location) from train) as left_distinct, "
    "(select count(distinct location) from test) as right_distinct, "
    "(select count(*) from (select location from train intersect select location from test)) as shared, "
    "round((select count(*) from (select location from train intersect select location from test)) / "
    "(select count(distinct location) from test), 6) as coverage", "train", "test"))
def key_overlap(spark, sf):
    return tidy(joins.overlap(X.train(spark, sf), X.test(spark, sf), ["location"]))


_CELL = ("select distinct round_even(latitude * 100e0, 0) / 100e0 as lat, "
         "round_even(longitude * 100e0, 0) / 100e0 as long from ")


@query("coord_overlap", X.with_views(
    "select (select count(*) from a) as left_distinct, (select count(*) from b) as right_distinct, "
    "(select count(*) from (select * from a intersect select * from b)) as shared, "
    "round((select count(*) from (select * from a intersect select * from b)) / "
    "(select count(*) from b), 6) as coverage", "train", "test", a=_CELL + "train", b=_CELL + "test"))
def coord_overlap(spark, sf):
    def cells(df):
        return df.select(S.half_even(F.col("latitude"), 2).alias("lat"),
                         S.half_even(F.col("longitude"), 2).alias("long"))

    return tidy(joins.overlap(
        cells(X.train(spark, sf)), cells(X.test(spark, sf)), ["lat", "long"]))


@query("shared_locations", X.with_views(
    "select location from train intersect select location from test", "train", "test"))
def shared_locations(spark, sf):
    return X.train(spark, sf).select("location").intersect(X.test(spark, sf).select("location"))


_ZERO = ", ".join(f"coalesce(cast({c} as double), 0) as {c}" for c in NEIGHBOUR_DIMS)
_D2 = " + ".join(f"(q.{c} - p.{c}) * (q.{c} - p.{c})" for c in NEIGHBOUR_DIMS)
_NEAREST = {
    "points": f"select record_id, split, target, {_ZERO} from enriched",
    "nearest": f"select query_id, best.rid as match_id, sqrt(best.d2) as distance from (select "
               f"q.record_id as query_id, min({{'d2': {_D2}, 'rid': p.record_id}}) as best "
               "from points q join points p on q.split = 'test' and p.split = 'train' "
               "group by q.record_id)",
}


def _neighbours(spark, sf):
    # read by each side of the join, and the queries' side twice
    df = checkpoint(X.enriched(spark, sf).select("record_id", "split", *NEIGHBOUR_DIMS))
    return nearest.nearest_join(
        df.where("split = 'test'").withColumnRenamed("record_id", "query_id"),
        df.where("split = 'train'").withColumnRenamed("record_id", "match_id"),
        NEIGHBOUR_DIMS, "query_id", "match_id")


@query("nearest_match", X.with_views(
    "select query_id, match_id, round(distance, 6) as distance from nearest", "enriched",
    **_NEAREST))
def nearest_match(spark, sf):
    return tidy(_neighbours(spark, sf))


@query("exact_vector_match_rate", X.with_views(
    "select target, count(*) as row_count, round(count(*) / (sum(count(*)) over ()), 6) as share "
    "from nearest join points on match_id = record_id where distance = 0 group by target", "enriched",
    **_NEAREST))
def exact_vector_match_rate(spark, sf):
    reference = X.records(spark, sf).select(F.col("record_id").alias("match_id"), "target")
    return tidy(nearest.exact_match_labels(_neighbours(spark, sf), reference, "match_id", "target")
                .withColumnRenamed("rows", "row_count"))


@query("union_splits", X.with_views(
    "select is_train, count(*) as row_count, count(target) as labelled, "
    "cast(sum(target) as bigint) as positives, round(sum(age), 2) as age_sum from ("
    "select 1 as is_train, target, age from train union all "
    "select 0, null, age from test) group by is_train", "train", "test"))
def union_splits(spark, sf):
    both = joins.union_splits(X.train(spark, sf), X.test(spark, sf))
    return both.groupBy("is_train").agg(
        F.count("*").alias("row_count"), F.count("target").alias("labelled"),
        F.sum("target").alias("positives"), F.round(F.sum("age"), 2).alias("age_sum"))


@query("ordered_records", X.with_views(
    "select deathdate, round(latitude, 6) as latitude, round(longitude, 6) as longitude, record_id "
    "from records order by deathdate, latitude, longitude, record_id", "records"))
def ordered_records(spark, sf):
    df = X.records(spark, sf).select("deathdate", "latitude", "longitude", "record_id")
    return tidy(df).orderBy("deathdate", "latitude", "longitude", "record_id")


@query("topk_frequency", X.with_views(
    "select age, count(target) as row_count, round(avg(target), 6) as rate from train group by age "
    "order by row_count desc, age limit 20", "train"))
def topk_frequency(spark, sf):
    rates = profile.group_rate(X.train(spark, sf), ["age"])
    return tidy(rates.orderBy(F.desc("rows"), "age").limit(20).withColumnRenamed(
        "rows", "row_count"))
