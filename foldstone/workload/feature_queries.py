"""Scans, projections, scalar functions and the feature catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import features as FE
from foldstone.functions import scalar as S
from foldstone.operators import encode, joins, profile
from foldstone.operators.trailing import daily_series, trailing_windows
from foldstone.sources.sinks import prediction_template
from foldstone.sources.tables import table
from foldstone.workload import fixtures as X
from foldstone.workload.registry import query, tidy


def _age_case(x: str) -> str:
    cases = " ".join(f"when {x} > {a} and {x} <= {b} then {i}" for i, (a, b) in enumerate(
        zip(K.AGE_EDGES[:-1], K.AGE_EDGES[1:], strict=True)))
    return f"case {cases} end"


def _flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as int)"


def _guarded(a: str, b: str) -> str:
    return f"case when {b} + 1e-5 <> 0 then {a} / ({b} + 1e-5) end"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) as {name}"


CALENDAR_SQL = {
    "year": "cast(year(d) as int)", "month": "cast(month(d) as int)",
    "day": "cast(day(d) as int)", "dayofweek": "cast(isodow(d) - 1 as int)",
    "dayofyear": "cast(dayofyear(d) as int)", "weekofyear": "cast(weekofyear(d) as int)",
    "quarter": "cast(quarter(d) as int)",
    "sin_month": "round(sin(2 * pi() * month(d) / 12.0), 6)",
    "cos_month": "round(cos(2 * pi() * month(d) / 12.0), 6)",
    "sin_doy": "round(sin(2 * pi() * dayofyear(d) / 365.25), 6)",
    "cos_doy": "round(cos(2 * pi() * dayofyear(d) / 365.25), 6)",
    "is_primary_wet_season": _flag("month(d) in (3, 4, 5)"),
    "is_secondary_wet_season": _flag("month(d) in (9, 10, 11)"),
    "is_dry_season": _flag("month(d) in (1, 2, 6, 7, 8, 12)"),
}
AGE_SQL = {
    "log_age": "round(ln(1 + age), 6)", "sqrt_age": "round(sqrt(age), 6)",
    "age_group": _age_case("age"), "is_age_0": _flag("age = 0"), "is_age_1": _flag("age = 1"),
    "is_age_2": _flag("age = 2"), "is_age_1_to_3": _flag("age in (1, 2, 3)"),
    "is_infant": _flag("age < 1"), "is_toddler": _flag("age >= 1 and age < 5"),
    "is_under_5": _flag("age < 5"), "is_school_age": _flag("age >= 5 and age < 18"),
    "is_adult": _flag("age >= 18 and age < 60"), "is_senior": _flag("age >= 60"),
    "is_elderly": _flag("age >= 65"),
}
FLAG_SQL = {
    "is_rainy_day": _flag("precipitation > 0"), "heavy_rain_day": _flag("precipitation > 10"),
    "high_temp_day": _flag("max_temperature > 30"), "is_highland": _flag("elevation > 1300"),
    "is_lowland": _flag("elevation < 1100"), "gender_female": _flag("gender = 'Female'"),
    "zone_rural": _flag("zone = 'Rural'"),
}
PLACE_SQL = "coalesce(trim(string_split(location, ',')[-2]), location)"
SPATIAL_SQL = {
    "dist_from_center": "round(sqrt((latitude - 0.45) ** 2 + (longitude - 32.5) ** 2), 6)",
    "lat_long_sum": "round(latitude + longitude, 6)",
    "lat_round": "round_even(latitude * 100e0, 0) / 100e0",
    "long_round": "round_even(longitude * 100e0, 0) / 100e0",
    "lat_poly2": "round(latitude * latitude, 6)", "long_poly2": "round(longitude * longitude, 6)",
    "lat_x_long": "round(latitude * longitude, 6)",
    "lat_long_ratio": f"round({_guarded('latitude', 'longitude')}, 6)",
    "slope_elevation_ratio": f"round({_guarded('slope', 'elevation')}, 6)",
    "slope_elev_prod": "round(slope * elevation, 6)",
}
ANOMALY_SQL = {
    "temp_range_recorded": "max_temperature - min_temperature",
    "temp_range_30d": "tmax_30d - tmin_30d",
    "temp_range_anomaly": "max_temperature - min_temperature - temp_range_mean_30d",
    "tmax_diff": "max_temperature - tmax_30d", "tmin_diff": "min_temperature - tmin_30d",
    "tavg_anomaly_30d": "avg_temperature - tavg_30d",
    "tavg_anomaly_7d": "avg_temperature - tavg_7d",
    "tavg_trend_7_30": "tavg_7d - tavg_30d", "tavg_trend_30_90": "tavg_30d - tavg_90d",
    "rain_daily_avg_7d": "rain_sum_7d / 7e0", "rain_daily_avg_30d": "rain_sum_30d / 30e0",
    "rain_daily_avg_90d": "rain_sum_90d / 90e0",
    "rain_day_prop_30d": "rain_days_30d / 30e0",
    "rain_accel_7_30": "rain_sum_7d / 7e0 - rain_sum_30d / 30e0",
    "rain_accel_30_90": "rain_sum_30d / 30e0 - rain_sum_90d / 90e0",
    "rain_diff_7_30": "rain_sum_7d - rain_sum_30d / 4e0",
    "precip_anomaly_30d": "precipitation - rain_sum_30d / 30e0",
    "precip_anomaly_7d": "precipitation - rain_sum_7d / 7e0",
    "ndvi_trend_30_90": "ndvi_30d - ndvi_90d",
    "rain_ratio_7_30": _guarded("rain_sum_7d", "rain_sum_30d"),
    "rain_ratio_30_90": _guarded("rain_sum_30d", "rain_sum_90d"),
    "rain_intensity_30d": _guarded("max_daily_rain_30d", "rain_sum_30d"),
    "ndvi_ratio_30_90": _guarded("ndvi_30d", "ndvi_90d"),
}
_U5, _SENIOR, _INFANT = _flag("age < 5"), _flag("age >= 60"), _flag("age < 1")
INTERACTION_SQL = {
    "under5_x_rain30d": f"{_U5} * rain_sum_30d", "under5_x_tavg30d": f"{_U5} * tavg_30d",
    "under5_x_precip": f"{_U5} * precipitation", "under5_x_ndvi30d": f"{_U5} * ndvi_30d",
    "under5_x_rain_accel": f"{_U5} * ({ANOMALY_SQL['rain_accel_7_30']})",
    "under5_x_rain_ratio": f"{_U5} * ({ANOMALY_SQL['rain_ratio_7_30']})",
    "infant_x_rain_ratio": f"{_INFANT} * ({ANOMALY_SQL['rain_ratio_7_30']})",
    "senior_x_tmax30d": f"{_SENIOR} * tmax_30d",
    "senior_x_tavg_anomaly": f"{_SENIOR} * ({ANOMALY_SQL['tavg_anomaly_30d']})",
    "age_x_tavg30d": "age * tavg_30d", "age_x_rain30d": "age * rain_sum_30d",
    "age_x_ndvi30d": "age * ndvi_30d", "age_x_precip": "age * precipitation",
}


def _columns(table_: dict[str, str], rounded: bool = False) -> str:
    return ", ".join(_r(e, n) if rounded else f"{e} as {n}" for n, e in table_.items())


@query("scan_records", X.with_views(
    "select count(*) as row_count, cast(sum(cast(l_linenumber as bigint)) as bigint) as line_sum, "
    "round(sum(l_extendedprice), 2) as price_sum, min(l_shipdate) as first_ship, "
    "max(l_shipdate) as last_ship, cast(count(distinct l_returnflag) as bigint) as flags "
    "from lineitem"))
def scan_records(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count("*").alias("row_count"), F.sum("l_linenumber").alias("line_sum"),
        F.round(F.sum("l_extendedprice"), 2).alias("price_sum"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.countDistinct("l_returnflag").alias("flags"))


@query("prediction_template", X.with_views(
    "select record_id as id, 0 as label, 0.5e0 as score from test", "test"))
def template(spark, sf):
    return prediction_template(X.test(spark, sf))


@query("enrich_left", X.with_views(
    "select record_id, split, target, round(age, 6) as age, rain_sum_30d, tavg_30d, elevation, "
    "rain_days_30d from enriched", "enriched"))
def enrich_left(spark, sf):
    # The side table also carries the date column that the records have; it is dropped first.
    side = X.enrichment(spark, sf).withColumn("deathdate", F.lit("dropped"))
    out = joins.enrich(X.records(spark, sf), side)
    return tidy(out.select("record_id", "split", "target", "age", "rain_sum_30d", "tavg_30d",
                           "elevation", "rain_days_30d"))


@query("calendar_features", X.with_views(
    f"select record_id, {_columns(CALENDAR_SQL)} "
    "from (select record_id, try_cast(deathdate as date) as d from records)", "records"))
def calendar_features(spark, sf):
    dated = X.records(spark, sf).select(
        "record_id", S.parse_date(F.col("deathdate")).alias("d"))
    parts = FE.calendar(F.col("d"))
    return tidy(dated.select("record_id", *[e.alias(n) for n, e in parts.items()]))


@query("flags_bands", X.with_views(
    f"select record_id, {_columns({k: v for k, v in AGE_SQL.items() if k.startswith('is_')})}, "
    f"{_columns(FLAG_SQL)} from enriched", "enriched"))
def flags_bands(spark, sf):
    df = X.enriched(spark, sf)
    flags = {n: e for n, e in FE.age_shape(F.col("age")).items() if n.startswith("is_")}
    flags |= {n: e for n, (_, e) in FE.weather_flags().items()}
    return df.select("record_id", *[e.alias(n) for n, e in flags.items()])


@query("bin_codes", (
    f"select part_band, quantity_band, count(*) as row_count from (select {_age_case('p_size')} "
    f"as part_band, {_age_case('l_quantity')} as quantity_band "
    "from lineitem join part on l_partkey = p_partkey) group by all"))
def bin_codes(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(
        S.bin_code(F.col("p_size"), K.AGE_EDGES).alias("part_band"),
        S.bin_code(F.col("l_quantity"), K.AGE_EDGES).alias("quantity_band"),
    ).agg(F.count("*").alias("row_count"))


@query("numeric_transforms", (
    "select c_custkey, case when c_acctbal > -1 then round(ln(1 + c_acctbal), 6) end as log_value, "
    "case when c_acctbal >= 0 then round(sqrt(c_acctbal), 6) end as root, "
    "round(c_acctbal * c_acctbal, 2) as square, round(c_acctbal * c_nationkey, 2) as product "
    "from customer"))
def numeric_transforms(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(F.log1p(x), 6).alias("log_value"),
        F.round(F.when(x >= 0, F.sqrt(x)), 6).alias("root"),
        F.round(x * x, 2).alias("square"), F.round(x * F.col("c_nationkey"), 2).alias("product"))


@query("ratio_anomaly", X.with_views(
    f"select record_id, {_columns(ANOMALY_SQL, True)} from enriched", "enriched"))
def ratio_anomaly(spark, sf):
    return tidy(X.featured(spark, sf).select("record_id", *ANOMALY_SQL))


@query("spatial_features", X.with_views(
    f"select record_id, {PLACE_SQL} as district, {_columns(SPATIAL_SQL)} from enriched",
    "enriched"))
def spatial_features(spark, sf):
    return tidy(X.featured(spark, sf).select("record_id", "district", *SPATIAL_SQL))


@query("interactions", X.with_views(
    f"select record_id, {_columns(INTERACTION_SQL, True)} from enriched", "enriched"))
def interactions(spark, sf):
    return tidy(X.featured(spark, sf).select("record_id", *INTERACTION_SQL))


@query("location_part", (
    "select part, count(*) as row_count from (select coalesce(trim(string_split(url, '/')[-2]), url) "
    "as part from pages union all select coalesce(trim(string_split(p_name, ' ')[-2]), p_name) "
    "from part) group by part"))
def location_part(spark, sf):
    urls = table(spark, sf, "pages").select(S.place_part(F.col("url"), "/").alias("part"))
    names = table(spark, sf, "part").select(S.place_part(F.col("p_name"), " ").alias("part"))
    return urls.unionByName(names).groupBy("part").agg(F.count("*").alias("row_count"))


@query("category_codes", X.with_views(
    f"select record_id, coalesce(code, -1) as district_code from (select record_id, {PLACE_SQL} "
    "as district from records) left join codes using (district)", "records",
    codes=f"select district, cast(row_number() over (order by district) - 1 as int) as code "
          f"from (select distinct {PLACE_SQL} as district from records) where district is not null"))
def category_codes(spark, sf):
    places = X.records(spark, sf).select(
        "record_id", S.place_part(F.col("location")).alias("district"))
    return encode.with_category_code(places, "district", "district_code").select(
        "record_id", "district_code")


_FEATURE_SQL = {**CALENDAR_SQL, **AGE_SQL, **FLAG_SQL, **SPATIAL_SQL,
                **{n: f"round({e}, 6)" for n, e in {**ANOMALY_SQL, **INTERACTION_SQL}.items()}}


@query("feature_matrix", X.with_views(
    f"select record_id, split, {PLACE_SQL} as district, {_columns(_FEATURE_SQL)} "
    "from (select *, try_cast(deathdate as date) as d from enriched)", "enriched"))
def feature_matrix(spark, sf):
    return tidy(X.featured(spark, sf).select("record_id", "split", "district", *_FEATURE_SQL))


def _context_sql() -> str:
    out = []
    for g in FE.CONTEXT_GROUPS:
        for m in FE.CONTEXT_MEASURES:
            mean = f"case when {g} is not null then avg({m}) over (partition by {g}) end"
            out += [_r(mean, f"{m}_mean_by_{g}"), _r(f"{m} - {mean}", f"{m}_diff_from_{g}_mean"),
                    _r(f"case when {g} is not null then stddev_samp({m}) over (partition by {g}) end",
                       f"{m}_std_by_{g}")]
    return ", ".join(out)


@query("group_deviation", X.with_views(
    f"select record_id, {_context_sql()} from (select *, {PLACE_SQL} as district, "
    f"month(try_cast(deathdate as date)) as month, {_age_case('age')} as age_group from enriched)",
    "enriched"))
def group_deviation(spark, sf):
    df = X.featured(spark, sf).select("record_id", *FE.CONTEXT_GROUPS, *FE.CONTEXT_MEASURES)
    out = profile.group_context(df, FE.CONTEXT_GROUPS, FE.CONTEXT_MEASURES, with_std=True)
    return tidy(out.drop(*FE.CONTEXT_GROUPS, *FE.CONTEXT_MEASURES))


_SERIES = ("select c_nationkey as place, cast(l_shipdate as date) as day, sum(l_quantity) as value "
           "from lineitem join orders on l_orderkey = o_orderkey join customer "
           "on o_custkey = c_custkey group by all")
_PLACED = ("select o_orderkey as record_id, c_nationkey as place, cast(o_orderdate as date) as day "
           "from orders join customer on o_custkey = c_custkey")


def _window_sql(n: int) -> str:
    hit = f"s.day >= r.day - {n}"
    return (f"round(sum(value) filter ({hit}), 6) as sum_{n}d, "
            f"round(avg(value) filter ({hit}), 6) as mean_{n}d, "
            f"max(value) filter ({hit}) as max_{n}d, min(value) filter ({hit}) as min_{n}d, "
            f"round(median(value) filter ({hit}), 6) as median_{n}d, "
            f"cast(count(*) filter ({hit} and value > 1) as bigint) as days_above_{n}d")


@query("trailing_windows", X.with_views(
    f"select record_id, {', '.join(_window_sql(n) for n in K.TRAILING_DAYS)} "
    "from placed r left join series s on s.place = r.place and s.day < r.day "
    f"and s.day >= r.day - {max(K.TRAILING_DAYS)} group by record_id",
    series=_SERIES, placed=_PLACED))
def trailing(spark, sf):
    series = daily_series(X.place_readings(spark, sf), "place", "ts", "amount")
    return tidy(trailing_windows(X.placed_records(spark, sf), series, "place", "day"))
