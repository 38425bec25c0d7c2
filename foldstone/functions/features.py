"""Catalogue of derived features, as tables of (name -> inputs) turned into projections.

Everything here is row-local: one narrow stage, no shuffle, valid on batch and streaming frames.
A feature is added only when its inputs exist, so partial schemas are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import scalar as S

# --- fixed values: names and inputs of the features ----------------------------------------
DIFFERENCES = {
    "temp_range_recorded": ("max_temperature", "min_temperature"),
    "temp_range_30d": ("tmax_30d", "tmin_30d"),
    "temp_range_anomaly": ("temp_range_recorded", "temp_range_mean_30d"),
    "tmax_diff": ("max_temperature", "tmax_30d"),
    "tmin_diff": ("min_temperature", "tmin_30d"),
    "tavg_anomaly_30d": ("avg_temperature", "tavg_30d"),
    "tavg_anomaly_7d": ("avg_temperature", "tavg_7d"),
    "tavg_trend_7_30": ("tavg_7d", "tavg_30d"),
    "tavg_trend_30_90": ("tavg_30d", "tavg_90d"),
    "rain_accel_7_30": ("rain_daily_avg_7d", "rain_daily_avg_30d"),
    "rain_accel_30_90": ("rain_daily_avg_30d", "rain_daily_avg_90d"),
    "rain_diff_7_30": ("rain_sum_7d", "rain_weekly_avg_30d"),
    "precip_anomaly_30d": ("precipitation", "rain_daily_avg_30d"),
    "precip_anomaly_7d": ("precipitation", "rain_daily_avg_7d"),
    "ndvi_trend_30_90": ("ndvi_30d", "ndvi_90d"),
}
SCALED = {
    "rain_daily_avg_7d": ("rain_sum_7d", 7.0),
    "rain_daily_avg_30d": ("rain_sum_30d", 30.0),
    "rain_daily_avg_90d": ("rain_sum_90d", 90.0),
    "rain_weekly_avg_30d": ("rain_sum_30d", 4.0),
    "rain_day_prop_30d": ("rain_days_30d", 30.0),
}
RATIOS = {
    "slope_elevation_ratio": ("slope", "elevation"),
    "lat_long_ratio": ("latitude", "longitude"),
    "rain_ratio_7_30": ("rain_sum_7d", "rain_sum_30d"),
    "rain_ratio_30_90": ("rain_sum_30d", "rain_sum_90d"),
    "rain_intensity_30d": ("max_daily_rain_30d", "rain_sum_30d"),
    "ndvi_ratio_30_90": ("ndvi_30d", "ndvi_90d"),
}
PRODUCTS = {
    "lat_poly2": ("latitude", "latitude"),
    "long_poly2": ("longitude", "longitude"),
    "lat_x_long": ("latitude", "longitude"),
    "slope_elev_prod": ("slope", "elevation"),
    "under5_x_rain30d": ("is_under_5", "rain_sum_30d"),
    "under5_x_tavg30d": ("is_under_5", "tavg_30d"),
    "under5_x_precip": ("is_under_5", "precipitation"),
    "under5_x_ndvi30d": ("is_under_5", "ndvi_30d"),
    "under5_x_rain_accel": ("is_under_5", "rain_accel_7_30"),
    "under5_x_rain_ratio": ("is_under_5", "rain_ratio_7_30"),
    "infant_x_rain_ratio": ("is_infant", "rain_ratio_7_30"),
    "senior_x_tmax30d": ("is_senior", "tmax_30d"),
    "senior_x_tavg_anomaly": ("is_senior", "tavg_anomaly_30d"),
    "age_x_tavg30d": ("age", "tavg_30d"),
    "age_x_rain30d": ("age", "rain_sum_30d"),
    "age_x_ndvi30d": ("age", "ndvi_30d"),
    "age_x_precip": ("age", "precipitation"),
}
CONTEXT_MEASURES = ("avg_temperature", "precipitation", "rain_sum_30d", "tavg_30d", "ndvi_30d")
CONTEXT_GROUPS = ("zone", "district", "month", "age_group")
# --- end of fixed values -------------------------------------------------------------------

RAW_COLUMNS = ("hot_days_30d", "location", "district", "gender", "zone", "deathdate", "event_date")


def calendar(date: Column) -> dict[str, Column]:
    """Calendar parts, cycle positions and season flags of a date column."""
    month = F.month(date)
    sin_month, cos_month = S.cycle(month, K.MONTHS_PER_CYCLE)
    sin_doy, cos_doy = S.cycle(F.dayofyear(date), K.DAYS_PER_CYCLE)
    return {
        "year": F.year(date),
        "month": month,
        "day": F.dayofmonth(date),
        "dayofweek": F.weekday(date),
        "dayofyear": F.dayofyear(date),
        "weekofyear": F.weekofyear(date),
        "quarter": F.quarter(date),
        "sin_month": sin_month,
        "cos_month": cos_month,
        "sin_doy": sin_doy,
        "cos_doy": cos_doy,
        "is_primary_wet_season": S.flag(month.isin(*K.FIRST_WET_MONTHS)),
        "is_secondary_wet_season": S.flag(month.isin(*K.SECOND_WET_MONTHS)),
        "is_dry_season": S.flag(month.isin(*K.DRY_MONTHS)),
    }


def age_shape(age: Column) -> dict[str, Column]:
    """Transforms, stage-of-life flags and the nine-band code of an age in years."""
    return {
        "log_age": F.log1p(age),
        "sqrt_age": F.sqrt(age),
        "age_group": S.bin_code(age, K.AGE_EDGES),
        "is_age_0": S.flag(age == 0),
        "is_age_1": S.flag(age == 1),
        "is_age_2": S.flag(age == 2),
        "is_age_1_to_3": S.flag(age.isin(1, 2, 3)),
        "is_infant": S.flag(age < 1),
        "is_toddler": S.flag((age >= 1) & (age < 5)),
        "is_under_5": S.flag(age < 5),
        "is_school_age": S.flag((age >= 5) & (age < 18)),
        "is_adult": S.flag((age >= 18) & (age < 60)),
        "is_senior": S.flag(age >= 60),
        "is_elderly": S.flag(age >= 65),
    }


def weather_flags() -> dict[str, tuple[str, Column]]:
    """Flag name -> (input column, expression)."""
    c = F.col
    return {
        "is_rainy_day": ("precipitation", S.flag(c("precipitation") > 0)),
        "heavy_rain_day": ("precipitation", S.flag(c("precipitation") > K.HEAVY_RAIN_ABOVE)),
        "high_temp_day": ("max_temperature", S.flag(c("max_temperature") > K.HOT_DAY_ABOVE)),
        "is_highland": ("elevation", S.flag(c("elevation") > K.HIGHLAND_ABOVE)),
        "is_lowland": ("elevation", S.flag(c("elevation") < K.LOWLAND_BELOW)),
        "gender_female": ("gender", S.flag(c("gender") == "Female")),
        "zone_rural": ("zone", S.flag(c("zone") == "Rural")),
    }


def _available(df: DataFrame, table: dict[str, tuple], build) -> DataFrame:
    known = set(df.columns)
    return df.withColumns({
        name: build(*args)
        for name, args in table.items()
        if all(a in known for a in args if isinstance(a, str))
    })


def add_features(df: DataFrame) -> DataFrame:
    """All row-local features of the catalogue whose inputs are present."""
    columns = set(df.columns)
    if "deathdate" in columns:
        df = df.withColumn("event_date", S.parse_date(F.col("deathdate")))
        df = df.withColumns(calendar(F.col("event_date")))
    if "age" in columns:
        df = df.withColumns(age_shape(F.col("age")))
    if "location" in columns:
        df = df.withColumn("district", S.place_part(F.col("location")))
    if {"latitude", "longitude"} <= columns:
        df = df.withColumns({
            "dist_from_center": S.distance(
                F.col("latitude"), F.col("longitude"), K.CENTRE_LATITUDE, K.CENTRE_LONGITUDE),
            "lat_long_sum": F.col("latitude") + F.col("longitude"),
            "lat_round": S.half_even(F.col("latitude"), 2),
            "long_round": S.half_even(F.col("longitude"), 2),
        })
    df = df.withColumns({n: e for n, (c, e) in weather_flags().items() if c in columns})
    df = _available(df, SCALED, lambda a, by: F.col(a) / F.lit(by))
    subtract = lambda a, b: F.col(a) - F.col(b)
    first = {n: t for n, t in DIFFERENCES.items() if not set(t) & set(DIFFERENCES)}
    later = {n: t for n, t in DIFFERENCES.items() if n not in first}
    df = _available(df, first, subtract)
    df = _available(df, later, subtract)
    df = _available(df, RATIOS, lambda a, b: S.guarded_ratio(F.col(a), F.col(b)))
    return _available(df, PRODUCTS, lambda a, b: F.col(a) * F.col(b))


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither raw text, keys nor listed in ``exclude``."""
    skip = set(RAW_COLUMNS) | set(exclude)
    return [c for c in numeric_columns(df) if c not in skip]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]
