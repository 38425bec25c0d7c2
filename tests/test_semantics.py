"""Missing values, bad input and edge values."""

import math

import pytest
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import features as FE
from foldstone.functions import scalar as S
from foldstone.operators import encode, impute, joins, metrics, profile


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def ages(spark):
    values = [-2.0, -1.0, 0.0, 1.0, 3.0, 5.0, 120.0, 121.0, None]
    return spark.createDataFrame(list(enumerate(values)), "id int, age double")


def test_bins_are_right_closed(ages):
    got = column(ages.withColumn("b", S.bin_code(F.col("age"), K.AGE_EDGES)), "b")
    assert got == [None, None, 0, 1, 2, 3, 8, None, None]


def test_bin_labels(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, 71.0)], "id int, age double")
    got = column(df.withColumn(
        "b", S.bin_label(F.col("age"), K.AGE_BAND_EDGES, K.AGE_BAND_LABELS)), "b")
    assert got == ["<1", "1-5", "70+"]


def test_flags_of_missing_are_zero(ages):
    flags = {n: e for n, e in FE.age_shape(F.col("age")).items() if n.startswith("is_")}
    row = ages.where("age is null").select(*[e.alias(n) for n, e in flags.items()]).first()
    assert set(row.asDict().values()) == {0}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 0.5), (2, None)], "id int, p double")
    assert column(df.withColumn("l", metrics.label_of(F.col("p"))), "l") == [0, 1, 0]


def test_dates(spark):
    text = ["2024-01-01", "2021-01-03", "2020-12-31", "2024-02-29", "xx", None]
    df = spark.createDataFrame(list(enumerate(text)), "id int, d string").withColumn(
        "d", S.parse_date(F.col("d")))
    out = df.select("id", *[e.alias(n) for n, e in FE.calendar(F.col("d")).items()])
    assert column(out, "dayofweek") == [0, 6, 3, 3, None, None]
    assert column(out, "weekofyear") == [1, 53, 53, 9, None, None]
    assert column(out, "dayofyear") == [1, 3, 366, 60, None, None]
    assert column(out, "is_dry_season") == [1, 1, 1, 1, 0, 0]


def test_division_never_raises(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, -1e-5), (2, None, 1.0)],
                               "id int, x double, y double")
    got = column(df.withColumn("r", S.guarded_ratio(F.col("x"), F.col("y"))), "r")
    assert got[0] == pytest.approx(1e5) and got[1:] == [None, None]


def test_half_even(spark):
    df = spark.createDataFrame([(0, 0.125), (1, 0.375), (2, -0.125)], "id int, x double")
    assert column(df.withColumn("r", S.half_even(F.col("x"), 2)), "r") == [0.12, 0.38, -0.12]


def test_place_part(spark):
    df = spark.createDataFrame(list(enumerate(["a", "a, b ,c", "", None, " a"])),
                               "id int, s string")
    assert column(df.withColumn("r", S.place_part(F.col("s"))), "r") == ["a", "b", "", None, " a"]


def test_calibration_functions(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "id int, p double")
    got = column(df.withColumn("q", S.calibrated(F.col("p"), 1.0, 0.0)), "q")
    assert got == pytest.approx([1e-6, 0.5, 1 - 1e-6])


def test_grid_ends_exactly():
    points = S.grid_points(0.5, 2.0, 16)
    assert points[0] == 0.5 and points[-1] == 2.0 and len(points) == 16
    assert points[3] == pytest.approx(0.8)


def test_median_interpolates(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 3.0, 10.0, None])), "id int, x double")
    assert impute.medians(df, ["x"]) == {"x": 2.5}
    row = profile.describe(df, ["x"]).first()
    assert (row["q25"], row["q75"], row["rows"]) == (1.75, 4.75, 4)
    assert row["std"] == pytest.approx(4.0824829)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (1.0, 1, 2.0), (1.0, 1, 3.0)],
                               "a double, target int, b double")
    got = {r["name"]: r["corr"] for r in profile.correlations(df, ["a", "b"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(math.sqrt(0.75))


def test_missing_keys_match_missing_keys(spark):
    a = spark.createDataFrame([(None,), (1,), (1,)], "k int")
    b = spark.createDataFrame([(None,), (None,), (1,), (2,)], "k int")
    got = {r["k"]: r["pairs"] for r in joins.key_matches(a, b, ["k"]).collect()}
    assert got == {None: 2, 1: 2}
    rows = joins.matching_rows(a, b, ["k"]).collect()
    assert sorted((r["k"] or 0, r["matches"]) for r in rows) == [(0, 2), (1, 1), (1, 1)]


def test_groups_drop_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (1, 0)], "k int, target int")
    assert [tuple(r) for r in profile.group_rate(df, ["k"]).collect()] == [(1, 2, 0.5)]


def test_empty_bands_are_listed(spark):
    df = spark.createDataFrame([(0.5, 1), (71.0, 0)], "age double, target int")
    rows = profile.banded_rate(df, "age", K.AGE_BAND_EDGES, K.AGE_BAND_LABELS).orderBy(
        "band").collect()
    assert [r["rows"] for r in rows] == [1, 0, 0, 0, 0, 0, 1]
    assert rows[1]["rate"] is None


def test_codes_of_missing_are_minus_one(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "id int, c string")
    assert column(encode.with_category_code(df, "c", "code"), "code") == [1, -1, 0, 1]


def test_enrichment_keeps_left_columns(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "record_id int, deathdate string")
    right = spark.createDataFrame([(1, "z", 5)], "record_id int, deathdate string, rain int")
    rows = joins.enrich(left, right).orderBy("record_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 5), (2, "b", None)]


def test_histogram_of_one_value_and_missing(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [tuple(r) for r in profile.histogram(df, "x", 4).collect()] == [(0, 2)]


def test_mode_smallest_wins_ties_and_fills(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert [r["c"] for r in impute.mode_impute(df, df, ["c"]).collect()] == ["b", "a", "a"]


def test_wide_flags_refuse_unbounded_columns(spark):
    df = spark.range(2_000).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        impute.one_hot(df, df, "c")


def test_column_choice_by_type(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "record_id int, zone string, age double")
    assert FE.numeric_columns(df) == ["record_id", "age"]
    assert FE.text_columns(df) == ["zone"]
    assert FE.feature_columns(df, exclude=("record_id",)) == ["age"]
