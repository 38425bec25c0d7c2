"""One behaviour at every size, and inputs that used to be read wrongly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import calibrate, folds, impute, nearest, profile
from foldstone.operators.joins import counted
from foldstone.operators.quantiles import exact_quantiles
from foldstone.sources import tables


def test_missing_group_has_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), (None, 4.0), ("a", None)],
                               "k string, x double")
    got = {(r.k, r.prob): r.value for r in exact_quantiles(df, ["x"], [0.5, 0.95], ["k"]).collect()}
    assert got == {(None, 0.5): 2.0, (None, 0.95): pytest.approx(3.8),
                   ("a", 0.5): 5.0, ("a", 0.95): 5.0}
    rows = {r.k: r for r in profile.describe(df, ["x"], ["k"]).collect()}
    assert rows[None].rows == 3 and rows[None]["min"] == 1.0
    assert None not in [rows[None][c] for c in rows[None].asDict() if c != "k"]


def test_quantiles_of_few_and_of_equal_values(spark):
    for values in ([3.0], [1.0, 2.0], list(range(10)), [7.0] * 50, [0.0] * 30 + [1.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
        for r in exact_quantiles(df, ["x"], probs).collect():
            assert r.value == pytest.approx(np.quantile(values, r.prob), abs=1e-12)


def test_grid_of_many_limits(spark):
    grid = spark.range(20_001).select(((F.col("id") - 10_000) / 1000).alias("limit"))
    scores = spark.createDataFrame([(i % 2, (i + 0.5) / 1000) for i in range(1000)],
                                   "y int, p double")
    at = calibrate.counts_by_limit(scores, grid, "y", "p").where("limit = 0").first()
    assert (at.tp, at.fp) == (250, 250)


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1), (nan, 0), (None, 0)],
                               "x double, target int")
    assert {r.bin: r.rows for r in profile.histogram(df, "x", 2).collect()} == {0: 1, 1: 2}
    gone = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    assert profile.mutual_information(df, ["x"]).first().mi == pytest.approx(
        profile.mutual_information(gone, ["x"]).first().mi)
    near = nearest.nearest_join(
        spark.createDataFrame([(1, nan, 0.0)], "q int, a double, b double"),
        spark.createDataFrame([(7, 0.0, 0.0), (8, 5.0, 5.0)], "r int, a double, b double"),
        ["a", "b"], "q", "r").first()
    assert (near.r, near.distance) == (7, 0.0)


def test_sparse_flags_of_many_values(spark):
    fit = spark.range(1500).select(F.format_string("v%04d", "id").alias("c"))
    seen = spark.createDataFrame([("v0003",), ("new",), (None,), ("v1499",)], "c string")
    got = {r.c: (r.c_flags.size, r.c_flags.indices.tolist())
           for r in impute.one_hot_sparse(fit, seen, "c").collect()}
    assert got == {"v0003": (1500, [3]), "new": (1500, []), None: (1500, []), "v1499": (1500, [1499])}
    assert len(impute.categories(fit, "c")) == 1500


def test_broadcast_goes_by_bytes(spark):
    wide = spark.range(2000).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert counted(wide, 100_000)[1] is False
    assert counted(wide.select("id"), 100_000)[1] is True


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,age,zone\nA,1.5,Rural\n")
    (tmp_path / "b.csv").write_text("zone,extra,ID\nUrban,9,B\n")
    got = sorted(map(tuple, tables.read_csv(spark, str(tmp_path), tables.RECORD_SCHEMA).select(
        "ID", "age", "zone").collect()))
    assert got == [("A", 1.5, "Rural"), ("B", None, "Urban")]


def test_group_folds_order_no_more_than_the_distinct_sizes(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("g"), (F.col("id") % 3 == 0).cast("int")
                                  .alias("target"))
    got = folds.group_folds(df, "g", k=5).toPandas()
    dealt = got.sort_values("fold").groupby("fold").size()
    assert dealt.tolist() == [140] * 5 and got["g"].is_unique
    assert got.groupby("fold")["positives"].sum().std() < 3
