"""Plans keep the properties that matter at scale."""

import os

import pytest

from foldstone.functions.features import add_features
from foldstone.sources.tables import RECORD_SCHEMA, with_record_id
from foldstone.workload import fixtures as X

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark):
    text = plan(X.scores(spark, DATA).select("record_id", "p"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_filters_reach_the_scan(spark):
    text = plan(X.records(spark, DATA).where("age > 3").select("record_id"))
    assert "PushedFilters: [" in text and "IsNotNull(o_custkey)" in text


def test_features_are_one_narrow_stage(spark):
    df = add_features(X.records(spark, DATA))
    base = plan(X.records(spark, DATA)).count("Exchange")
    assert plan(df).count("Exchange") == base


def test_features_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "Rural", "Female", "2024-03-01", 2.0, 20.0, 31.0, 15.0, 12.0, 0.5, 32.6,
          "v, d, c", 1)], RECORD_SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD_SCHEMA).parquet(str(tmp_path / "in"))
    out = add_features(with_record_id(stream))
    query = out.writeStream.format("memory").queryName("featured").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    row = spark.table("featured").first()
    assert row["district"] == "d" and row["is_primary_wet_season"] == 1
    assert row["heavy_rain_day"] == 1 and row["age_group"] == 2
    batch = add_features(with_record_id(rows)).first()
    assert batch.asDict() == row.asDict()
