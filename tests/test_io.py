"""Files in, files out, and whole workflows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.functions.features import add_features
from foldstone.operators import folds, verify
from foldstone.plans import tuning, workflow
from foldstone.sources import sinks, tables
from foldstone.workload import fixtures as X

from .conftest import DATA


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.25), (1, 0.5), (3, 0.75)], "record_id int, p double")
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    sinks.write_predictions(sinks.to_predictions(df), paths, single_file=True)
    for path in paths:
        back = tables.read_csv(spark, path, tables.PREDICTION_SCHEMA)
        assert [tuple(r) for r in back.collect()] == [("1", 1, 0.5), ("2", 0, 0.25), ("3", 1, 0.75)]


def test_csv_scan_is_by_name_and_tolerant(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("age,ID,deathdate,extra,latitude\n3,a,2024-01-01,x,NaN\nbad,b,nope,y,1.5\n")
    df = tables.read_csv(spark, str(path), tables.RECORD_SCHEMA)
    assert df.columns == ["age", "ID", "deathdate", "latitude"]
    rows = {r["ID"]: r for r in df.collect()}
    assert rows["a"]["age"] == 3.0 and rows["a"]["latitude"] is None
    assert rows["b"]["age"] is None and rows["b"]["latitude"] == 1.5
    named = tables.with_record_id(df)
    assert "record_id" in named.columns
    out = {r["record_id"]: r["year"] for r in add_features(named).collect()}
    assert out == {"a": 2024, "b": None}


def test_first_existing(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert tables.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).endswith("b")
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "a")])


def test_prediction_sets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,TargetF1,TargetRAUC\nx,1,0.9\ny,0,0.1\n")
    (tmp_path / "b.csv").write_text("TargetRAUC,ID,TargetF1\n0.7,x,1\n")
    (tmp_path / "c.csv").write_text("ID,other\nx,1\n")
    sets = tables.read_prediction_sets(spark, [str(tmp_path / "*.csv")])
    got = {os.path.basename(r["source"]): r for r in
           verify.profile_prediction_sets(sets).collect()}
    assert set(got) == {"a.csv", "b.csv"}
    assert (got["a.csv"]["rows"], got["a.csv"]["positives"]) == (2, 1)
    assert got["b.csv"]["mean_score"] == pytest.approx(0.7)


def test_verification_finds_faults(spark):
    bad = spark.createDataFrame([("a", 1, 0.4), ("b", None, 0.2)],
                                "id string, label int, score double")
    template = spark.createDataFrame([("a", 0, 0.5)], "id string, label int, score double")
    row = verify.verify_predictions(bad, template).first()
    assert row["missing_cells"] == 1 and not row["threshold_ok"] and not row["shape_ok"]


def test_trials_as_json(spark, tmp_path):
    trials = spark.createDataFrame(
        [("leafwise", 0, 0.8, {"trees": 5.0}), ("leafwise", 1, 0.9, {"trees": 6.0})],
        "model string, trial int, score double, params map<string,double>")
    sinks.write_trials(tuning.best_trials(trials), str(tmp_path / "out"))
    found = [json.loads(line) for f in os.listdir(tmp_path / "out") if f.endswith(".json")
             for line in (tmp_path / "out" / f).read_text().splitlines()]
    assert found == [{"model": "leafwise", "score": 0.9, "params": {"trees": 6.0}}]


def test_gate():
    assert sinks.better(0.80, 0.81) == "calibrated"
    assert sinks.better(0.80, 0.80) == "raw" and sinks.better(0.8, None) == "raw"


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUICK = {"leafwise": {"trees": 3, "step": 0.3}, "levelwise": {"trees": 3, "step": 0.3},
         "ordered": {"trees": 3, "step": 0.3}, "extra_trees": {"trees": 5, "depth": 4},
         "perceptron": {"hidden": (4,), "iterations": 5}}


@needs_data
def test_train_blend_calibrate_write(spark, tmp_path):
    train, test, side = X.train(spark, DATA), X.test(spark, DATA), X.enrichment(spark, DATA)
    train, test = train.drop("split"), test.drop("split")
    out = workflow.run(train, test, side, str(tmp_path / "sub"), QUICK, k=2)
    back = tables.read_csv(spark, str(tmp_path / "sub"), tables.PREDICTION_SCHEMA)
    assert back.count() == test.count()
    ids = sinks.prediction_template(test)
    row = verify.verify_predictions(
        back.select(F.col("ID").alias("id"), F.col("TargetF1").alias("label"),
                    F.col("TargetRAUC").alias("score")), ids).first()
    assert row["shape_ok"] and row["threshold_ok"] and row["missing_cells"] == 0
    assert out.score > 0.6 and out.notes["features"] > 80
    assert sum(out.notes["weights"]) == pytest.approx(1.0)


@needs_data
def test_stack_with_pseudo(spark):
    train, test, side = X.train(spark, DATA), X.test(spark, DATA), X.enrichment(spark, DATA)
    out = workflow.stack_with_pseudo(train.drop("split"), test.drop("split"), side, QUICK, k=2,
                                     names=("ordered", "leafwise", "levelwise", "extra_trees", "perceptron"),
                                     second=("ordered", "leafwise", "levelwise"))
    assert out.predictions.count() == test.count() and out.score > 0.5


@needs_data
def test_baseline_report(spark):
    train, side = X.train(spark, DATA).drop("split"), X.enrichment(spark, DATA)
    score, report, _ = workflow.baseline_report(train, side, iterations=30)
    row = score.first()
    assert row["auc"] > 0.6 and np.isclose(row["score"], 0.6 * row["f1"] + 0.4 * row["auc"])
    support = {r["label"]: r["support"] for r in report.collect()}
    fifth = folds.stratified_split(train.select("record_id", "target")).where("part = 'valid'")
    assert sum(support.values()) == fifth.count()
    test = X.test(spark, DATA).drop("split")
    predictions = workflow.baseline_predictions(train, test, side, iterations=10)
    assert verify.verify_predictions(
        predictions, sinks.prediction_template(test)).first()["shape_ok"]
