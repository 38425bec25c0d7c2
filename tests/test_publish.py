"""All copies of a result or none, and prediction files found by pattern."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foldstone.sources import publish as pub
from foldstone.sources import tables

SCHEMA = tables.PREDICTION_SCHEMA


def rows(spark, n, shift=0):
    return spark.createDataFrame([(f"r{i}", i % 2, i / 8 + shift) for i in range(n)], SCHEMA)


def shown(spark, path):
    return sorted(tuple(r) for r in pub.read_published(spark, path, SCHEMA).collect())


def test_copies_are_equal_and_replaced_together(spark, tmp_path):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert pub.published(spark, paths[0]) is None
    with pytest.raises(FileNotFoundError):
        pub.read_published(spark, paths[0], SCHEMA)
    pub.publish(rows(spark, 5), paths)
    assert shown(spark, paths[0]) == shown(spark, paths[1]) == sorted(map(tuple, rows(spark, 5).collect()))
    pub.publish(rows(spark, 3, 1.0), paths)
    assert len(shown(spark, paths[0])) == len(shown(spark, paths[1])) == 3
    assert pub.published(spark, paths[0] + "/") == pub.published(spark, paths[0])
    assert len(pub.prune(spark, paths[0])) == 1 and len(shown(spark, paths[0])) == 3


def test_a_failing_second_write_leaves_no_half_result(spark, tmp_path):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    pub.publish(rows(spark, 5), paths)
    before = [shown(spark, p) for p in paths]

    def fails(df, path):
        if "/b/" in path:
            df.where(F.col("TargetF1") == 0).write.csv(path)  # half of it gets there
            raise OSError("disk full")
        pub.as_csv(df, path)

    with pytest.raises(OSError):
        pub.publish(rows(spark, 9), paths, fails)
    assert [shown(spark, p) for p in paths] == before
    assert len(pub.prune(spark, paths[1])) == 1
    pub.publish(rows(spark, 2), paths)
    assert [len(shown(spark, p)) for p in paths] == [2, 2]


def test_death_between_manifests_shows_the_old_version(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    pub.publish(rows(spark, 5), paths)
    real, made = pub._create, []

    def dies(spark, path, text):
        made.append(path)
        if len(made) == int(os.environ.get("DIES_AT", "2")):
            raise KeyboardInterrupt
        real(spark, path, text)

    for at in ("1", "2", "3"):  # before the first, the second manifest and the commit
        made.clear()
        monkeypatch.setenv("DIES_AT", at)
        monkeypatch.setattr(pub, "_create", dies)
        with pytest.raises(KeyboardInterrupt):
            pub.publish(rows(spark, 7), paths)
        monkeypatch.setattr(pub, "_create", real)
        assert [len(shown(spark, p)) for p in paths] == [5, 5]
    pub.publish(rows(spark, 1), paths)
    assert [len(shown(spark, p)) for p in paths] == [1, 1]


def test_one_computation_serves_all_copies(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = rows(spark, 6).mapInArrow(count, SCHEMA)
    pub.publish(df, [str(tmp_path / x) for x in "abc"])
    assert runs.value == 6


def test_trials_as_published_json(spark, tmp_path):
    trials = spark.createDataFrame([("leafwise", 0.9, {"trees": 6.0})],
                                   "model string, score double, params map<string,double>")
    pub.publish(trials, str(tmp_path / "t"), pub.as_json)
    folder = pub.published(spark, str(tmp_path / "t"))
    found = [json.loads(x) for f in os.listdir(folder) if f.endswith(".json")
             for x in open(os.path.join(folder, f))]
    assert found == [{"model": "leafwise", "score": 0.9, "params": {"trees": 6.0}}]


def test_files_are_scanned_one_by_one_with_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,TargetF1,TargetRAUC\nx,1,0.9\ny,0,0.2\nz,one,0.1\n,1,0.5\nq,1,high\n")
    (tmp_path / "b.csv").write_text("TargetRAUC,ID,TargetF1,note\n0.7,x,1.0,hi\n,y,0,\n")
    (tmp_path / "c.csv").write_text("ID,score\nx,0.4\n")
    (tmp_path / "d.csv").write_text("")
    good, bad = tables.scan_prediction_files(spark, [str(tmp_path / "*.csv")])
    name = lambda r: os.path.basename(r["source"])
    assert sorted((name(r), r["id"], r["label"], r["score"]) for r in good.collect()) == [
        ("a.csv", "x", 1, 0.9), ("a.csv", "y", 0, 0.2), ("b.csv", "x", 1, 0.7), ("b.csv", "y", 0, None)]
    assert sorted((name(r), r["reason"], r["rows"]) for r in bad.collect()) == [
        ("a.csv", "label is no number", 1), ("a.csv", "no id", 1), ("a.csv", "score is no number", 1),
        ("c.csv", "no label column", None), ("d.csv", "no header", None)]
    none, nothing = tables.scan_prediction_files(spark, [str(tmp_path / "x*.csv")])
    assert none.count() == 0 and nothing.count() == 0
