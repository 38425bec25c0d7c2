"""Restartable grids of fits, and the jobs made of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldstone.operators import folds, metrics, pseudo
from foldstone.plans import models, tuning, workflow
from foldstone.plans.grid import Grid, fingerprint
from foldstone.plans.pseudo_study import threshold_refits

FEATURES = ["f1", "f2", "f3"]
SMALL = {"trees": 4, "step": 0.3, "rows": 1.0, "features": "all"}  # nothing drawn at random


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(600, 3)), columns=FEATURES)
    odds = 2.5 * pdf["f1"] + 1.5 * pdf["f2"]
    pdf["target"] = (rng.random(600) < 1 / (1 + np.exp(-odds))).astype(int)
    pdf["record_id"] = np.arange(600)
    df = spark.createDataFrame(pdf).withColumn("f3", F.when(F.col("f3") < 1.5, F.col("f3")))
    train = folds.stratified_folds(df.where("record_id < 400"), k=2).persist()
    return train, df.where("record_id >= 400").drop("target").persist()


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_missing_cells_are_made_and_others_read(spark, tmp_path):
    made = []

    def cell(n, fails=False):
        def make():
            made.append(n)
            if fails:
                raise RuntimeError("lost")
            return spark.range(n)
        return make

    first = Grid(spark, str(tmp_path), ["a"], workers=2)
    with pytest.raises(RuntimeError):
        first.run({"x/n=1": cell(1), "x/n=2": cell(2, True), "x/n=3": cell(3)})
    assert first.done("x/n=1") and first.done("x/n=3") and not first.done("x/n=2")
    again = Grid(spark, str(tmp_path), ["a"])
    assert again.run({"x/n=1": cell(1), "x/n=2": cell(2), "x/n=3": cell(3)}) == ["x/n=2"]
    assert made.count(1) == 1 and made.count(2) == 2
    assert again.read(["x/n=1", "x/n=2", "x/n=3"]).count() == 6
    assert not Grid(spark, str(tmp_path), ["b"]).done("x/n=1")  # other inputs, other cells
    with pytest.raises(ValueError):
        again.path("no such/../../key!")


def test_half_written_cell_is_made_again(spark, tmp_path):
    grid = Grid(spark, str(tmp_path), ["a"])
    spark.range(5).write.parquet(grid.path("x"))
    (tmp_path / grid.folder.rsplit("/", 1)[1] / "x" / "_SUCCESS").unlink()
    assert grid.run({"x": lambda: spark.range(7)}) == ["x"]
    assert grid.read(["x"]).count() == 7


def test_fingerprints_tell_rows_and_columns(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("id")).repartition(3))
    others = [df.where("id < 9"), df.union(df.limit(1)), df.withColumnRenamed("x", "y"),
              df.withColumn("x", F.when(F.col("id") > 3, "a")), df.where("id < 0")]
    assert len({fingerprint(o) for o in [df, *others]}) == 6


def test_threshold_refits_equal_fits_one_by_one(planted):
    train, test = planted
    preset = models.PRESETS["leafwise"].with_settings(**SMALL)
    got = {r["threshold"]: r for r in threshold_refits(
        train, test, FEATURES, "leafwise", preset, (0.2, 0.3), k=2).collect()}
    assert sorted(got) == [0.0, 0.2, 0.3]
    admitted = {0.0: [], 0.2: [], 0.3: []}
    scores = {t: [] for t in admitted}
    for f in range(2):
        own = pseudo.fold_complement(train, f)
        prepare = models.preparation(own, FEATURES)
        held, other = prepare(train.where(F.col("fold") == f)), prepare(test)
        base = models.fit(prepare(own), FEATURES, preset)
        unlabelled = models.score(base, other, FEATURES)
        for t in admitted:
            fitted = base
            if t:
                picked = pseudo.select_confident(unlabelled, t, 1 - t).withColumn(
                    "target", F.col("pseudo_label").cast("long"))
                admitted[t].append(picked.count())
                both = prepare(own).select("record_id", "target", *FEATURES).unionByName(
                    picked.select("record_id", "target", *FEATURES))
                fitted = models.fit(both, FEATURES, preset)
            scores[t] += [(r["target"], r["p"]) for r in models.score(
                fitted, held, FEATURES).select("target", "p").collect()]
    for t in admitted:
        assert got[t]["admitted"] == pytest.approx(np.mean(admitted[t] or [0]))
        plain = metrics.score_metrics(train.sparkSession.createDataFrame(
            scores[t], "target long, p double")).first()
        # sums in another order may move a split by a hair
        assert got[t]["f1"] == pytest.approx(plain["f1"], abs=0.01)
        assert got[t]["auc"] == pytest.approx(plain["auc"], abs=0.01)
    assert got[0.3]["admitted"] > got[0.2]["admitted"] > 0 and got[0.0]["score"] > 0.7


def test_interrupted_study_goes_on(planted, tmp_path, monkeypatch):
    train, test = planted
    preset = models.PRESETS["leafwise"].with_settings(**SMALL)
    args = (train, test, FEATURES, "leafwise", preset, (0.2,))
    from foldstone.plans import pseudo_study

    fits, real = [], pseudo_study.fit

    def dies(*a, **kw):
        fits.append(1)
        if len(fits) > 3:
            raise KeyboardInterrupt
        return real(*a, **kw)

    monkeypatch.setattr(pseudo_study, "fit", dies)
    with pytest.raises(KeyboardInterrupt):
        threshold_refits(*args, k=2, folder=str(tmp_path), workers=1)
    monkeypatch.setattr(pseudo_study, "fit", lambda *a, **kw: fits.append(1) or real(*a, **kw))
    before = len(fits)
    out = rows_of(threshold_refits(*args, k=2, folder=str(tmp_path)))
    assert 0 < len(fits) - before <= 1 and len(out) == 2
    assert rows_of(threshold_refits(*args, k=2, folder=str(tmp_path))) == out


def test_bag_is_resumed_with_equal_rows(planted, tmp_path, monkeypatch):
    train, test = planted
    quick = {"leafwise": SMALL, "forest": {"trees": 4, "depth": 3}}
    bag = lambda: workflow.bag_seeds(
        train, test, FEATURES, {"leafwise": 0.6, "forest": 0.4}, seeds=(1, 2), k=2,
        overrides=quick, folder=str(tmp_path), workers=2)
    real, calls = models.filled_fold_scores, []

    def dies(*a, **kw):
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("killed")
        return real(*a, **kw)

    monkeypatch.setattr(models, "filled_fold_scores", dies)
    with pytest.raises(RuntimeError):
        bag()
    monkeypatch.setattr(models, "filled_fold_scores", lambda *a, **kw: calls.append(1) or real(*a, **kw))
    before = len(calls)
    out = rows_of(bag())
    assert len(calls) - before == 1 and len(out) == 600
    assert rows_of(bag()) == out and len(calls) - before == 1


def test_rungs_end_losers_early_and_agree_with_the_full_search(planted, tmp_path):
    train, _ = planted
    assert tuning.rungs(10, 2) == [2, 4, 8, 10] and tuning.rungs(1, 2) == [1]
    points = {"leafwise": [{"trees": 1.0, "step": 0.01, "leaf_rows": 300.0},
                           {"trees": 4.0, "step": 0.3, "leaf_rows": 5.0},
                           {"trees": 4.0, "step": 0.2, "leaf_rows": 250.0},
                           {"trees": 3.0, "step": 0.3, "leaf_rows": 5.0}]}
    found = tuning.tune_in_rungs(train.drop("fold"), FEATURES, ["leafwise"], seeds=(1, 2), k=2,
                                 points=points, folder=str(tmp_path)).collect()
    by = {r["trial"]: r for r in found}
    assert len(by) == 4 and sum(r["finished"] for r in found) == 2
    assert not by[0]["finished"] and by[0]["cells"] == 2
    whole = {r["trial"]: r["score"] for r in tuning.tune(
        train.drop("fold"), FEATURES, ["leafwise"], seeds=(1, 2), k=2, points=points).collect()}
    for r in found:
        if r["finished"]:
            assert r["score"] == pytest.approx(whole[r["trial"]], abs=0.02)
    again = tuning.tune_in_rungs(train.drop("fold"), FEATURES, ["leafwise"], seeds=(1, 2), k=2,
                                 points=points, folder=str(tmp_path))
    plain = lambda rows: sorted((r["trial"], r["score"], sorted(r["params"].items())) for r in rows)
    assert plain(again.collect()) == plain(found)

