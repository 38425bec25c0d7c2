"""Registered model jobs run the presets whole; boosted trees are the same in one task and dealt out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.plans import models, tuning, workflow
from foldstone.plans.boosted import BoostedTrees, bundles
from foldstone.workload import model_queries as jobs


class Stop(Exception):
    pass


@pytest.fixture()
def caught(monkeypatch):
    """What a job hands to a plan, in place of running it."""
    told = []

    def catch(module, name):
        def stand_in(*args, **options):
            told.append((args, options))
            raise Stop
        monkeypatch.setattr(module, name, stand_in)
        return told

    monkeypatch.setattr(jobs, "_split", lambda spark, sf: (None, None))
    monkeypatch.setattr(jobs.impute, "fold_medians", lambda *a: [{}] * K.FOLDS)
    return catch


@pytest.mark.parametrize("job, family", [
    ("boosted_oof", "leafwise"), ("boosted_pseudo_oof", "leafwise"), ("forest_oof", "forest"),
    ("model_scores", "ordered")])
def test_families_are_whole_presets(caught, job, family):
    told = caught(models, "cross_fit")
    with pytest.raises(Stop):
        getattr(jobs, job)(None, None)
    args, _ = told[0]
    assert args[3] == family and args[4] == models.PRESETS[family]


def test_thresholds_are_studied_with_the_whole_preset(caught):
    told = caught(jobs, "threshold_refits")
    with pytest.raises(Stop):
        jobs.pseudo_threshold_refits(None, None)
    assert told[0][0][3:] == ("leafwise",) and told[0][1] == {}


def test_submission_is_made_of_whole_presets(caught, monkeypatch):
    monkeypatch.setattr(jobs, "_tables", lambda spark, sf: (None, None, None))
    told = caught(workflow, "train_blend_calibrate")
    with pytest.raises(Stop):
        jobs.train_and_submit(None, None)
    assert told[0] == ((None, None, None), {})


def test_tuning_tries_all_drawn_settings(spark, caught, monkeypatch):
    told = caught(tuning, "tune")
    monkeypatch.setattr(jobs, "checkpoint", lambda df: df)
    with pytest.raises(Stop):
        jobs.tuning_trials(spark, "/root/testdata/sf0.001")
    args, options = told[0]
    assert args[2] == list(K.TUNING_RANGES) and options == {}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    x[:, 3] = rng.integers(0, 3, 3000)
    x[:, 4] = 1.0
    odds = 2 * x[:, 0] + x[:, 1] * (x[:, 3] - 1)
    y = (rng.random(3000) < 1 / (1 + np.exp(-odds))).astype(int)
    names = [f"f{i}" for i in range(5)]
    pdf = pd.DataFrame(x, columns=names).assign(target=y, record_id=np.arange(3000))
    df = models._assembled(spark.createDataFrame(pdf), names)
    return df.withColumn("weight", F.when(F.col("target") == 1, 1.6).otherwise(1.0)).withColumn(
        "is_inner_valid", F.col("record_id") % 5 == 0).persist()


def scores(model, rows):
    out = model.transform(rows).select("record_id", vector_to_array("probability")[1].alias("p"))
    return out.orderBy("record_id").toPandas()["p"].to_numpy()


@pytest.mark.parametrize("options", [
    dict(trees=20, step=0.2, depth=3, rows=0.7, features=0.5, leaf_rows=20),
    dict(trees=3, step=0.2, depth=6), dict(trees=40, step=0.3, depth=2, early_stop=True)])
def test_boosted_fits_agree_in_one_task_and_dealt(rows, options):
    one = BoostedTrees(**options).fit(rows.coalesce(1))
    dealt = BoostedTrees(**options, local_bytes=0).fit(rows.repartition(5))
    assert len(one.forest.trees) == len(dealt.forest.trees)
    assert np.allclose(scores(one, rows), scores(dealt, rows))
    if options.get("early_stop"):
        assert len(one.forest.trees) < options["trees"]


def test_boosted_trees_by_hand(spark):
    """One feature, two values: the first tree's leaves are mean labels, the second's mean residuals."""
    pairs = [(0.0, 0)] * 3 + [(0.0, 1)] + [(1.0, 1)] * 4
    df = models._assembled(spark.createDataFrame(
        [(i, *p) for i, p in enumerate(pairs)], "record_id int, a double, target int"), ["a"])
    model = BoostedTrees(trees=2, step=0.1, depth=1).fit(df.withColumn("weight", F.lit(1.0)))

    def second(margin, labels):
        return margin + 0.1 * np.mean([4 * y / (1 + np.exp(2 * y * margin)) for y in labels])

    want = {0.0: second(-0.5, [-1, -1, -1, 1]), 1.0: second(1.0, [1, 1, 1, 1])}
    found = scores(model, df)
    assert np.allclose(found, [1 / (1 + np.exp(-2 * want[a])) for a, _ in pairs])


def test_bundles_hold_every_feature_once():
    sizes = [32, 2, 2, 1, 31, 256, 3]
    groups = bundles(sizes)
    assert sorted(f for g in groups for f in g) == list(range(7))
    assert all(np.prod([sizes[f] for f in g]) <= 1024 for g in groups)


def test_restarts_of_clusters_run_side_by_side(spark, monkeypatch):
    from foldstone.plans import clusters

    told = []
    whole = clusters.together
    monkeypatch.setattr(clusters, "together", lambda s, makes, workers: told.append(
        (len(makes), workers)) or whole(s, makes, workers))
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 2)), columns=["latitude", "longitude"]))
    fits = [clusters.fit_clusters(df, k=4, restarts=5, workers=w) for w in (1, 4)]
    assert told == [(5, 1), (5, 4)]
    assert np.allclose(*[f.clusterCenters() for f in fits])
