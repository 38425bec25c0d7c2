"""Model jobs find planted signals and keep fold discipline."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators import blend, folds, metrics
from foldstone.plans import models, tuning, workflow
from foldstone.plans.clusters import assign_clusters, fit_clusters
from foldstone.plans.importance import feature_importance, permutation_importance, permuted

FEATURES = ["f1", "f2", "f3", "f4"]
QUICK = {
    "leafwise": {"trees": 5, "step": 0.3, "leaf_rows": 5},
    "levelwise": {"trees": 5, "step": 0.3},
    "ordered": {"trees": 5, "step": 0.3, "early_stop": True},
    "forest": {"trees": 10, "depth": 5},
    "extra_trees": {"trees": 10, "depth": 5},
    "perceptron": {"hidden": (8, 4), "iterations": 40},
    "logistic": {"iterations": 50},
}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=FEATURES)
    odds = 2.5 * pdf["f1"] + 1.5 * pdf["f2"] * pdf["f3"]
    pdf["target"] = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(int)
    pdf["record_id"] = np.arange(n)
    df = spark.createDataFrame(pdf).withColumn("f4", F.when(F.col("f4") < 1.5, F.col("f4")))
    train = folds.stratified_folds(df.where("record_id < 700"), k=3).persist()
    return train, df.where("record_id >= 700").persist()


@pytest.mark.parametrize("name", list(QUICK))
def test_family_beats_chance(planted, name):
    train, test = planted
    preset = models.PRESETS[name].with_settings(**QUICK[name])
    out = models.cross_fit(train, test.drop("target"), FEATURES, name, preset, k=3).persist()
    oof = out.where("kind = 'oof'")
    assert oof.count() == 700 and oof.select("record_id").distinct().count() == 700
    assert out.where("kind = 'test'").count() == 3 * 200
    labelled = oof.join(train.select("record_id", "target"), "record_id")
    assert metrics.roc_auc(labelled).first()[0] > 0.7
    mean = blend.fold_average(out.where("kind = 'test'")).join(
        test.select("record_id", "target"), "record_id")
    assert metrics.roc_auc(mean).first()[0] > 0.7


def test_pseudo_labels_inside_folds(planted):
    train, test = planted
    preset = models.PRESETS["leafwise"].with_settings(**QUICK["leafwise"])
    out = models.cross_fit(train, test.drop("target"), FEATURES, "leafwise", preset, k=3,
                           pseudo_threshold=0.2)
    labelled = out.where("kind = 'oof'").join(train.select("record_id", "target"), "record_id")
    assert labelled.count() == 700 and metrics.roc_auc(labelled).first()[0] > 0.7


def test_stack(planted):
    train, test = planted
    rng = F.rand(3) * 0.4
    wide = train.select("record_id", "target", "fold",
                        (F.col("target") * 0.4 + rng).alias("a"), F.rand(4).alias("b"))
    out = models.stack(wide, None, ["a", "b"], k=3)
    labelled = out.join(train.select("record_id", "target"), "record_id")
    assert labelled.count() == 700 and metrics.roc_auc(labelled).first()[0] > 0.9


def test_bag_of_seeds(planted):
    train, test = planted
    out = workflow.bag_seeds(train, test.drop("target"), FEATURES,
                             {"leafwise": 0.5, "forest": 0.5}, seeds=(1, 2), k=2, overrides=QUICK)
    oof = out.where("kind = 'oof'").join(train.select("record_id", "target"), "record_id")
    assert oof.count() == 700 and metrics.roc_auc(oof).first()[0] > 0.7
    assert out.where("kind = 'test'").count() == 200


def test_presets_carry_tuned_values():
    p = models.PRESETS["leafwise"]
    assert p.settings["trees"] == 341 and p.settings["depth"] == 3
    assert p.positive_weight == K.LEAFWISE_TUNED["scale_pos_weight"]


def test_importances(spark, planted):
    train, _ = planted
    filled = models.preparation(train, FEATURES)(train)
    model = models.fit(filled, FEATURES, models.PRESETS["forest"].with_settings(**QUICK["forest"]))
    top = feature_importance(spark, model, FEATURES, 4).collect()
    assert top[0]["feature"] == "f1" and len(top) == 4
    rows = permutation_importance(model, filled, FEATURES, repeats=2).collect()
    lost = {r["feature"]: r["importance"] for r in rows}
    assert max(lost, key=lost.get) == "f1" and lost["f1"] > 0.05 > abs(lost["f4"])


def test_permuting_keeps_values(planted):
    train, _ = planted
    filled = models.preparation(train, FEATURES)(train).select("record_id", "target", *FEATURES)
    out = permuted(filled, ["f1", "f2"], 2).persist()
    assert out.count() == 700 * 4
    local, base = out.toPandas(), filled.toPandas().sort_values("record_id")
    for (feature, _), part in local.groupby(["feature", "repeat"]):
        part = part.sort_values("record_id")
        for f in FEATURES:
            same = np.array_equal(part[f].to_numpy(), base[f].to_numpy())
            assert same == (f != feature)
            assert np.allclose(np.sort(part[f]), np.sort(base[f]))


def test_clusters_find_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [20, 0], [0, 20]])
    label = np.repeat(np.arange(6), 60)
    at = centres[label] + rng.normal(0, 0.2, (360, 2))
    pdf = pd.DataFrame(at, columns=["latitude", "longitude"]).assign(label=label)
    hot = pd.concat([pdf, pd.DataFrame({"latitude": [0.0] * 200, "longitude": [0.0] * 200,
                                        "label": [0] * 200})])
    df = spark.createDataFrame(hot)
    out = assign_clusters(fit_clusters(df, restarts=4), df).toPandas()
    pairs = out.groupby("label")["spatial_cluster"].nunique()
    assert (pairs == 1).all() and out["spatial_cluster"].nunique() == 6


def test_tuning(planted):
    train, _ = planted
    points = {"leafwise": [{"trees": 1.0, "depth": 1.0}, {"trees": 5.0, "step": 0.3, "depth": 3.0}]}
    trials = tuning.tune(train.select("record_id", "target", *FEATURES), FEATURES, ["leafwise"],
                         seeds=(1,), k=2, points=points).persist()
    assert trials.count() == 2
    best = tuning.best_trials(trials).first()
    assert best["params"]["trees"] == 5.0 and best["score"] > 0.6
    drawn = tuning.draw("ordered", 30)
    assert drawn == tuning.draw("ordered", 30)
    assert all(0.01 <= d["step"] <= 0.12 and 150 <= d["trees"] <= 600 for d in drawn)
    assert tuning.trials_for("ordered", 40) == 20 and tuning.trials_for("ordered", 10) == 15
