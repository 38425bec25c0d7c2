"""Encoding, calibration, blending and pseudo-label properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators import blend, calibrate, encode, folds, metrics, profile, pseudo, trailing


@pytest.fixture(scope="module")
def simulated(spark):
    """y ~ Bernoulli(0.65); p = clip(0.4 y + N(0.4, 0.2), 0.01, 0.99), with ties."""
    rng = np.random.default_rng(42)
    y = rng.binomial(1, 0.65, 1000)
    p = np.clip(y * 0.4 + rng.normal(0.4, 0.2, 1000), 0.01, 0.99).round(2)
    pdf = pd.DataFrame({"record_id": np.arange(1000), "target": y, "p": p,
                        "key": rng.integers(0, 6, 1000)})
    return pdf, spark.createDataFrame(pdf)


def naive(y, p, s, c):
    q = np.clip(p, 1e-6, 1 - 1e-6)
    hit = s * np.log(q / (1 - q)) + c >= 0
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


@pytest.mark.parametrize("name", ["nested", "pseudo"])
def test_grid_equals_scoring_every_point(spark, simulated, name):
    pdf, df = simulated
    y, p = pdf["target"].to_numpy(), pdf["p"].to_numpy()
    points = calibrate.calibration_scores(df, K.CALIBRATION_GRIDS[name]).toPandas()
    _, _, ns, _, _, nc = K.CALIBRATION_GRIDS[name]
    assert len(points) == ns * nc
    for r in points.itertuples():
        assert r.f1 == pytest.approx(naive(y, p, r.s, r.c), abs=1e-12)
    best = calibrate.best_point(calibrate.grid_f1(df, K.CALIBRATION_GRIDS[name])).first()
    top = points[points["f1"] == points["f1"].max()].sort_values(["s", "c"]).iloc[0]
    assert (best["s"], best["c"]) == (top["s"], top["c"])


def test_calibration_keeps_auc_and_nested_fit_leaves_fold_out(spark, simulated):
    pdf, df = simulated
    folded = folds.stratified_folds(df, seed=1).persist()
    chosen = {r["fold"]: r for r in calibrate.nested_points(folded).collect()}
    local = folded.toPandas()
    for f in range(5):
        rest = local[local["fold"] != f]
        y, p = rest["target"].to_numpy(), rest["p"].to_numpy()
        grid = [(naive(y, p, s, c), -s, -c)
                for s in np.linspace(0.5, 2, 16) for c in np.linspace(-1.5, 1.5, 31)]
        assert chosen[f]["f1"] == pytest.approx(max(grid)[0], abs=1e-12)
    auc = metrics.roc_auc(folded).first()[0]
    out = calibrate.nested_calibration(folded)
    assert out.count() == len(pdf)
    moved = calibrate.apply_point(df, spark.createDataFrame([(1.7, -0.4)], "s double, c double"))
    assert metrics.roc_auc(moved, p="p_cal").first()[0] == pytest.approx(auc, abs=1e-9)


def test_shift_never_scores_below_raw(simulated):
    pdf, df = simulated
    row = calibrate.calibrate_shift(df).first()
    raw = metrics.score_metrics(df).first()
    assert row["score"] >= raw["score"] - 1e-12
    best = max(naive(pdf["target"].to_numpy(), pdf["p"].to_numpy(), 1.0, c)
               for c in np.linspace(-3, 3, 601))
    assert row["f1"] == pytest.approx(max(best, raw["f1"]))


def test_count_shift_meets_the_wanted_count(simulated):
    pdf, df = simulated
    row = calibrate.count_shift(df, 700).first()
    p = pdf["p"].to_numpy()
    counts = [(abs(int((np.log(p / (1 - p)) + c >= -1e-15).sum()) - 700), i)
              for i, c in enumerate(np.linspace(-0.5, 0.5, 1001))]
    assert row["gap"] == min(counts)[0]


def test_oof_encoding_ignores_own_fold(spark, simulated):
    _, df = simulated
    base = folds.stratified_folds(df).persist()
    one = encode.target_encode_oof(base, ["key"], prior="fold")
    flipped = base.withColumn("target", F.when(F.col("fold") == 2, 1 - F.col("target"))
                              .otherwise(F.col("target")))
    two = encode.target_encode_oof(flipped, ["key"], prior="fold")
    both = one.alias("a").join(two.alias("b"), "record_id").where("a.fold = 2")
    assert both.where("abs(a.key_te - b.key_te) > 1e-12").count() == 0


def test_oof_encoding_value_and_new_keys(spark):
    rows = [(0, "a", 1, 0), (1, "a", 0, 1), (2, "a", 1, 1), (3, "b", 1, 0), (4, None, 0, 1)]
    df = spark.createDataFrame(rows, "record_id int, key string, target int, fold int")
    got = {r["record_id"]: r["key_te"] for r in encode.target_encode_oof(df, ["key"]).collect()}
    mean = 3 / 5
    assert got[0] == pytest.approx((1 + 10 * mean) / 12)
    assert got[1] == pytest.approx((1 + 10 * mean) / 11)
    assert got[3] == pytest.approx(mean) and got[4] == pytest.approx(mean)
    unseen = spark.createDataFrame([(9, "a"), (10, "q"), (11, None)], "record_id int, key string")
    full = {r["record_id"]: r["key_te"]
            for r in encode.target_encode_full(df, unseen, ["key"]).collect()}
    assert full[9] == pytest.approx((2 + 10 * mean) / 13)
    assert full[10] == pytest.approx(mean) and full[11] == pytest.approx(mean)


def test_weights_sum_to_one():
    for w in [*K.BLEND_CANDIDATES, *K.FIXED_BLENDS.values(), *blend.simplex(4)]:
        assert sum(w) == pytest.approx(1.0) and min(w) >= 0


def test_pruned_search_finds_the_same_best(spark):
    rng = np.random.default_rng(5)
    y = rng.binomial(1, 0.5, 800)
    pdf = pd.DataFrame({"record_id": np.arange(800), "target": y})
    for m, noise in (("a", 0.3), ("b", 0.5), ("c", 0.8)):
        pdf[m] = np.clip(0.3 * y + 0.35 + rng.normal(0, noise, 800), 0, 1)
    df = spark.createDataFrame(pdf)
    candidates = blend.simplex(3)
    every = blend.blend_scores(df, ["a", "b", "c"], candidates)
    want = blend.first_best(every).first()
    got = blend.search_blend(df, ["a", "b", "c"], candidates).first()
    assert got["candidate"] == want["candidate"]
    assert got["score"] == pytest.approx(want["score"])


def test_pseudo_rows_and_fold_complement(spark):
    train = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "record_id int, target int, fold int")
    scored = spark.createDataFrame([(3, 0.99), (4, 0.5), (5, 0.05), (6, float("nan"))],
                                   "record_id int, p double").withColumns(
        {"target": F.lit(None).cast("int"), "fold": F.lit(None).cast("int")})
    grown = pseudo.augment(train, scored, 0.05)
    rows = {r["record_id"]: (r["target"], r["is_pseudo"]) for r in grown.collect()}
    assert rows == {1: (1, 0), 2: (0, 0), 3: (1, 1), 5: (0, 1)}
    kept = {r["record_id"] for r in pseudo.fold_complement(grown, 0).collect()}
    assert kept == {2, 3, 5}


def test_trailing_window_leaves_own_day_out(spark):
    series = spark.createDataFrame(
        [(1, "2024-01-01", 5.0), (1, "2024-01-02", 7.0), (1, "2024-01-09", 1.0)],
        "place int, day string, value double").withColumn("day", F.to_date("day"))
    records = spark.createDataFrame(
        [(1, 1, "2024-01-02"), (2, 1, "2024-01-09"), (3, 1, "2024-01-08"), (4, 2, "2024-01-09"),
         (5, 1, None)], "record_id int, place int, day string").withColumn("day", F.to_date("day"))
    rows = {r["record_id"]: r for r in trailing.trailing_windows(
        records, series, "place", "day", [7]).collect()}
    assert rows[1]["sum_7d"] == 5.0
    assert rows[2]["sum_7d"] == 7.0 and rows[2]["days_above_7d"] == 1
    assert rows[3]["sum_7d"] == 12.0 and rows[3]["median_7d"] == 6.0
    assert rows[4]["sum_7d"] is None and rows[4]["days_above_7d"] == 0
    assert rows[5]["sum_7d"] is None and len(rows) == 5


def test_group_context_equals_windows(spark, simulated):
    pdf, df = simulated
    got = profile.group_context(df, ["key", "target"], ["p"], with_std=True).toPandas()
    want = pdf.groupby("key")["p"].transform("mean")
    got = got.sort_values("record_id").reset_index(drop=True)
    assert np.allclose(got["p_mean_by_key"], want)
    assert np.allclose(got["p_diff_from_key_mean"], pdf["p"] - want)
    assert np.allclose(got["p_std_by_target"], pdf.groupby("target")["p"].transform("std"))
