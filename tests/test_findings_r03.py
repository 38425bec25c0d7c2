"""Checks that would have failed before the findings of round 3 were mended."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foldstone.operators import blend, impute
from foldstone.operators.pseudo import fold_complement
from foldstone.plans import models


def _rows(spark, n):
    nothing, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    return spark.range(n).select(
        F.col("id").alias("record_id"), (F.col("id") % 2).cast("int").alias("target"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).cast("int").alias("fold"),
        F.when(F.col("id") % 7 == 0, nothing).when(F.col("id") % 13 == 0, nan)
        .otherwise(h / 8).alias("mixed"),
        F.when(F.col("fold") == 0, h.cast("double")).alias("one_fold_only"),
        (F.col("fold") * 100 + h / 1000).alias("far_apart"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("two_values"),
        nothing.alias("empty"))


@pytest.mark.parametrize("n", [0, 1, 7, 4000])
def test_medians_of_all_folds_are_those_of_each(spark, n):
    df = _rows(spark, n)
    columns = ["mixed", "one_fold_only", "far_apart", "two_values", "empty"]
    assert impute.fold_medians(df, columns, 3) == [
        impute.medians(fold_complement(df, f), columns) for f in range(3)]


def test_cross_fit_finds_medians_once_for_all_folds(spark, monkeypatch):
    calls = []
    whole = impute.fold_medians
    monkeypatch.setattr(models, "fold_medians", lambda *a: calls.append(a) or whole(*a))
    monkeypatch.setattr(models, "medians", None)
    preset = models.PRESETS["forest"].with_settings(trees=2, depth=2)
    features = ["far_apart", "two_values"]
    out = models.cross_fit(_rows(spark, 300).where("fold is not null"), None, features, "forest",
                           preset, k=3)
    assert len(calls) == 1 and out.count() == _rows(spark, 300).where("fold is not null").count()


def test_blend_search_with_missing_scores(spark):
    """Rows without a score are no pairs of the AUC, so they must not bring the bounds together."""
    a = [(1, x) for x in (.6, .6, .6, .6, .1)] + [(0, x) for x in (.9, .4, .4, .4, .4)]
    b = [.9, .9, .9, .4, .4] + [.1] * 5
    rows = [(y, p, q) for (y, p), q in zip(a, b)] + [(0, None, .3), (0, .3, float("nan"))] * 100
    df = spark.createDataFrame(rows + [(None, .5, .5)], "target int, a double, b double")
    candidates = [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)]
    want = blend.first_best(blend.blend_scores(df, ["a", "b"], candidates)).first()
    got = blend.search_blend(df, ["a", "b"], candidates).first()
    assert got == want and got["candidate"] > 0
    for left in (df.limit(0), df.where("target = 1")):
        assert blend.search_blend(left, ["a", "b"], candidates).count() == 0


def test_blend_search_multiplies_no_rows_by_the_candidates(spark, monkeypatch):
    made = []
    whole = blend._blended
    monkeypatch.setattr(blend, "_blended", lambda wide, models, weights: made.append(
        wide.select(F.size(weights)).first()) or whole(wide, models, weights))
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_007)) / 10_007 for i in range(4)]
    df = spark.range(2000).select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("target"),
                                  *[x.alias(m) for x, m in zip(h, "abcd")])
    candidates = blend.simplex(4)
    want = blend.first_best(blend.blend_scores(df, list("abcd"), candidates)).first()
    made.clear()
    assert blend.search_blend(df, list("abcd"), candidates).first() == want
    assert [n for n, in made] and made[0][0] < 10 < len(candidates)
