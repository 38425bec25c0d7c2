"""End-to-end workflows: from record tables to a checked prediction set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions.features import add_features, feature_columns
from foldstone.operators import (
    blend,
    calibrate,
    encode,
    folds,
    impute,
    metrics,
    profile,
    pseudo,
    verify,
)
from foldstone.operators.joins import enrich
from foldstone.plans import models
from foldstone.plans.clusters import assign_clusters, fit_clusters
from foldstone.plans.grid import WORKERS, Grid, fingerprint
from foldstone.session import checkpoint
from foldstone.sources.publish import publish, read_published
from foldstone.sources.sinks import better, to_predictions, write_predictions
from foldstone.sources.tables import PREDICTION_SCHEMA

KEYS = ("record_id", "target", "fold", "split", "is_train")


@dataclass
class Outcome:
    """Predictions for the unlabelled rows, the estimated score and how it was reached."""

    predictions: DataFrame
    score: float
    notes: dict


def build_features(
    records: DataFrame, enrichment: DataFrame, cluster_model=None
) -> tuple[DataFrame, object]:
    """Enrich one table and derive all its features (no target encoding).

    Without a cluster model one is fitted on these rows; pass it on when preparing other tables.
    """
    df = add_features(enrich(records, enrichment))
    if cluster_model is None:
        cluster_model = fit_clusters(df)
    return assign_clusters(cluster_model, df), cluster_model


def build_train_test(
    train: DataFrame, test: DataFrame, enrichment: DataFrame, context: bool = False,
    seed: int = K.SEED, k: int = K.FOLDS, grid: Grid | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, features): both tables featured and encoded, train with folds.

    Clusters are fitted on train only, target means out of fold on train and from all of train on
    test.  Both frames are stored, as cells of ``grid`` if given: every fold of every model reads
    them again.
    """
    if grid is not None and grid.done("features/train") and grid.done("features/test"):
        left, right = grid.read(["features/train"]), grid.read(["features/test"])
        return left, right, [c for c in right.columns if c != "record_id"]
    left, clusters = build_features(train, enrichment)
    right, _ = build_features(test, enrichment, clusters)
    if context:
        both = left.withColumn("is_train", F.lit(1)).unionByName(
            right.withColumn("is_train", F.lit(0)), allowMissingColumns=True)
        both = profile.group_context(both, ["zone", "district", "month", "age_group"], [
            "avg_temperature", "precipitation", "rain_sum_30d", "tavg_30d", "ndvi_30d"])
        left, right = both.where("is_train = 1"), both.where("is_train = 0").drop("target")
    left = checkpoint(folds.stratified_folds(left, k=k, seed=seed))
    columns = list(K.ENCODED_COLUMNS)
    encoded = encode.target_encode_oof(left, columns)
    unseen = encode.target_encode_full(left, right, columns)
    features = feature_columns(encoded, exclude=KEYS)
    encoded = encoded.select("record_id", "target", "fold", *features)
    unseen = unseen.select("record_id", *features)
    if grid is None:
        return checkpoint(encoded), checkpoint(unseen), features
    return (grid.cell("features/train", lambda: encoded),
            grid.cell("features/test", lambda: unseen), features)


def _labelled(oof: DataFrame, train: DataFrame) -> DataFrame:
    return oof.join(train.select("record_id", "target"), "record_id")


def _presets(names: Sequence[str], overrides: dict | None) -> dict[str, models.Preset]:
    return {n: models.PRESETS[n].with_settings(**(overrides or {}).get(n, {})) for n in names}


def _cross_fit_all(
    train, test, features, presets, k, seed, grid: Grid, stage: str, threshold=None
) -> DataFrame:
    """Predictions of all families and folds; every fit is a cell of the grid.

    A fold's rows are filled and stored once for all families, with medians that are found for all
    folds together.
    """
    row = f"{stage}/rows/seed={seed}/fold="
    fills = models.stored_fills(grid, f"{stage}/fills/seed={seed}", lambda: train, features, k)
    grid.run({f"{row}{f}": (lambda f=f: models.fold_rows(
        train, test, features, f, fills=fills[f])) for f in range(k)})
    cells = {
        f"{stage}/{name}/seed={seed}/fold={f}": (lambda name=name, f=f: models.filled_fold_scores(
            grid.read([f"{row}{f}"]), features, name, f, presets[name], seed, threshold))
        for name in presets for f in range(k)}
    grid.run(cells)
    return grid.read(cells)


def _manifest(name: str, train, test, enrichment, k, presets, folder, workers) -> Grid:
    """The grid of a workflow's stages, named by what all of them are made from."""
    given = [fingerprint(df) for df in (train, test, enrichment)]
    return Grid(train.sparkSession, folder, (name, *given, k, presets), workers)


def _wide(predictions: DataFrame, kind: str, names: Sequence[str]) -> DataFrame:
    return blend.to_wide(predictions.where(F.col("kind") == kind), names, ["record_id"])


def train_blend_calibrate(
    train: DataFrame, test: DataFrame, enrichment: DataFrame, overrides: dict | None = None,
    k: int = K.FOLDS, names: Sequence[str] = ("leafwise", "levelwise", "ordered"),
    folder: str | None = None, workers: int = WORKERS,
) -> Outcome:
    """Three boosted families with pseudo-labels per fold, the best blend, and a calibration that
    is kept only if nested validation says it helps.

    Stages are stored below ``folder`` and skipped by a later run whose tables and settings are
    unchanged.
    """
    presets = _presets(names, overrides)
    grid = _manifest("blend", train, test, enrichment, k, presets, folder, workers)
    left, right, features = build_train_test(train, test, enrichment, k=k, grid=grid)
    predictions = _cross_fit_all(left, right, features, presets, k, K.SEED, grid, "first",
                                 K.PSEUDO_THRESHOLD)
    oof = _labelled(_wide(predictions, "oof", names), left)
    best = blend.search_blend(oof, names, K.BLEND_CANDIDATES).first()
    blended = blend.blend(oof, names, best["w"])
    unseen = blend.blend(_wide(predictions, "test", names), names, best["w"])
    nested = calibrate.nested_calibration(
        folds.stratified_folds(blended, seed=K.CALIBRATION_SEED, k=k), k=k)
    nested_score = metrics.score_metrics(nested, p="p_cal").first()["score"]
    choice = better(best["score"], nested_score)
    final = unseen
    if choice == "calibrated":
        point = calibrate.best_point(calibrate.grid_f1(blended, K.CALIBRATION_GRIDS["nested"]))
        final = calibrate.apply_point(unseen, point).drop("p").withColumnRenamed("p_cal", "p")
    return Outcome(to_predictions(final), max(best["score"], nested_score or 0.0), {
        "weights": list(best["w"]), "raw": best["score"], "nested": nested_score,
        "used": choice, "features": len(features)})


def stack_with_pseudo(
    train: DataFrame, test: DataFrame, enrichment: DataFrame, overrides: dict | None = None,
    k: int = K.FOLDS,
    names: Sequence[str] = ("ordered", "leafwise", "levelwise", "extra_trees", "perceptron"),
    second: Sequence[str] = ("ordered", "leafwise", "levelwise"),
    folder: str | None = None, workers: int = WORKERS,
) -> Outcome:
    """Five families stacked by a logistic regression; confident stacked scores become training
    rows for a second round; both rounds are blended and calibrated.

    Stages are stored below ``folder`` and skipped by a later run whose tables and settings are
    unchanged.
    """
    presets = _presets(names, overrides)
    grid = _manifest("stack", train, test, enrichment, k, (presets, tuple(second)), folder, workers)
    left, right, features = build_train_test(train, test, enrichment, context=True, k=k, grid=grid)
    first = _cross_fit_all(left, right, features, presets, k, K.SEED, grid, "first")
    oof = _labelled(_wide(first, "oof", names), left.select("record_id", "target")).join(
        left.select("record_id", "fold"), "record_id")
    stacked = grid.cell("stacked", lambda: models.stack(
        oof, _wide(first, "test", names), names, k=k))
    confident = pseudo.select_confident(
        stacked.where("kind = 'test'"), *K.PSEUDO_STACK_BAND)
    extra = right.join(confident.select("record_id", F.col("pseudo_label").alias("target")),
                       "record_id").withColumn("fold", F.lit(None).cast("int"))
    grown = grid.cell("grown", lambda: left.unionByName(extra))
    again = _cross_fit_all(grown, right, features, {n: presets[n] for n in second}, k, K.SEED, grid,
                           "second")
    weights = K.FIXED_BLENDS["stack50_ordered20_leaf15_level15"]

    def combine(kind):
        base = stacked.where(F.col("kind") == kind).select("record_id", F.col("p").alias("stack"))
        return blend.blend(base.join(_wide(again, kind, second), "record_id"),
                           ["stack", *second], weights)

    final_oof = _labelled(combine("oof"), left)
    points = calibrate.calibration_scores(final_oof, K.CALIBRATION_GRIDS["pseudo"])
    point = checkpoint(calibrate.best_point(points))
    best_score = points.agg(F.max("score")).first()[0]
    final = calibrate.apply_point(combine("test"), point).drop("p").withColumnRenamed("p_cal", "p")
    return Outcome(to_predictions(final), best_score, {"calibration": point.first().asDict()})


def baseline_report(
    train: DataFrame, enrichment: DataFrame, text: Sequence[str] = ("zone", "gender"),
    iterations: int = 2000,
) -> tuple[DataFrame, DataFrame, object]:
    """(score row, class report, fitted model) of the logistic baseline on a held-out fifth."""
    df = add_features(enrich(train, enrichment))
    numbers = [c for c in feature_columns(df, exclude=KEYS)
               if c not in ("latitude", "longitude")]
    parted = checkpoint(folds.stratified_split(df).select(
        "record_id", "target", "part", *text, *numbers))
    fitting = parted.where("part = 'fit'")
    filled = impute.mode_impute(fitting, impute.median_impute(fitting, parted, numbers), text)
    filled = filled.fillna(0.0, subset=numbers)
    model = models.fit_baseline(filled.where("part = 'fit'"), text, numbers, iterations)
    scored = models.score_baseline(model, filled.where("part = 'valid'"))
    return metrics.score_metrics(scored), metrics.classification_report(scored), model


def baseline_predictions(
    train: DataFrame, test: DataFrame, enrichment: DataFrame,
    text: Sequence[str] = ("zone", "gender"), iterations: int = 2000,
) -> DataFrame:
    """(id, label, score) of the logistic baseline refitted on all training rows."""
    left = add_features(enrich(train, enrichment))
    numbers = [c for c in feature_columns(left, exclude=KEYS)
               if c not in ("latitude", "longitude")]
    left = checkpoint(left.select("record_id", "target", *text, *numbers))
    right = add_features(enrich(test, enrichment)).select("record_id", *text, *numbers)

    def fill(df):
        return impute.mode_impute(left, impute.median_impute(left, df, numbers), text).fillna(
            0.0, subset=numbers)

    model = models.fit_baseline(fill(left), text, numbers, iterations)
    return to_predictions(models.score_baseline(model, fill(right)))


def bag_seeds(
    train: DataFrame, test: DataFrame, features: Sequence[str], weights: dict[str, float],
    seeds: Sequence[int] = K.SEED_BAG, k: int = K.FOLDS, overrides: dict | None = None,
    folder: str | None = None, workers: int = WORKERS,
) -> DataFrame:
    """(record_id, kind, p): several seeds of folds and fits, averaged per family and blended.

    ``weights`` gives the families and their share of the blend.  Every fit of a (seed, fold,
    family) is a cell of a grid, stored under its key; pass ``folder`` so that a bag that was
    interrupted goes on with the fits that are missing.
    """
    presets = _presets(list(weights), overrides)
    bare = train.select("record_id", "target", *features)
    test = test.select("record_id", *features)
    grid = Grid(train.sparkSession, folder, (
        "bag", fingerprint(bare), fingerprint(test), k, presets, *features), workers)
    grid.run({f"folds/seed={s}": (lambda s=s: folds.stratified_folds(bare, k=k, seed=s))
              for s in seeds})
    fills = {s: models.stored_fills(grid, f"fills/seed={s}", lambda s=s: grid.read(
        [f"folds/seed={s}"]), features, k) for s in seeds}
    grid.run({f"rows/seed={s}/fold={f}": (lambda s=s, f=f: models.fold_rows(
        grid.read([f"folds/seed={s}"]), test, features, f, fills=fills[s][f]))
        for s in seeds for f in range(k)})
    cells = {
        f"{name}/seed={s}/fold={f}": (lambda name=name, s=s, f=f: models.filled_fold_scores(
            grid.read([f"rows/seed={s}/fold={f}"]), features, name, f, presets[name], s))
        for s in seeds for f in range(k) for name in presets}
    grid.run(cells)
    mean = blend.fold_average(grid.read(cells), by=("kind", "model"))
    wide = blend.to_wide(mean, list(weights), ["record_id", "kind"])
    return blend.blend(wide, list(weights), list(weights.values())).select(
        "record_id", "kind", "p")


def run(
    train: DataFrame, test: DataFrame, enrichment: DataFrame, paths: str | Sequence[str],
    overrides: dict | None = None, k: int = K.FOLDS, folder: str | None = None,
) -> Outcome:
    """Train, blend, calibrate, write the prediction file(s)."""
    outcome = train_blend_calibrate(train, test, enrichment, overrides, k, folder=folder)
    write_predictions(outcome.predictions, paths)
    return outcome


def published_check(outcome: Outcome, template: DataFrame, path: str) -> DataFrame:
    """Publish an outcome's predictions, read them back and check them against the template."""
    columns = {"id": "ID", "label": "TargetF1", "score": "TargetRAUC"}
    publish(outcome.predictions.select(*[F.col(a).alias(b) for a, b in columns.items()]), path)
    back = read_published(template.sparkSession, path, PREDICTION_SCHEMA)
    return verify.verify_predictions(
        back.select(*[F.col(b).alias(a) for a, b in columns.items()]), template)
