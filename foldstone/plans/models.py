"""Model families as named presets, and fitting them fold by fold.

Every frame carries ``record_id``, the feature columns, ``target`` (NULL where unknown), and for
training rows ``fold``.  Predictions come back as one long table
(record_id, model, seed, fold, kind, p) with kind ``oof`` or ``test``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators.impute import (
    add_class_weight,
    apply_moments,
    fold_medians,
    medians,
    moments,
)
from foldstone.operators.pseudo import augment, fold_complement
from foldstone.operators.ranks import hash_text
from foldstone.plans.boosted import BoostedTrees
from foldstone.plans.extra_trees import ExtraTrees
from foldstone.plans.grid import together


@dataclass(frozen=True)
class Preset:
    """How to build one model family; ``positive_weight`` scales the loss of positives."""

    build: Callable[..., Estimator]
    settings: dict = field(default_factory=dict)
    positive_weight: float = 1.0
    scaled: bool = False

    def __repr__(self) -> str:
        """The same text in every process, so that it can name stored results."""
        return (f"{self.build.__name__}({sorted(self.settings.items())}, {self.positive_weight}, "
                f"{self.scaled})")

    def with_settings(self, **changes) -> Preset:
        weight = changes.pop("positive_weight", self.positive_weight)
        return Preset(self.build, {**self.settings, **changes}, weight, self.scaled)


def boosted(trees: int, step: float, depth: int, rows: float = 1.0, features: float | str = "all",
            leaf_rows: int = 1, early_stop: bool = False, seed: int = K.SEED) -> BoostedTrees:
    """Boosted trees.  With ``early_stop`` rows marked ``is_inner_valid`` end the growth."""
    return BoostedTrees(trees, step, depth, rows, features, leaf_rows, early_stop, seed)


def forest(trees: int, depth: int, seed: int = K.SEED) -> Estimator:
    """Random forest."""
    return RandomForestClassifier(
        labelCol="target", featuresCol="features", weightCol="weight", numTrees=int(trees),
        maxDepth=int(depth), seed=seed)


def extra_trees(trees: int = 400, depth: int = 14, seed: int = K.SEED) -> ExtraTrees:
    """Trees of random cut points over all rows, none of them searched for."""
    return ExtraTrees(trees, depth, seed=seed)


def perceptron(hidden: Sequence[int] = (64, 32), iterations: int = 300, width: int = 0,
               seed: int = K.SEED) -> Estimator:
    return MultilayerPerceptronClassifier(
        labelCol="target", featuresCol="features", layers=[width, *hidden, 2],
        maxIter=iterations, seed=seed)


def logistic(strength: float = 0.0, iterations: int = 2000, seed: int = K.SEED) -> Estimator:
    """``strength`` penalises the coefficients as given, not those of scaled features."""
    return LogisticRegression(labelCol="target", featuresCol="features", weightCol="weight",
                              regParam=strength, standardization=False, maxIter=iterations)


_L, _X, _O = K.LEAFWISE_TUNED, K.LEVELWISE_TUNED, K.ORDERED_TUNED
# Settings Spark's trees do not have (leaf-count limits, L1/L2 on leaves, bagging temperature) are
# left out; depth, step, trees, row and feature sampling, leaf size and class weight carry over.
PRESETS: dict[str, Preset] = {
    "leafwise": Preset(boosted, dict(
        trees=_L["n_estimators"], step=_L["learning_rate"], depth=_L["max_depth"],
        rows=_L["bagging_fraction"], features=round(_L["feature_fraction"], 4),
        leaf_rows=_L["min_data_in_leaf"]), _L["scale_pos_weight"]),
    "levelwise": Preset(boosted, dict(
        trees=_X["n_estimators"], step=_X["learning_rate"], depth=_X["max_depth"],
        rows=_X["subsample"], features=round(_X["colsample_bytree"], 4),
        leaf_rows=_X["min_child_weight"]), _X["scale_pos_weight"]),
    "ordered": Preset(boosted, dict(
        trees=_O["iterations"], step=_O["learning_rate"], depth=_O["depth"]),
        _O["scale_pos_weight"]),
    "forest": Preset(forest, dict(trees=300, depth=12)),
    "extra_trees": Preset(extra_trees, dict(trees=400, depth=14)),
    "perceptron": Preset(perceptron, dict(hidden=(64, 32), iterations=300), scaled=True),
    "logistic": Preset(logistic),
}


def preparation(
    fit_on: DataFrame, features: Sequence[str], scaled: bool = False,
    found: dict[str, float] | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """Filling (and scaling) with numbers fitted once on the given rows, for any frame.

    ``found`` are the medians of the given rows where they are known already.
    """
    columns = list(features)
    fills = {**dict.fromkeys(columns, 0.0),
             **(medians(fit_on, columns) if found is None else found)}

    def fill(df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})

    if not scaled:
        return fill
    centre = moments(fill(fit_on), columns)
    return lambda df: apply_moments(fill(df), centre)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="error").transform(df)


def fit(df: DataFrame, features: Sequence[str], preset: Preset, seed: int = K.SEED):
    """Fit one preset on rows whose features are filled (and scaled if need be)."""
    settings = dict(preset.settings, seed=seed)
    if preset.build is perceptron:
        settings["width"] = len(features)
    weight = F.when(F.col("target") == 1, F.lit(float(preset.positive_weight))).otherwise(1.0)
    rows = _assembled(df.where(F.col("target").isNotNull()), features).withColumn(
        "weight", weight)
    if settings.get("early_stop"):
        # An inner split of the fitting rows, never the rows being scored.
        rows = rows.withColumn("is_inner_valid", F.substring(
            hash_text(f"inner{seed}", "record_id"), 1, 2) < F.lit("1a"))
    return preset.build(**settings).fit(rows)


def score(model, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Add the probability of label 1."""
    return model.transform(_assembled(df, features)).withColumn(
        name, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def cross_fit(
    train: DataFrame, test: DataFrame | None, features: Sequence[str], model: str,
    preset: Preset | None = None, k: int = K.FOLDS, seed: int = K.SEED,
    pseudo_threshold: float | None = None, fold: str = "fold",
    fills: Sequence[dict[str, float]] | None = None,
) -> DataFrame:
    """Out-of-fold and per-fold test predictions of one family.

    With ``pseudo_threshold`` each fold first scores the unlabelled rows with a model of its own
    training rows, adds the confident ones with their predicted labels and refits; the held-out
    fold never takes part.  Medians and scales come from the fold's training rows only; ``fills``
    are the medians (``fold_medians``) where several calls share the rows.
    """
    fills = fold_medians(train, features, k, fold) if fills is None else fills
    return reduce(lambda a, b: a.unionByName(b), together(train.sparkSession, [
        lambda f=f: fold_scores(
            train, test, features, model, f, preset, seed, pseudo_threshold, fold, fills[f])
        for f in range(k)]))


def stored_fills(
    grid, key: str, train: Callable[[], DataFrame], features: Sequence[str], k: int,
    fold: str = "fold",
) -> list[dict[str, float]]:
    """``fold_medians`` as a cell of a grid: (fold, name, value)."""
    def make() -> DataFrame:
        found = fold_medians(train(), features, k, fold)
        return grid.spark.createDataFrame(
            [(f, c, v) for f, own in enumerate(found) for c, v in own.items()],
            "fold int, name string, value double")

    fills: list[dict[str, float]] = [{} for _ in range(k)]
    for r in grid.cell(key, make).collect():  # a number per fold and feature
        fills[r["fold"]][r["name"]] = r["value"]
    return fills


def fold_rows(
    train: DataFrame, test: DataFrame | None, features: Sequence[str], f: int, fold: str = "fold",
    fills: dict[str, float] | None = None,
) -> DataFrame:
    """(record_id, target, kind, features): the rows of one fold's fits, filled.

    ``kind`` is ``fit``, ``held`` or ``test``; fills are medians of the fitting rows, given as
    ``fills`` where all folds' were found together.  Store this once where several models of a fold
    are fitted.
    """
    columns = ["record_id", *features]
    own = fold_complement(train, f, fold)
    prepare = preparation(own, features, found=fills)
    kinds = [("fit", own), ("held", train.where(F.col(fold) == f))]
    if test is not None:
        kinds.append(("test", test.withColumn("target", F.lit(None).cast("int"))))
    return reduce(lambda a, b: a.unionByName(b), [
        prepare(rows).select(*columns, F.col("target").cast("int").alias("target"),
                             F.lit(kind).alias("kind")) for kind, rows in kinds])


def fold_scores(
    train: DataFrame, test: DataFrame | None, features: Sequence[str], model: str, f: int,
    preset: Preset | None = None, seed: int = K.SEED, pseudo_threshold: float | None = None,
    fold: str = "fold", fills: dict[str, float] | None = None,
) -> DataFrame:
    """The part of ``cross_fit`` that leaves out one fold."""
    rows = fold_rows(train, test, features, f, fold, fills).persist()
    out = filled_fold_scores(rows, features, model, f, preset, seed, pseudo_threshold, fold,
                             test is not None)
    rows.unpersist()
    return out


def filled_fold_scores(
    rows: DataFrame, features: Sequence[str], model: str, f: int, preset: Preset | None = None,
    seed: int = K.SEED, pseudo_threshold: float | None = None, fold: str = "fold",
    with_test: bool = True,
) -> DataFrame:
    """Scores of held-out (and test) rows of what ``fold_rows`` gives, by a model of its fit rows."""
    preset = preset or PRESETS[model]
    part = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    own = part("fit")
    if preset.scaled:
        centre = moments(own, list(features))
        rows = apply_moments(rows, centre)
        own = part("fit")
    fitted = fit(own, features, preset, seed)
    if pseudo_threshold is not None and with_test:
        more = augment(own, score(fitted, part("test"), features), pseudo_threshold)
        fitted = fit(more.drop("is_pseudo"), features, preset, seed)
    return reduce(lambda a, b: a.unionByName(b), [
        score(fitted, part(source), features).select(
            "record_id", F.lit(model).alias("model"), F.lit(seed).alias("seed"),
            F.lit(f).alias(fold), F.lit(kind).alias("kind"), "p")
        for source, kind in [("held", "oof"), *[("test", "test")] * with_test]])


def stack(
    oof: DataFrame, test: DataFrame | None, models: Sequence[str], k: int = K.FOLDS,
    strength: float = 1.0, fold: str = "fold",
) -> DataFrame:
    """Logistic regression over model columns, scored out of fold: (record_id, kind, p).

    ``oof`` is wide: record_id, one column per model, target, fold.  The inverse penalty
    ``strength`` C maps to regParam 1 / (C n) on n fitting rows.
    """
    parts = []
    sizes = {r[fold]: r["n"] for r in oof.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    for f in range(k):
        n = max(total - sizes.get(f, 0), 1)
        preset = PRESETS["logistic"].with_settings(strength=1.0 / (strength * n))
        fitted = fit(fold_complement(oof, f, fold), models, preset)
        parts.append(score(fitted, oof.where(F.col(fold) == f), models).select(
            "record_id", F.lit("oof").alias("kind"), "p"))
    if test is not None:
        preset = PRESETS["logistic"].with_settings(strength=1.0 / (strength * max(total, 1)))
        fitted = fit(oof, models, preset)
        parts.append(score(fitted, test, models).select(
            "record_id", F.lit("test").alias("kind"), "p"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def baseline(
    text: Sequence[str], numbers: Sequence[str], iterations: int = 2000, strength: float = 0.0
) -> Pipeline:
    """One-hot text and scaled numbers into a class-weighted logistic regression.

    Fills run before the pipeline (``mode_impute``, ``median_impute``) because the built-in imputer
    is approximate.  Values not seen when fitting get all-zero flags.
    """
    index = StringIndexer(inputCols=list(text), outputCols=[f"{c}_index" for c in text],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    flags = OneHotEncoder(inputCols=[f"{c}_index" for c in text],
                          outputCols=[f"{c}_flags" for c in text], handleInvalid="keep")
    gather = VectorAssembler(inputCols=list(numbers), outputCol="numbers")
    scale = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)
    join = VectorAssembler(inputCols=[*[f"{c}_flags" for c in text], "scaled"],
                           outputCol="features")
    return Pipeline(stages=[index, flags, gather, scale, join, logistic(strength, iterations)])


def fit_baseline(
    train: DataFrame, text: Sequence[str], numbers: Sequence[str], iterations: int = 2000,
    strength: float = 1.0,
) -> PipelineModel:
    """The inverse penalty ``strength`` C maps to regParam 1 / (C n) on n rows."""
    n = max(train.count(), 1)
    return baseline(text, numbers, iterations, 1.0 / (strength * n)).fit(add_class_weight(train))


def score_baseline(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(all columns of df, p)."""
    scored = model.transform(df.withColumn("weight", F.lit(1.0)))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("p"))


