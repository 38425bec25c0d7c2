"""Seeded random search over the settings of a model family."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.operators.folds import stratified_folds
from foldstone.operators.impute import fold_medians
from foldstone.operators.metrics import score_metrics
from foldstone.plans.grid import WORKERS, Grid, fingerprint, together
from foldstone.plans.models import PRESETS, cross_fit, fold_scores, stored_fills
from foldstone.session import checkpoint

#: Settings fitted side by side, each with its folds.
SETTINGS = 2
WHOLE = ("trees", "depth", "leaf_rows")


def draw(family: str, trials: int, seed: int = K.SEED) -> list[dict[str, float]]:
    """Seeded random settings from the family's ranges (log-uniform where so marked)."""
    rng = random.Random(f"{family}:{seed}")
    out = []
    for _ in range(trials):
        point = {}
        for name, (low, high, log) in K.TUNING_RANGES[family].items():
            value = (math.exp(rng.uniform(math.log(low), math.log(high))) if log
                     else rng.uniform(low, high))
            point[name] = float(min(max(round(value), low), high)) if name in WHOLE else value
        out.append(point)
    return out


def trials_for(family: str, trials: int) -> int:
    """The slowest family gets half the trials, but at least fifteen."""
    return max(15, trials // 2) if family == "ordered" else trials


def tune(
    df: DataFrame, features: Sequence[str], families: Sequence[str], trials: int = K.TUNING_TRIALS,
    seeds: Sequence[int] = K.TUNING_SEEDS, k: int = K.FOLDS, points: dict | None = None,
) -> DataFrame:
    """(model, trial, score, params): mean cross-validated score of each drawn setting.

    ``df`` carries record_id, the features and target.  ``points`` replaces the drawn settings.
    Settings are fitted side by side, each a set of Spark jobs; only scores reach the driver.
    """
    # Folds depend on the seed only: write them once and read them for every setting; so do fills.
    folded = {s: checkpoint(stratified_folds(df, k=k, seed=s)) for s in seeds}
    fills = {s: fold_medians(folded[s], features, k) for s in seeds}

    def trial(family: str, i: int, point: dict) -> tuple:
        scores = []
        for seed in seeds:
            preset = PRESETS[family].with_settings(**point)
            oof = cross_fit(folded[seed], None, features, family, preset, k=k, seed=seed,
                            fills=fills[seed])
            labelled = oof.join(folded[seed].select("record_id", "target"), "record_id")
            scores.append(score_metrics(labelled).first()["score"])
        return family, i, sum(scores) / len(scores), point

    drawn = {f: (points or {}).get(f) or draw(f, trials_for(f, trials)) for f in families}
    rows = together(df.sparkSession, [
        lambda f=f, i=i, point=point: trial(f, i, point)
        for f in families for i, point in enumerate(drawn[f])], SETTINGS)
    return df.sparkSession.createDataFrame(
        rows, "model string, trial int, score double, params map<string,double>")


def rungs(cells: int, first: int) -> list[int]:
    """How many of its cells a setting has been fitted on at each rung: doubling, then all."""
    sizes = [min(max(first, 1), cells)]
    while sizes[-1] < cells:
        sizes.append(min(sizes[-1] * 2, cells))
    return sizes


def tune_in_rungs(
    df: DataFrame, features: Sequence[str], families: Sequence[str], trials: int = K.TUNING_TRIALS,
    seeds: Sequence[int] = K.TUNING_SEEDS, k: int = K.FOLDS, points: dict | None = None,
    keep: float = 0.5, folder: str | None = None, workers: int = WORKERS,
) -> DataFrame:
    """(model, trial, rung, cells, finished, score, params): search with early elimination.

    A setting's work is a list of cells, each fold of each seed, seeds in turn.  Every rung fits
    the settings that are left on twice as many cells as the one before, scores the rows held out
    so far and goes on with the best ``keep`` of them; the last rung has seen every cell, so
    settings that reach it (``finished``) carry the same score as a full search gives them.
    Cells of a rung are fitted concurrently and stored: pass ``folder`` to resume.
    """
    df = df.select("record_id", "target", *features)
    spark = df.sparkSession
    grid = Grid(spark, folder, ("tune", fingerprint(df), k, *features), workers)
    grid.run({f"folds/seed={s}": (lambda s=s: stratified_folds(df, k=k, seed=s)) for s in seeds})
    fills = {s: stored_fills(grid, f"fills/seed={s}", lambda s=s: grid.read([f"folds/seed={s}"]),
                             features, k) for s in seeds}
    order = [(s, f) for f in range(k) for s in seeds]
    out = []
    for family in families:
        drawn = (points or {}).get(family) or draw(family, trials_for(family, trials))
        # a cell belongs to its setting, so a longer search takes up what a shorter one fitted
        names = [hashlib.md5(repr(sorted(p.items())).encode()).hexdigest() for p in drawn]

        def cell(i: int, seed: int, fold: int):
            def make() -> DataFrame:
                folded = grid.read([f"folds/seed={seed}"])
                preset = PRESETS[family].with_settings(**drawn[i])
                held = fold_scores(folded, None, features, family, fold, preset, seed,
                                   fills=fills[seed][fold])
                return held.join(folded.select("record_id", "target"), "record_id").select(
                    "record_id", "target", "seed", "p")
            return make

        def key(i: int, seed: int, fold: int) -> str:
            return f"{family}/{names[i]}/seed={seed}/fold={fold}"

        left, seen, sizes = list(range(len(drawn))), {}, rungs(len(order), len(seeds))
        for r, size in enumerate(sizes):
            grid.run({key(i, *c): cell(i, *c) for i in left for c in order[:size]})
            held = None
            for i in left:
                part = grid.read([key(i, *c) for c in order[:size]]).withColumn("trial", F.lit(i))
                held = part if held is None else held.unionByName(part)
            scores = score_metrics(held, by=["trial", "seed"]).groupBy("trial").agg(
                F.avg("score").alias("score")).collect()  # one row per setting that is left
            seen.update({s["trial"]: (r, size, s["score"]) for s in scores})
            if size < len(order):
                ranked = sorted(left, key=lambda i: (-(seen[i][2] or 0.0), i))
                left = sorted(ranked[:max(1, math.ceil(len(left) * keep))])
        out += [(family, i, seen[i][0], seen[i][1], seen[i][1] == len(order), seen[i][2], drawn[i])
                for i in range(len(drawn)) if i in seen]
    return spark.createDataFrame(
        out, "model string, trial int, rung int, cells int, finished boolean, score double, "
             "params map<string,double>")


def best_trials(trials: DataFrame) -> DataFrame:
    """(model, score, params) of the best trial per family, the earliest on a tie."""
    return trials.groupBy("model").agg(F.min_by(
        F.struct("score", "params"), F.struct((-F.col("score")).alias("s"), "trial"))
        .alias("b")).select("model", "b.score", "b.params")
