"""Calibration p -> sigmoid(s * logit(p) + c) chosen on a grid, in one scan of the scores.

For s > 0 the map keeps the order of scores, so AUC is the same at every grid point, and
``p >= 0.5`` after calibration is ``logit(p) >= -c / s``.  Each row therefore only needs to know
between which two of the grid's limits it lies; counting rows per interval gives the confusion
counts of every grid point.  Rows are never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import scalar as S
from foldstone.operators.metrics import composite, f1_of, label_of, roc_auc
from foldstone.operators.ranks import prefix_sums

Grid = tuple[float, float, int, float, float, int]


def linear(start: float, stop: float, points: int, index):
    """Point ``index`` of an even grid whose last point is exactly ``stop``."""
    if points == 1:
        return F.lit(float(start))
    step = (stop - start) / (points - 1)
    inner = F.lit(float(start)) + index * F.lit(step)
    return F.when(index == points - 1, F.lit(float(stop))).otherwise(inner)


def grid_table(spark: SparkSession, grid: Grid) -> DataFrame:
    """(s, c, limit): every grid point with the log-odds from which it predicts 1."""
    s0, s1, ns, c0, c1, nc = grid
    index = F.col("id")
    return (
        spark.range(ns * nc)
        .select(linear(s0, s1, ns, F.floor(index / nc)).alias("s"),
                linear(c0, c1, nc, index % nc).alias("c"))
        # "+ 0.0" makes -0.0 and 0.0 one limit
        .withColumn("limit", -F.col("c") / F.col("s") + F.lit(0.0))
    )


def counts_by_limit(
    scores: DataFrame, grid: DataFrame, y: str, p: str, by: Sequence[str] = (),
    complement: bool = False,
) -> DataFrame:
    """(by..., limit, tp, fp, pos, neg): counts of rows at or above each distinct grid limit.

    With ``complement`` the counts of each group are those of all other groups together.
    """
    by = list(by)
    # Halving steps 2**k ... 2, 1 that reach every one of the limits.
    found = grid.agg(F.sort_array(F.collect_set("limit")).alias("limits"))
    top = F.floor(F.log2(F.size("limits") + F.lit(1.0))).cast("int")
    halves = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k)
                         .cast("int"))
    box = found.select(F.struct("limits", halves.alias("steps"))).scalar()
    known = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        *by, F.col(y).cast("int").alias("y"), S.logit(F.col(p)).alias("l")
    ).withColumn("box", box)

    def search(low, step):
        return F.when(F.get(F.col("box.limits"), low + step - 1) <= F.col("l"), low + step).otherwise(low)

    # At most (limits + 1) rows per group from here on, combined map-side.
    cells = (
        known.select(*by, "y", F.aggregate(F.col("box.steps"), F.lit(0), search).alias("slot"))
        .groupBy(*by, "slot")
        .agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    )
    edges = grid.select("limit").distinct().agg(
        F.sort_array(F.collect_list("limit")).alias("limits")).select(
        F.posexplode("limits").alias("at", "limit")).withColumn("slot", F.col("at") + 1)
    groups = cells.select(*by).distinct() if by else None
    blank = edges.agg(F.max("slot").alias("top"))
    top = blank.scalar()
    if by:
        empty = groups.select(*by, F.explode(F.sequence(F.lit(0), top)).alias("slot"))
    else:
        empty = blank.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("slot"))
    full = cells.unionByName(empty.withColumns(
        {"pos": F.lit(0).cast("bigint"), "neg": F.lit(0).cast("bigint")})).groupBy(
        *by, "slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if complement:
        slot = Window.partitionBy("slot")
        full = full.withColumns({m: F.sum(m).over(slot) - F.col(m) for m in ("pos", "neg")})
    above = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    summed = full.select(
        *by, "slot", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("pos"), F.sum("neg").over(whole).alias("neg"))
    return summed.join(F.broadcast(edges.select("slot", "limit")), "slot").drop("slot")


def grid_f1(
    scores: DataFrame, grid: Grid, y: str = "target", p: str = "p", by: Sequence[str] = (),
    complement: bool = False,
) -> DataFrame:
    """(by..., s, c, tp, fp, fn, f1) at every grid point."""
    table = grid_table(scores.sparkSession, grid)
    counts = counts_by_limit(scores, table, y, p, by, complement)
    joined = counts.join(F.broadcast(table), "limit")
    fn = F.col("pos") - F.col("tp")
    return joined.select(*by, "s", "c", "tp", "fp", fn.alias("fn"),
                         f1_of(F.col("tp"), F.col("fp"), fn).alias("f1"))


def clipped_auc(scores: DataFrame, y: str, p: str) -> DataFrame:
    """One-row AUC of the clipped log-odds, the value shared by all grid points."""
    return roc_auc(scores.select(F.col(y).alias("y"), S.logit(F.col(p)).alias("l")), "y", "l")


def calibration_scores(
    scores: DataFrame, grid: Grid, y: str = "target", p: str = "p"
) -> DataFrame:
    """(s, c, tp, fp, fn, f1, auc, score) at every grid point."""
    auc = clipped_auc(scores, y, p).scalar()
    return grid_f1(scores, grid, y, p).withColumn("auc", auc).withColumn(
        "score", composite(F.col("f1"), F.col("auc")))


def best_point(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best grid point per group: highest F1 (AUC is constant), first in (s, c) order on ties."""
    order = F.struct((-F.col("f1")).alias("f"), "s", "c")
    return points.groupBy(*by).agg(F.min(order).alias("m")).select(
        *by, F.col("m.s").alias("s"), F.col("m.c").alias("c"), (-F.col("m.f")).alias("f1"))


def calibrate_shift(
    scores: DataFrame, y: str = "target", p: str = "p", grid: Grid = K.CALIBRATION_GRIDS["shift"]
) -> DataFrame:
    """One row (c, f1, auc, score): the best shift, or 0 when none beats the raw scores."""
    hit, label = label_of(F.col(p)) == 1, F.col(y) == 1
    raw = scores.where(F.col(y).isNotNull()).agg(f1_of(
        F.count_if(hit & label), F.count_if(hit & ~label), F.count_if(~hit & label))).scalar()
    best = best_point(grid_f1(scores, grid, y, p))
    auc = roc_auc(scores, y, p).scalar()
    gated = best.select("c", "f1", raw.alias("raw"), auc.alias("auc")).select(
        F.when(F.col("f1") > F.col("raw"), F.col("c")).otherwise(0.0).alias("c"),
        F.greatest("f1", "raw").alias("f1"), "auc")
    return gated.withColumn("score", composite(F.col("f1"), F.col("auc")))


def complement_auc(
    scores: DataFrame, fold: str, k: int, y: str = "target", p: str = "p"
) -> DataFrame:
    """(fold, auc) of all rows outside each fold, from one ordering of the scores.

    Every distinct score carries its counts per fold, so leaving one fold out is a subtraction and
    rows are not repeated once per fold.
    """
    label = F.col("y") == 1
    per_score = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(fold).alias("f"), F.col(y).alias("y"), S.logit(F.col(p)).alias("l")
    ).groupBy("l").agg(
        *[F.count_if((F.col("f") == i) & label).alias(f"pos{i}") for i in range(k)],
        *[F.count_if((F.col("f") == i) & ~label).alias(f"neg{i}") for i in range(k)])
    ranked = prefix_sums(per_score, [], "l", [f"neg{i}" for i in range(k)])

    def rest(prefix, i, suffix=""):
        kept = [F.col(f"{prefix}{j}{suffix}") for j in range(k) if j != i]
        total = kept[0]
        for column in kept[1:]:
            total = total + column
        return total

    measures = []
    for i in range(k):
        pos, neg = rest("pos", i), rest("neg", i)
        wins = pos.cast("double") * (rest("neg", i, "_before") + neg / F.lit(2.0))
        measures.append(F.try_divide(
            F.sum(wins), F.sum(pos).cast("double") * F.sum(neg)).alias(f"auc{i}"))
    wide = ranked.agg(*measures)
    return wide.select(F.posexplode(F.array(*[f"auc{i}" for i in range(k)])).alias(fold, "auc"))


def nested_points(
    scores: DataFrame, fold: str = "fold", k: int = K.FOLDS, y: str = "target", p: str = "p",
    grid: Grid = K.CALIBRATION_GRIDS["nested"],
) -> DataFrame:
    """(fold, s, c, f1, auc, score): the point chosen for each fold on the other folds."""
    best = best_point(grid_f1(scores, grid, y, p, [fold], complement=True), [fold])
    auc = complement_auc(scores, fold, k, y, p)
    return best.join(F.broadcast(auc), fold).withColumn(
        "score", composite(F.col("f1"), F.col("auc")))


def nested_calibration(
    scores: DataFrame, fold: str = "fold", k: int = K.FOLDS, y: str = "target", p: str = "p",
    grid: Grid = K.CALIBRATION_GRIDS["nested"],
) -> DataFrame:
    """Add ``p_cal``: each row calibrated by the point fitted on the folds it is not in."""
    best = best_point(grid_f1(scores, grid, y, p, [fold], complement=True), [fold])
    # one row per fold
    joined = scores.join(F.broadcast(best.select(fold, "s", "c")), fold)
    return joined.withColumn(
        "p_cal", S.calibrated(F.col(p), F.col("s"), F.col("c"))).drop("s", "c")


def apply_point(scores: DataFrame, point: DataFrame, p: str = "p") -> DataFrame:
    """Add ``p_cal`` from a one-row (s, c) table."""
    sc = point.select(F.struct("s", "c")).scalar()
    return scores.withColumn("__sc", sc).withColumn(
        "p_cal", S.calibrated(F.col(p), F.col("__sc.s"), F.col("__sc.c"))).drop("__sc")


def count_shift(
    scores: DataFrame, wanted, p: str = "p",
    grid: tuple[float, float, int] = K.COUNT_SHIFT_GRID,
) -> DataFrame:
    """One row (c, positives, gap): the shift whose number of positives is closest to ``wanted``
    (a number or a one-row scalar); the first such shift wins."""
    table = grid_table(scores.sparkSession, (1.0, 1.0, 1, *grid))
    labelled = scores.withColumn("__one", F.lit(1))
    counts = counts_by_limit(labelled, table, "__one", p)
    goal = wanted if not isinstance(wanted, (int, float)) else F.lit(wanted)
    points = counts.join(F.broadcast(table), "limit").select(
        "c", F.col("tp").alias("positives")).withColumn("goal", goal).withColumn(
        "gap", F.abs(F.col("positives") - F.col("goal")))
    return points.agg(F.min(F.struct("gap", "c", "positives")).alias("m")).select(
        F.col("m.c").alias("c"), F.col("m.positives").alias("positives"), F.col("m.gap")
        .alias("gap"))
