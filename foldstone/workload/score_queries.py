"""Folds, encodings, metrics, blends, calibration, pseudo-labels and prediction checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from foldstone import constants as K
from foldstone.functions import scalar as S
from foldstone.functions.features import add_features
from foldstone.operators import blend, calibrate, encode, folds, joins, metrics, pseudo, verify
from foldstone.session import shared_folder
from foldstone.sources.publish import publish, read_published
from foldstone.sources.sinks import to_predictions
from foldstone.sources.tables import PREDICTION_SCHEMA, scan_prediction_files, table
from foldstone.workload import fixtures as X
from foldstone.workload.feature_queries import _age_case
from foldstone.workload.registry import query, tidy

BOOSTED = ("leafwise", "levelwise", "ordered")

_KEYED = (f"select *, cast({_age_case('age')} as varchar) as age_group, "
          "cast(month(try_cast(deathdate as date)) as varchar) as month, "
          "cast(year(try_cast(deathdate as date)) as varchar) as year, "
          "cast(quarter(try_cast(deathdate as date)) as varchar) as quarter from ")
_ENCODED = ("age_group", "month", "year", "quarter", "location")


# ------------------------------------------------------------------ folds


@query("stratified_folds", X.with_views("select record_id, target, fold from folded", "folded"))
def stratified_folds(spark, sf):
    df = X.train(spark, sf).select("record_id", "target")
    return folds.stratified_folds(df).select("record_id", "target", "fold")


@query("stratified_split", X.with_views(
    "select record_id, target, case when row_number() over (partition by target order by "
    "md5(concat('42:', cast(record_id as varchar)))) <= count(*) over (partition by target) * 0.2e0 "
    "then 'valid' else 'fit' end as part from train", "train"))
def stratified_split(spark, sf):
    df = X.train(spark, sf).select("record_id", "target")
    return folds.stratified_split(df).select("record_id", "target", "part")


@query("group_folds", X.with_views(
    "select record_id, location, fold from train join (select location, cast((row_number() over "
    "(order by positives desc, n desc, md5(concat('42:', location))) - 1) % 5 as int) as fold from "
    "(select location, count(*) n, sum(target) positives from train group by location)) "
    "using (location)", "train"))
def group_folds(spark, sf):
    df = X.train(spark, sf).select("record_id", "location", "target")
    dealt = folds.group_folds(df, "location")
    return df.join(dealt.select("location", "fold"), "location").select(
        "record_id", "location", "fold")


# a step of the walk gives one left-over group to the fold of least load (whole numbers throughout)
_GREEDY_SQL = """g as (select location, count(*) as n, sum(target) as p from train
    where location is not null group by location),
  t as (select sum(n)::hugeint as all_n, greatest(sum(p), 1)::hugeint as all_p from g),
  shapes as (select n, p, count(*) as m, p * any_value(all_n) + n * any_value(all_p) as w
             from g, t group by n, p),
  items as (select n, p, w, i, row_number() over (order by w desc, n desc, i) as j
            from (select n, p, w, unnest(range(m % 5)) as i from shapes)),
  walk as (select 0::bigint as j, [0, 0, 0, 0, 0]::hugeint[] as loads, null::int as fold
    union all select items.j, list_transform(range(1, 6), lambda x: loads[x] + case
      when x = list_position(loads, list_min(loads)) then w else 0 end)::hugeint[],
      (list_position(loads, list_min(loads)) - 1)::int
    from walk join items on items.j = walk.j + 1),
  ranked as (select location, n, p, row_number() over (partition by n, p order by
      md5(concat('42:', location)), location) - 1 as spot from g),
  dealt as (select r.location, case when spot < m - m % 5 then (spot % 5)::int else walk.fold end as fold
    from ranked r join shapes s on s.n = r.n and s.p = r.p
    left join items on items.n = r.n and items.p = r.p and items.i = spot - (m - m % 5)
    left join walk on walk.j = items.j)"""


@query("group_folds_greedy", X.with_views("", "train").rstrip().replace("with ", "with recursive ", 1)
       + ", " + _GREEDY_SQL
       + " select record_id, location, fold from train join dealt using (location)")
def group_folds_greedy(spark, sf):
    """Whole places in folds of level rows and positives."""
    df = X.train(spark, sf).select("record_id", "location", "target")
    dealt = folds.greedy_group_folds(df, "location")
    return df.join(dealt.select("location", "fold"), "location").select(
        "record_id", "location", "fold")


@query("class_weights", X.with_views(
    "select target, count(*) as row_count, round(sum(count(*)) over () / "
    "(count(*) over () * count(*)), 6) as weight from train group by target", "train"))
def class_weights(spark, sf):
    return tidy(folds.class_weights(X.train(spark, sf)).withColumnRenamed("rows", "row_count"))


@query("fold_complement_stats", X.with_views(
    "select k.fold, count(*) as row_count, round(avg(target), 6) as rate from folded f join "
    "(select distinct fold from folded) k on f.fold <> k.fold group by k.fold", "folded"))
def fold_complement_stats(spark, sf):
    df = folds.stratified_folds(X.train(spark, sf).select("record_id", "target"))
    return tidy(folds.complement_rates(df).withColumnRenamed("rows", "row_count"))


# ------------------------------------------------------------------ encodings

_MEAN = "(select avg(target) from keyed)"


def _oof_sql(c: str) -> str:
    rest_s = f"sum(target) over (partition by {c}) - sum(target) over (partition by {c}, fold)"
    rest_n = f"count(*) over (partition by {c}) - count(*) over (partition by {c}, fold)"
    return (f"round(case when {c} is null then {_MEAN} else ({rest_s} + 10 * {_MEAN}) / "
            f"({rest_n} + 10) end, 6) as {c}_te")


def _keyed(df):
    return add_features(df).select("record_id", "target", *_ENCODED)


@query("target_encode_oof", X.with_views(
    f"select record_id, fold, {', '.join(_oof_sql(c) for c in _ENCODED)} from keyed", "folded",
    keyed=_KEYED + "folded"))
def target_encode_oof(spark, sf):
    df = folds.stratified_folds(_keyed(X.train(spark, sf)))
    out = encode.target_encode_oof(df, _ENCODED)
    return tidy(out.select("record_id", "fold", *[f"{c}_te" for c in _ENCODED]))


@query("target_encode_full", X.with_views(
    "select record_id, " + ", ".join(
        f"round(coalesce((select (sum(k.target) + 10 * {_MEAN}) / (count(*) + 10) from keyed k "
        f"where k.{c} = t.{c} having count(*) > 0), {_MEAN}), 6) as {c}_te" for c in _ENCODED)
    + " from unseen t", "train", "test",
    keyed=_KEYED + "train", unseen=_KEYED + "test"))
def target_encode_full(spark, sf):
    unseen = add_features(X.test(spark, sf)).select("record_id", *_ENCODED)
    out = encode.target_encode_full(_keyed(X.train(spark, sf)), unseen, _ENCODED)
    return tidy(out.select("record_id", *[f"{c}_te" for c in _ENCODED]))


# ------------------------------------------------------------------ metrics

_AUC = ("sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg))")


def _auc_sql(source: str, by: str, y: str = "target", p: str = "p") -> str:
    """(by, auc) from one sorted pass per group."""
    return (f"select {by}, {_AUC} as auc from (select {by}, pos, neg, coalesce(sum(neg) over "
            f"(partition by {by} order by {p} rows between unbounded preceding and 1 preceding), 0) "
            f"as before from (select {by}, {p}, cast(count(*) filter ({y} = 1) as double) as pos, "
            f"cast(count(*) filter ({y} = 0) as double) as neg from {source} group by all)) "
            f"group by {by}")


def _counts_sql(source: str, by: str, p: str = "p") -> str:
    return (f"select {by}, count(*) filter ({p} >= 0.5 and target = 1) as tp, "
            f"count(*) filter ({p} >= 0.5 and target = 0) as fp, "
            f"count(*) filter ({p} < 0.5 and target = 1) as fn, "
            f"count(*) filter ({p} < 0.5 and target = 0) as tn from {source} group by {by}")


_F1 = "case when 2 * tp + fp + fn = 0 then 0e0 else 2 * tp / (2 * tp + fp + fn) end"
_LABELLED = "select * from longs where split = 'train'"


@query("auc_by_model", X.with_views(
    "select model, round(auc, 6) as auc from aucs", "longs",
    labelled=_LABELLED, aucs=_auc_sql("labelled", "model")))
def auc_by_model(spark, sf):
    df = X.long_scores(spark, sf).where("split = 'train'")
    return tidy(metrics.roc_auc(df, by=["model"]))


@query("composite_score", X.with_views(
    f"select model, round({_F1}, 6) as f1, round(auc, 6) as auc, "
    f"round(0.6e0 * {_F1} + 0.4e0 * auc, 6) as score from counts join aucs using (model)", "longs",
    labelled=_LABELLED, aucs=_auc_sql("labelled", "model"), counts=_counts_sql("labelled", "model")))
def composite_score(spark, sf):
    df = X.long_scores(spark, sf).where("split = 'train'")
    return tidy(metrics.score_metrics(df, by=["model"]))


@query("confusion_f1", X.with_views(
    f"select lang, tp, fp, fn, tn, round({_F1}, 6) as f1 from counts", "docs",
    counts=_counts_sql("docs", "lang")))
def confusion_f1(spark, sf):
    return tidy(metrics.confusion(X.labelled_documents(spark, sf), by=["lang"]))


@query("classification_report", X.with_views(
    "select lang, 1 as label, case when tp + fp = 0 then 0e0 else round(tp / (tp + fp), 6) end "
    "as precision, case when tp + fn = 0 then 0e0 else round(tp / (tp + fn), 6) end as recall, "
    f"round({_F1}, 6) as f1, tp + fn as support from counts union all "
    "select lang, 0, case when tn + fn = 0 then 0e0 else round(tn / (tn + fn), 6) end, "
    "case when tn + fp = 0 then 0e0 else round(tn / (tn + fp), 6) end, "
    "case when 2 * tn + fp + fn = 0 then 0e0 else round(2 * tn / (2 * tn + fp + fn), 6) end, "
    "tn + fp from counts", "docs", counts=_counts_sql("docs", "lang")))
def classification_report(spark, sf):
    return tidy(metrics.classification_report(X.labelled_documents(spark, sf), by=["lang"]))


@query("threshold_label", X.with_views(
    "select record_id, model, cast(p >= 0.5 as int) as label from longs", "longs"))
def threshold_label(spark, sf):
    return X.long_scores(spark, sf).select(
        "record_id", "model", metrics.label_of(F.col("p")).alias("label"))


# ------------------------------------------------------------------ blends


def _weighted(models, weights) -> str:
    return " + ".join(f"{w!r}::double * {m}" for m, w in zip(models, weights, strict=False))


@query("blend_predictions", X.with_views(
    "select record_id, " + ", ".join(
        f"round({_weighted(X.MODELS, w)}, 6) as {n}" for n, w in K.FIXED_BLENDS.items())
    + " from wide", "wide"))
def blend_predictions(spark, sf):
    df = X.wide_scores(spark, sf)
    for name, weights in K.FIXED_BLENDS.items():
        df = blend.blend(df, X.MODELS, weights, name)
    return tidy(df.select("record_id", *K.FIXED_BLENDS))


_MEMBERS = ("select record_id, model, s.seed, (record_id + s.seed) % 5 as fold, "
            "p * (1e0 - cast((record_id + s.seed) % 5 as double) / 7e0) as p from longs, "
            f"(values {', '.join(f'({s})' for s in K.SEED_BAG)}) s(seed)")


@query("fold_average", X.with_views(
    "select record_id, model, round(avg(p), 6) as p, count(*) as members from members "
    "group by record_id, model", "longs", members=_MEMBERS))
def fold_average(spark, sf):
    """Predictions of one model per (seed, fold) averaged per record."""
    seeds = F.explode(F.array(*[F.lit(s) for s in K.SEED_BAG]))
    df = X.long_scores(spark, sf).withColumn("seed", seeds).withColumn(
        "fold", (F.col("record_id") + F.col("seed")) % 5)
    df = df.withColumn("p", F.col("p") * (F.lit(1.0) - F.col("fold").cast("double") / 7.0))
    return tidy(blend.fold_average(df))


@query("prediction_matrix", X.with_views(
    "select record_id, " + ", ".join(f"round({m}, 6) as {m}" for m in X.MODELS) + " from wide",
    "wide"))
def prediction_matrix(spark, sf):
    """The long prediction table pivoted to one column per model."""
    return tidy(blend.to_wide(X.long_scores(spark, sf), X.MODELS, ["record_id"]))


def _blend_views(candidates) -> dict[str, str]:
    models = BOOSTED if len(candidates[0]) == 3 else X.MODELS
    values = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) + '::double' for x in w)}])"
        for i, w in enumerate(candidates))
    p = " + ".join(f"w[{i + 1}] * {m}" for i, m in enumerate(models))
    return {
        "cand": f"select * from (values {values}) t(candidate, w)",
        "mixed": f"select candidate, target, {p} as p from wide, cand where split = 'train'",
        "aucs": _auc_sql("mixed", "candidate"),
        "counts": _counts_sql("mixed", "candidate"),
        "scored": f"select candidate, w, {_F1} as f1, auc, 0.6e0 * {_F1} + 0.4e0 * auc as score "
                  "from cand join counts using (candidate) join aucs using (candidate)",
    }


_BEST = ("select candidate, w, round(f1, 6) as f1, round(auc, 6) as auc, round(score, 6) as score "
         "from scored order by round(scored.score, 10) desc, candidate limit 1")


@query("blend_candidates", X.with_views(
    "select candidate, w, round(f1, 6) as f1, round(auc, 6) as auc, round(score, 6) as score "
    "from scored", "wide", **_blend_views(K.BLEND_CANDIDATES)))
def blend_candidates(spark, sf):
    df = X.wide_scores(spark, sf).where("split = 'train'")
    return tidy(blend.blend_scores(df, BOOSTED, K.BLEND_CANDIDATES))


@query("blend_weight_search", X.with_views(_BEST, "wide", **_blend_views(K.BLEND_CANDIDATES)))
def blend_weight_search(spark, sf):
    df = X.wide_scores(spark, sf).where("split = 'train'")
    return tidy(blend.search_blend(df, BOOSTED, K.BLEND_CANDIDATES))


_SIMPLEX = blend.simplex(4)


@query("blend_simplex_search", X.with_views(_BEST, "wide", **_blend_views(_SIMPLEX)))
def blend_simplex_search(spark, sf):
    df = X.wide_scores(spark, sf).where("split = 'train'")
    return tidy(blend.search_blend(df, X.MODELS, _SIMPLEX))


# ------------------------------------------------------------------ calibration

_LOGIT = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


def _points(start: float, stop: float, n: int) -> str:
    if n == 1:
        return f"(select {start!r}::double as v)"
    step = (stop - start) / (n - 1)
    return (f"(select case when i = {n - 1} then {stop!r}::double else {start!r}::double + i * "
            f"{step!r}::double end as v from range({n}) r(i))")


def _grid_sql(name: str) -> str:
    s0, s1, ns, c0, c1, nc = K.CALIBRATION_GRIDS[name]
    return (f"select '{name}' as grid, a.v as s, b.v as c from {_points(s0, s1, ns)} a, "
            f"{_points(c0, c1, nc)} b")


_FIT = f"select target, {_LOGIT} as l from scores where split = 'train'"
_TALLY = ("select grid, s, c, count(*) filter (s * l + c >= 0 and target = 1) as tp, "
          "count(*) filter (s * l + c >= 0 and target = 0) as fp, "
          "count(*) filter (s * l + c < 0 and target = 1) as fn from fit, points group by all")


def _calibration_sql(*names: str) -> str:
    return X.with_views(
        f"select grid, round(s, 6) as s, round(c, 6) as c, tp, fp, fn, round({_F1}, 6) as f1, "
        f"round(0.6e0 * {_F1} + 0.4e0 * auc, 6) as score from tally, aucs", "scores",
        fit=_FIT, points=" union all ".join(_grid_sql(n) for n in names), tally=_TALLY,
        one="select 1 as g, target, l from fit", aucs=_auc_sql("one", "g", p="l"))


def _calibrations(spark, sf, *names):
    df = X.scores(spark, sf).where("split = 'train'")
    parts = [calibrate.calibration_scores(df, K.CALIBRATION_GRIDS[n]).drop("auc").withColumn(
        "grid", F.lit(n)) for n in names]
    return tidy(reduce(lambda a, b: a.unionByName(b), parts))


@query("calibration_grid", _calibration_sql("nested", "pseudo", "shift"))
def calibration_grid(spark, sf):
    return _calibrations(spark, sf, "nested", "pseudo", "shift")


@query("calibration_grid_wide", _calibration_sql("stacked", "fine"))
def calibration_grid_wide(spark, sf):
    return _calibrations(spark, sf, "stacked", "fine")


@query("calibrate_shift", X.with_views(
    f"select round(case when f1 > raw then c else 0e0 end, 6) as c, round(greatest(f1, raw), 6) as f1, "
    "round(auc, 6) as auc, round(0.6e0 * greatest(f1, raw) + 0.4e0 * auc, 6) as score from "
    f"(select c, {_F1} as f1, (select {_F1} from base) as raw, auc from tally, aucs "
    "order by f1 desc, s, c limit 1)", "scores",
    fit=_FIT, points=_grid_sql("shift"), tally=_TALLY,
    one="select 1 as g, target, p from scores where split = 'train'", aucs=_auc_sql("one", "g"),
    base=_counts_sql("one", "g")))
def calibrate_shift(spark, sf):
    return tidy(calibrate.calibrate_shift(X.scores(spark, sf).where("split = 'train'")))


@query("logit_calibrate", X.with_views(
    f"select record_id, round({_LOGIT}, 6) as log_odds, "
    f"round(1 / (1 + exp(-(1.4e0 * {_LOGIT} - 0.3e0))), 6) as p_cal from scores", "scores"))
def logit_calibrate(spark, sf):
    p = F.col("p")
    return tidy(X.scores(spark, sf).select(
        "record_id", S.logit(p).alias("log_odds"), S.calibrated(p, 1.4, -0.3).alias("p_cal")))


_NESTED = {
    "fit": f"select *, {_LOGIT} as l from calfold",
    "points": _grid_sql("nested"),
    "heldout": "select k.fold as held, f.target, f.l from fit f join (select distinct fold from fit) k "
               "on f.fold <> k.fold",
    "tally": "select held, s, c, count(*) filter (s * l + c >= 0 and target = 1) as tp, "
             "count(*) filter (s * l + c >= 0 and target = 0) as fp, "
             "count(*) filter (s * l + c < 0 and target = 1) as fn from heldout, points group by all",
    "chosen": f"select held, s, c, {_F1} as f1 from tally qualify row_number() over "
              f"(partition by held order by {_F1} desc, s, c) = 1",
}


def _folded_scores(spark, sf):
    df = X.scores(spark, sf).where("split = 'train'")
    return folds.stratified_folds(df, seed=K.CALIBRATION_SEED)


@query("nested_calibration", X.with_views(
    "select record_id, fold, round(1 / (1 + exp(-(s * l + c))), 6) as p_cal "
    "from fit join chosen on fold = held", "calfold", **_NESTED))
def nested_calibration(spark, sf):
    out = calibrate.nested_calibration(_folded_scores(spark, sf))
    return tidy(out.select("record_id", "fold", "p_cal"))


@query("nested_points", X.with_views(
    "select held as fold, round(s, 6) as s, round(c, 6) as c, round(f1, 6) as f1, "
    "round(auc, 6) as auc, round(0.6e0 * f1 + 0.4e0 * auc, 6) as score "
    "from chosen join aucs using (held)", "calfold", **_NESTED,
    aucs=_auc_sql("heldout", "held", p="l")))
def nested_points(spark, sf):
    return tidy(calibrate.nested_points(_folded_scores(spark, sf)))


_SHARE = K.TARGET_POSITIVES / K.TARGET_ROWS


@query("target_count_shift", X.with_views(
    "select round(c, 6) as c, positives, cast(gap as bigint) as gap from (select c, positives, "
    "abs(positives - goal) as gap from (select v as c, count(*) filter (l + v >= 0) as positives "
    f"from fit, {_points(*K.COUNT_SHIFT_GRID)} group by v), "
    f"(select cast(floor(count(*) * {_SHARE!r}::double) as bigint) as goal from fit)) "
    "order by gap, c limit 1", "scores",
    fit=f"select {_LOGIT} as l from scores where split = 'test'"))
def target_count_shift(spark, sf):
    df = X.scores(spark, sf).where("split = 'test'")
    goal = df.agg(F.floor(F.count("*") * F.lit(_SHARE))).scalar()
    return tidy(calibrate.count_shift(df, goal))


# ------------------------------------------------------------------ pseudo-labels


@query("pseudo_label_select", X.with_views(
    "select 'blend' as rule, record_id, round(p, 6) as p, cast(p >= 0.5 as int) as pseudo_label "
    "from scores where split = 'test' and (p < 0.12 or p > 0.88) union all "
    "select 'stack', record_id, round(p, 6), cast(p >= 0.5 as int) "
    "from scores where split = 'test' and (p <= 0.06 or p >= 0.94)", "scores"))
def pseudo_label_select(spark, sf):
    df = X.scores(spark, sf).where("split = 'test'")
    one = pseudo.select_confident(df, *K.PSEUDO_BLEND_BAND, strict=True)
    two = pseudo.select_confident(df, *K.PSEUDO_STACK_BAND)
    both = one.withColumn("rule", F.lit("blend")).unionByName(two.withColumn("rule", F.lit("stack")))
    return tidy(both.select("rule", "record_id", "p", "pseudo_label"))


@query("pseudo_label_augment", X.with_views(
    "select record_id, target, 0 as is_pseudo from scores where split = 'train' union all "
    "select record_id, cast(p >= 0.5 as int), 1 from scores where split = 'test' "
    "and (p <= 0.05 or p >= 1 - 0.05)", "scores"))
def pseudo_label_augment(spark, sf):
    df = X.scores(spark, sf)
    scored = df.where("split = 'test'").drop("target")
    train = df.where("split = 'train'").select("record_id", "target")
    return pseudo.augment(train, scored.withColumn("target", F.lit(None).cast("int")))


@query("pseudo_threshold_counts", X.with_views(
    "select model, t as threshold, count(*) filter (p <= t or p >= 1 - t) as admitted, "
    "count(*) filter ((p <= t or p >= 1 - t) and p >= 0.5) as positives, "
    "round(avg(cast(cast(p >= 0.5 as int) = target as int)) filter (p <= t or p >= 1 - t), 6) "
    "as agreement from longs, (values "
    + ", ".join(f"({t!r}::double)" for t in K.PSEUDO_STUDY) + ") h(t) where split = 'test' "
    "group by all", "longs"))
def pseudo_threshold_counts(spark, sf):
    df = X.long_scores(spark, sf).where("split = 'test'")
    return tidy(pseudo.threshold_study(df, by=["model"], target="target"))


# ------------------------------------------------------------------ prediction sets


@query("verify_predictions", X.with_views(
    "select count(*) as row_count, (select count(*) from test) as expected_rows, "
    "cast(0 as bigint) as missing_cells, count(*) filter (p < 0.5) as label_0, "
    "count(*) filter (p >= 0.5) as label_1, round(min(p), 6) as score_min, "
    "round(max(p), 6) as score_max, round(avg(p), 6) as score_mean, true as threshold_ok, "
    "true as columns_ok, count(*) = (select count(*) from test) as shape_ok "
    "from scores where split = 'test'", "test", "scores"))
def verify_predictions(spark, sf):
    predictions = to_predictions(X.scores(spark, sf).where("split = 'test'"))
    template = X.test(spark, sf).select(F.col("record_id").alias("id"), F.lit(0).alias("label"),
                                        F.lit(0.5).alias("score"))
    return tidy(verify.verify_predictions(predictions, template)
                .withColumnRenamed("rows", "row_count"))


@query("prediction_set_profile", X.with_views(
    "select model as source, count(*) as row_count, count(*) filter (p >= 0.5) as positives, "
    "round(count(*) filter (p >= 0.5) / count(*), 6) as positive_share, "
    "round(avg(p), 6) as mean_score from longs where split = 'test' group by model", "longs"))
def prediction_set_profile(spark, sf):
    df = X.long_scores(spark, sf).where("split = 'test'")
    sets = df.select(F.col("model").alias("source"), metrics.label_of(F.col("p")).alias("label"),
                     F.col("p").alias("score"))
    return tidy(verify.profile_prediction_sets(sets).withColumnRenamed("rows", "row_count"))


def _as_files(df):
    """Prediction columns under the names that prediction files use."""
    return df.select(F.col("record_id").alias("ID"), metrics.label_of(F.col("p")).alias("TargetF1"),
                     F.col("p").alias("TargetRAUC"))


@query("prediction_file_scan", X.with_views(
    "select model as source, count(*) as row_count, count(*) filter (p >= 0.5) as positives, "
    "round(count(*) filter (p >= 0.5) / count(*), 6) as positive_share, "
    "round(avg(p), 6) as mean_score, 0::bigint as rejected from longs where split = 'test' "
    "group by model", "longs"))
def prediction_file_scan(spark, sf):
    """Every model's predictions written as files, found by pattern and profiled per set."""
    root = shared_folder(spark, "sets")
    df = X.long_scores(spark, sf).where("split = 'test'")
    for model in X.MODELS:
        publish(_as_files(df.where(F.col("model") == model)), f"{root}/{model}")
    rows, rejects = scan_prediction_files(spark, [f"{root}/*/data-*"])
    source = F.regexp_extract("source", "/([^/]+)/data-", 1)
    bad = rejects.groupBy(source.alias("source")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("bad"))
    found = verify.profile_prediction_sets(rows.withColumn("source", source))
    # one row per set on both sides
    return tidy(found.join(F.broadcast(bad), "source", "left").withColumnRenamed("rows", "row_count")
                .withColumn("rejected", F.coalesce("bad", F.lit(0)).cast("long")).drop("bad"))


@query("published_copies", X.with_views(
    "select c as copy, cast(record_id as varchar) as id, cast(p >= 0.5 as int) as label, "
    "round(p, 6) as score from scores, (select unnest([1, 2])::int as c) where split = 'test'", "scores"))
def published_copies(spark, sf):
    """One prediction set published to two folders and read back from both."""
    root = shared_folder(spark, "copies")
    paths = [f"{root}/first", f"{root}/second"]
    publish(_as_files(X.scores(spark, sf).where("split = 'test'")), paths)
    copies = [read_published(spark, p, PREDICTION_SCHEMA).select(
        F.lit(i + 1).alias("copy"), F.col("ID").alias("id"), F.col("TargetF1").alias("label"),
        F.col("TargetRAUC").alias("score")) for i, p in enumerate(paths)]
    return tidy(copies[0].unionByName(copies[1]))


@query("duplicate_keys", (
    "select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by all "
    "having count(*) > 1"))
def duplicate_keys(spark, sf):
    """Keys that would make an enrichment join multiply rows."""
    df = table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("k"))
    return joins.duplicate_keys(df, "k").select(
        "k.l_orderkey", "k.l_linenumber", F.col("rows").alias("row_count"))
