"""Distributed ranks, running totals, quantiles and neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldstone.operators import folds, metrics, nearest
from foldstone.operators.quantiles import exact_quantiles
from foldstone.operators.ranks import hash_rank, prefix_sums


def skewed(spark, n=6000, seed=1):
    """A third of all rows share one value and one key."""
    rng = np.random.default_rng(seed)
    p = rng.random(n).round(4)
    k = rng.integers(0, 5, n)
    hot = rng.random(n) < 0.34
    p[hot], k[hot] = 0.25, 0
    y = (rng.random(n) < 0.2 + 0.6 * p).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "k": k, "p": p, "y": y})
    return pdf, spark.createDataFrame(pdf).persist()


def test_prefix_sums(spark):
    pdf, df = skewed(spark)
    rows = df.groupBy("k", "p").agg(F.sum("y").alias("m"))
    got = prefix_sums(rows, ["k"], "p", ["m"]).toPandas().sort_values(["k", "p"])
    want = got.groupby("k")["m"].cumsum() - got["m"]
    assert (got["m_before"] == want).all() and len(got) == len(pdf.groupby(["k", "p"]))


def test_prefix_sums_null_first_and_text(spark):
    df = spark.createDataFrame([(None, 5), ("b", 1), ("a", 2)], "s string, m int")
    got = {r["s"]: r["m_before"] for r in prefix_sums(df, [], "s", ["m"]).collect()}
    assert got == {None: 0, "a": 5, "b": 7}


def test_hash_rank_is_a_window_rank(spark):
    _, df = skewed(spark)
    got = hash_rank(df, "r", ["id"], 7, part=["k"], order=[("y", False)])
    h = F.md5(F.concat_ws(":", F.lit("7"), F.col("id").cast("string")))
    want = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("y"), h))
    assert got.withColumn("w", want).where("r <> w").count() == 0
    assert got.count() == df.count()


def test_folds_are_balanced(spark):
    _, df = skewed(spark)
    out = folds.stratified_folds(df, key="id", target="y", k=7)
    sizes = out.groupBy("y", "fold").count().toPandas()
    spread = sizes.groupby("y")["count"].agg(lambda s: s.max() - s.min())
    assert (spread <= 1).all() and sizes["fold"].nunique() == 7


def test_group_folds_keep_groups_whole(spark):
    _, df = skewed(spark)
    dealt = folds.group_folds(df.withColumn("g", F.col("id") % 97), "g", "y", k=4)
    assert dealt.count() == 97 and dealt.select("g").distinct().count() == 97
    per = [r["p"] for r in dealt.groupBy("fold").agg(F.sum("positives").alias("p")).collect()]
    assert max(per) - min(per) < 0.1 * sum(per)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (
        len(pos) * len(neg))


def test_auc_with_ties(spark):
    pdf, df = skewed(spark, 2000)
    assert metrics.roc_auc(df, "y", "p").first()["auc"] == pytest.approx(
        brute_auc(pdf["y"].to_numpy(), pdf["p"].to_numpy()), abs=1e-12)
    per = {r["k"]: r["auc"] for r in metrics.roc_auc(df, "y", "p", ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        assert per[k] == pytest.approx(
            brute_auc(part["y"].to_numpy(), part["p"].to_numpy()), abs=1e-12)


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.8)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").first()["auc"] is None
    row = metrics.score_metrics(spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, p double"),
                                "y", "p").first()
    assert (row["f1"], row["auc"]) == (0.0, 1.0)


@pytest.mark.parametrize("size", [7, 60_000])
def test_quantiles(spark, size):
    pdf, df = skewed(spark, size)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    rows = exact_quantiles(df, ["p", "id"], probs, ["k"]).collect()
    assert len(rows) == pdf["k"].nunique() * 2 * len(probs)
    for r in rows:
        part = pdf[pdf["k"] == r["k"]][r["name"]]
        assert r["value"] == pytest.approx(np.quantile(part, r["prob"]), abs=1e-9)


@pytest.mark.parametrize("cell_rows", [8, 100_000])
def test_nearest_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(3)
    ref = np.concatenate([rng.normal(0, 1, (700, 3)), np.tile([[0.5, 0.5, 0.0]], (400, 1)),
                          rng.normal(20, 0.01, (100, 3))]).round(2)
    ask = np.concatenate([rng.normal(0, 2, (150, 3)), ref[:20], [[0.5, 0.5, 0.0]] * 80]).round(2)
    rdf = spark.createDataFrame(pd.DataFrame(ref, columns=list("abc")).assign(
        rid=np.arange(len(ref))))
    qdf = spark.createDataFrame(pd.DataFrame(ask, columns=list("abc")).assign(
        qid=np.arange(len(ask))))
    qdf = qdf.withColumn("c", F.when(F.col("c") != 0, F.col("c")))  # missing counts as 0
    got = nearest.nearest_join(qdf, rdf, ["a", "b", "c"], "qid", "rid").toPandas().set_index("qid")
    assert len(got) == len(ask)
    d2 = ((ask[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2)
    for i in range(len(ask)):
        assert got.loc[i, "distance"] == pytest.approx(np.sqrt(d2[i].min()), abs=1e-9)
        assert d2[i, got.loc[i, "rid"]] == pytest.approx(d2[i].min(), abs=1e-12)
    assert (got.loc[170:, "rid"] == 700).all()  # smallest id of the copies


def test_nearest_without_reference(spark):
    q = spark.createDataFrame([(1, 2.0)], "qid int, a double")
    r = spark.createDataFrame([], "rid int, a double")
    assert [tuple(x) for x in nearest.nearest_join(q, r, ["a"], "qid", "rid").collect()] == [
        (1, None, None)]
