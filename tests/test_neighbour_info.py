"""Neighbour-based information against a plain version over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import ranks
from foldstone.operators.neighbour_info import digamma, neighbour_distances, neighbour_information


def psi(n: int) -> float:
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def plain(pairs, k=3):
    pairs = [(x, y) for x, y in pairs if x is not None and x == x and y is not None]
    sizes = {y: sum(b == y for _, b in pairs) for _, y in pairs}
    pairs = [(x, y) for x, y in pairs if sizes[y] > 1]
    if not pairs:
        return None
    xs = np.array([x for x, _ in pairs])
    total = 0.0
    for i, (x, y) in enumerate(pairs):
        own = sorted(abs(x - b) for j, (b, c) in enumerate(pairs) if c == y and j != i)
        used = min(k, len(own))
        r = own[used - 1]
        near = int(np.sum(xs == x)) if r == 0 else int(np.sum((xs > x - r) & (xs < x + r)))
        total += psi(used) - psi(sizes[y]) - psi(near)
    return max(0.0, psi(len(pairs)) + total / len(pairs))


def table(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0, 0, 0, 1, 2])
        rows.append((y, y + rng.gauss(0, 1), float(rng.randrange(6)), 4.0,
                     0.0 if rng.random() < 0.4 else rng.random(), rng.choice([None, -0.0, 0.0, 1.0])))
    rows += [(9, 1.0, 1.0, 4.0, 0.5, 1.0), (None, 1.0, 1.0, 4.0, 0.5, 1.0),
             (0, float("nan"), 2.0, 4.0, 0.1, None), (7, 50.0, 2.0, 4.0, 0.2, 1.0),
             (7, 50.5, 2.0, 4.0, 0.3, 1.0)]
    return rows


COLUMNS = ["near", "coarse", "constant", "mostly", "zeros"]


@pytest.mark.parametrize("bits, k", [(10, 3), (3, 3), (6, 1), (2, 5)])
def test_information_equals_all_pairs(spark, monkeypatch, bits, k):
    monkeypatch.setattr(ranks, "RANGE_BITS", bits)
    rows = table()
    df = spark.createDataFrame(rows, "target int, " + ", ".join(f"{c} double" for c in COLUMNS))
    found = {r["name"]: r["mi"] for r in neighbour_information(df, COLUMNS, k=k).collect()}
    for i, c in enumerate(COLUMNS):
        want = plain([(r[i + 1], r[0]) for r in rows], k)
        assert found[c] == pytest.approx(want, abs=1e-9), c
    assert found["near"] > 0.1 and found["constant"] == 0


def test_information_of_nothing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (None, 3.0)], "target int, x double")
    assert neighbour_information(df, ["x"]).count() == 0  # every label has one row


def test_distances_cross_many_short_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_BITS", 6)
    values = sorted({round(random.Random(i).random(), 3) for i in range(120)})
    df = spark.createDataFrame([("a", v, 1) for v in values], "g string, value double, c long")
    got = {r["value"]: r["radius"] for r in neighbour_distances(df, ["g"], 4).collect()}
    for v in values:
        assert got[v] == sorted(abs(v - w) for w in values)[4]


def test_hot_value_is_one_row(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 2).cast("int").alias("target"),
        F.when(F.col("id") % 3 > 0, F.lit(1.0)).otherwise(F.rand(1)).alias("x"))
    assert 0 <= neighbour_information(df, ["x"]).first().mi < 0.05


def test_digamma(spark):
    rows = spark.range(1, 60).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-10) for r in rows)
