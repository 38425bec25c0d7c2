"""Greedy group folds against a plain version, and against dealing in turn."""

import random
from collections import Counter, defaultdict

import pytest

from foldstone.operators import folds


def frame(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows = [(f"g{i}", int(j < p)) for i, (n, p) in enumerate(sizes) for j in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows + [(None, 1)] * 3, "place string, target int")


def plain(sizes, k):
    """Fold loads by giving every group of every shape in turn, one at a time."""
    shapes = Counter(sizes)
    all_rows, all_pos = sum(n for n, _ in sizes), max(sum(p for _, p in sizes), 1)
    even, load = defaultdict(int), [0] * k
    left = {}
    for (n, p), m in sorted(shapes.items(), key=lambda s: (-(s[0][1] * all_rows + s[0][0] * all_pos),
                                                           -s[0][0])):
        even[n, p] = m // k
        left[n, p] = Counter()
        for _ in range(m % k):
            f = load.index(min(load))
            load[f] += p * all_rows + n * all_pos
            left[n, p][f] += 1
    return {(s, f): even[s] + left[s][f] for s in shapes for f in range(k)}


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 3), (3, 10)])
def test_folds_follow_the_plan_and_are_level(spark, seed, k):
    rng = random.Random(seed)
    sizes = [(n, rng.randrange(n + 1)) for n in (rng.choice([1, 2, 3, 5, 8, 40, 90]) for _ in range(160))]
    sizes += [(400, 300), (1, 0), (1, 1)]
    df = frame(spark, sizes)
    got = folds.greedy_group_folds(df, "place", k=k).collect()
    assert len(got) == len(sizes) and {r["fold"] for r in got} == set(range(k))
    for r in got:
        assert (r["rows"], r["positives"]) == sizes[int(r["place"][1:])]
    counted = Counter(((r["rows"], r["positives"]), r["fold"]) for r in got)
    assert counted == {key: n for key, n in plain(sizes, k).items() if n}

    def spread(rows):
        load = defaultdict(lambda: [0, 0])
        for r in rows:
            load[r["fold"]][0] += r["rows"]
            load[r["fold"]][1] += r["positives"]
        return [max(x) - min(x) for x in zip(*load.values())]

    turn = spread(folds.group_folds(df, "place", k=k).collect())
    mine = spread(got)
    assert sum(mine) <= sum(turn)


def test_few_groups_and_none(spark):
    got = folds.greedy_group_folds(frame(spark, [(3, 0), (2, 0)]), "place", k=5).collect()
    assert sorted(r["fold"] for r in got) == [0, 1]
    assert folds.greedy_group_folds(frame(spark, []), "place").count() == 0
