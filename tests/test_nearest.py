"""Two-level cells of the nearest-neighbour join."""

import numpy as np
import pandas as pd
import pytest

from foldstone.operators import nearest


def frames(spark, n, m, seed=5, width=3, scale=1.0):
    rng = np.random.default_rng(seed)
    names = list("abcdefg")[:width]
    ref, ask = rng.random((n, width)) * scale, rng.random((m, width)) * scale
    rdf = spark.createDataFrame(pd.DataFrame(ref, columns=names).assign(rid=np.arange(n)))
    qdf = spark.createDataFrame(pd.DataFrame(ask, columns=names).assign(qid=np.arange(m)))
    return rdf, qdf, ref, ask, names


@pytest.mark.parametrize("cell_rows, at_once", [(4, 1 << 18), (16, 20), (5_000, 7)])
def test_equal_to_all_pairs_with_probes_dealt_out(spark, monkeypatch, cell_rows, at_once):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "PROBES_AT_ONCE", at_once)
    monkeypatch.setattr(nearest, "HELD_GAPS", 500)
    rdf, qdf, ref, ask, names = frames(spark, 3_000, 300, width=4)
    got = nearest.nearest_join(qdf, rdf, names, "qid", "rid").toPandas().set_index("qid")
    d2 = ((ask[:, None] - ref[None]) ** 2).sum(2)
    assert len(got) == 300
    assert [got.loc[i, "rid"] for i in range(300)] == d2.argmin(1).tolist()


def pairs_per_probe(spark, n):
    """Candidate (probe, cell) pairs of both rounds, and the boxes compared, for each probe."""
    rdf, qdf, _, _, names = frames(spark, n, 200)
    at = [f"x{i}" for i in range(3)]
    points = rdf.selectExpr("rid", *[f"{c} as {a}" for c, a in zip(names, at)])
    probes = qdf.selectExpr("qid as probe", *[f"{c} as {a}" for c, a in zip(names, at)])
    cells = nearest.Cells(points, at)
    home = cells.home(probes)
    assert home.count() == 200
    reach = (n / 16) ** (-2 / 3) / 4  # as a cell's own point would bound it
    bounded = probes.join(home, "probe").selectExpr("probe", *at, f"{reach}D as bound", "cell as own")
    return cells.within(bounded).count() / 200, len(cells.regions.value[0])


def test_work_per_probe_stays_as_rows_grow_tenfold(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 16)
    small, large = pairs_per_probe(spark, 4_000), pairs_per_probe(spark, 40_000)
    assert large[0] < 2 * small[0] and large[0] < 40
    assert large[1] <= 4 * small[1]  # regions grow as the root of the points


def test_one_place_holds_most_points_and_most_probes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 8)
    monkeypatch.setattr(nearest, "PROBES_AT_ONCE", 50)
    rng = np.random.default_rng(1)
    ref = np.concatenate([rng.normal(0, 1e-6, (900, 2)), rng.random((100, 2)) * 100])
    ask = np.concatenate([rng.normal(0, 1e-6, (300, 2)), rng.random((20, 2)) * 200 - 50])
    rdf = spark.createDataFrame(pd.DataFrame(ref, columns=["a", "b"]).assign(rid=np.arange(1000)))
    qdf = spark.createDataFrame(pd.DataFrame(ask, columns=["a", "b"]).assign(qid=np.arange(320)))
    got = nearest.nearest_join(qdf, rdf, ["a", "b"], "qid", "rid").toPandas().set_index("qid")
    d2 = ((ask[:, None] - ref[None]) ** 2).sum(2)
    assert np.allclose([got.loc[i, "distance"] ** 2 for i in range(320)], d2.min(1), rtol=1e-9, atol=0)


def test_regions_answer_with_one_row_a_probe_and_the_smallest_id(spark, monkeypatch):
    """Points and probes meet inside tasks; on a lattice many points are equally close."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 4)
    monkeypatch.setattr(nearest, "HELD_GAPS", 300)
    side = np.arange(20.0)
    ref = np.array([(a, b) for a in side for b in side])
    names = [f"p{i:03d}" for i in np.random.default_rng(2).permutation(len(ref))]
    ask = np.array([(a + 0.5, b + 0.5) for a in side[:9] for b in side[:9]] + [(-3.0, 2.5), (4.0, 4.0)])
    points = spark.createDataFrame(pd.DataFrame(ref, columns=["x0", "x1"]).assign(rid=names))
    probes = spark.createDataFrame(pd.DataFrame(ask, columns=["x0", "x1"]).assign(probe=range(len(ask))))
    cells = nearest.Cells(points, ["x0", "x1"])
    d2 = ((ask[:, None] - ref[None]) ** 2).sum(2)
    want = {i: (d.min(), min(n for n, e in zip(names, d) if e == d.min())) for i, d in enumerate(d2)}
    assert {r["probe"]: tuple(r["hit"]) for r in cells.nearest(probes).collect()} == want
    placed = probes.selectExpr("*", "double('inf') as bound").crossJoin(
        spark.createDataFrame([(int(r),) for r in cells.regions.value[0]], "region long"))
    assert cells._visit(placed).count() == placed.count()
