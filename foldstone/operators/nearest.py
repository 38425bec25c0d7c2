"""Exact nearest-neighbour join in a handful of dimensions, without a cross join.

Space is cut twice by k-d splits fitted on samples, as a range partitioner does for sorting: into
regions, and every region into cells of about ``CELL_ROWS`` points.  There are about as many regions
as cells in a region, so neither list grows faster than the square root of the points; the first is
known to all tasks, the second only where its region is worked on.  Round one streams each query past
the points of its nearest region and so gets a bound on the distance; round two past those of the
other regions whose bounding box lies within the bound.  In a region only cells are compared whose
box lies within the best distance so far.  Points and queries move once a round, and pairs of them
never leave a task.  The samples affect speed only, never the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions import scalar as S
from foldstone.session import checkpoint

CELL_ROWS = 128
SAMPLE_PER_CELL = 8
#: Queries of one region that a task looks up before another task takes the rest.
PROBES_AT_ONCE = 1 << 18
#: Distances to boxes that a task holds at a time.
HELD_GAPS = 4_000_000
_NODE_BITS = 32


def _fit_cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and value of each inner node of a complete binary tree (1-based)."""
    nodes = 2**depth
    axis, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
    pending = [(1, points)]
    while pending:
        node, part = pending.pop()
        if node >= nodes:
            continue
        if len(part):
            spread = part.max(axis=0) - part.min(axis=0)
            axis[node] = int(np.argmax(spread))
            cut[node] = float(np.median(part[:, axis[node]]))
        right = part[:, axis[node]] > cut[node] if len(part) else np.zeros(0, dtype=bool)
        pending += [(2 * node, part[~right]), (2 * node + 1, part[right])]
    return axis, cut


def _descend(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row in a tree of ``_fit_cells``."""
    node, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + (x[rows, axis[node]] > cut[node])
    return node


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from each row of x to each box."""
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        column = x[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - column, column - high[:, d]), 0.0) ** 2
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Held:
    """A region's points in a task: sorted by cell and id, with the cells' boxes."""

    def __init__(self, table: pa.Table, width: int):
        rid = table["rid"].combine_chunks()
        place = np.empty(len(rid), np.int64)
        place[pc.sort_indices(rid, null_placement="at_start").to_numpy()] = np.arange(len(rid))
        cell = table["cell"].to_numpy()
        order = np.lexsort((place, cell))
        self.rid, self.place = rid.take(pa.array(order)), place[order]
        self.x = np.concatenate([_matrix(c, width) for c in table["x"].chunks])[order]
        cell = cell[order]
        self.at = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        self.low = np.minimum.reduceat(self.x, self.at[:-1])
        self.high = np.maximum.reduceat(self.x, self.at[:-1])

    def closest(self, asked: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, index or -1) of the closest point not beyond ``best``, of the
        smallest id if there are several."""
        best, at = best.copy(), np.full(len(asked), -1)
        size = max(1, HELD_GAPS // len(self.low))
        for i in range(0, len(asked), size):
            gaps = _gaps(asked[i:i + size], self.low, self.high)
            own = gaps.argmin(axis=1)
            for last in (False, True):
                # the nearest cell of each query first: it bounds what is visited after
                near = gaps <= best[i:i + size, None] * (1 + 1e-9)
                first = own[:, None] == np.arange(gaps.shape[1])
                near &= first ^ last
                for cell in np.flatnonzero(near.any(axis=0)):
                    rows = np.flatnonzero(near[:, cell])
                    if last:
                        rows = rows[gaps[rows, cell] <= best[i + rows] * (1 + 1e-9)]
                    self._compare(asked, best, at, i + rows, self.at[cell], self.at[cell + 1])
        return best, at

    def _compare(self, asked, best, at, rows, lo, hi) -> None:
        """Lower ``best`` of some queries to what the points from lo to hi offer."""
        for j in range(0, len(rows), max(1, HELD_GAPS // (hi - lo))):
            some = rows[j:j + max(1, HELD_GAPS // (hi - lo))]
            square = 0.0
            for d in range(asked.shape[1]):
                away = asked[some, d, None] - self.x[lo:hi, d]
                square = square + away * away
            # points of a cell are in order of their ids, so the first least is the smallest id
            pick = square.argmin(axis=1)
            found = square[np.arange(len(some)), pick]
            pick += lo
            held = at[some]
            better = (found < best[some]) | ((found == best[some]) & (
                (held < 0) | (self.place[pick] < self.place[held])))
            best[some[better]], at[some[better]] = found[better], pick[better]


def _by_region(
    heads: DataFrame, rows: DataFrame, parts: int, spread: dict[int, int],
    start: Callable, step: Callable, schema: str,
) -> DataFrame:
    """Stream each region's ``rows`` past what its ``heads`` hold.

    Both have region and further columns of their own.  ``start`` makes a state of a region's head
    rows (arrow table), which are few; ``step(state, batch)`` gives record batches.  Regions of
    very many rows are dealt to ``spread[region]`` tasks, each with its own copy of the heads.
    """
    spark = rows.sparkSession
    some = spark.createDataFrame([(r, n) for r, n in spread.items() if n > 1], "region long, n int")
    hot = F.coalesce(F.col("n"), F.lit(1))
    # one row per region that is dealt out
    heads = heads.join(F.broadcast(some), "region", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), hot - 1))).drop("n").withColumn("head", F.lit(True))
    rows = rows.join(F.broadcast(some), "region", "left").withColumn(
        "part", F.pmod(F.xxhash64(*rows.columns), hot).cast("int")).drop("n").withColumn(
        "head", F.lit(False))
    both = heads.unionByName(rows, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            region, part = batch.column("region").to_numpy(), batch.column("part").to_numpy()
            head = batch.column("head").to_numpy(zero_copy_only=False)
            cuts = 1 + np.flatnonzero((region[1:] != region[:-1]) | (part[1:] != part[:-1])
                                      | (head[1:] != head[:-1]))
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = region[lo], part[lo]
                if now != last:
                    last, held, state = now, [], None
                if head[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if state is None:
                    state = start(pa.Table.from_batches(held) if held else None)
                if state is not None:
                    yield from step(state, batch.slice(lo, hi - lo))

    return both.repartition(parts, "region", "part").sortWithinPartitions(
        "region", "part", F.desc("head")).mapInArrow(run, schema)


class Cells:
    """Reference points in cells: the points, the cells' boxes, and the regions' boxes."""

    def __init__(self, points: DataFrame, at: Sequence[str]):
        spark = points.sparkSession
        self.at, width = list(at), len(at)
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        total = points.count()
        depth = max(0, int(np.ceil(np.log2(max(total, 1) / CELL_ROWS))))
        outer = (depth + 1) // 2
        inner = depth - outer
        # as many rows as the regions need, which is the square root of what the cells would
        sample = points.orderBy(F.xxhash64(*at)).limit(2 * SAMPLE_PER_CELL * 2**outer).select(*at)
        axis, cut = _fit_cells(sample.toPandas().to_numpy(dtype=float), outer)

        @F.pandas_udf("long")
        def region(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(_descend(frame.to_numpy(dtype=float), axis, cut, outer))

        points = points.select("rid", F.array(*at).alias("x"), region(F.struct(*at)).alias("region"))
        if inner:
            points = checkpoint(points)
            share = max(1, CELL_ROWS // SAMPLE_PER_CELL)
            heads = points.where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0).select(
                "region", F.col("x").alias("sampled"))

            def fit(table: pa.Table | None):
                drawn = np.zeros((0, width)) if table is None else np.concatenate(
                    [_matrix(c, width) for c in table["sampled"].chunks])
                return _fit_cells(drawn, inner)

            def place(tree, batch: pa.RecordBatch):
                node = _descend(_matrix(batch.column("x"), width), *tree, inner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid"), batch.column("x"), batch.column("region"),
                     pa.array((batch.column("region").to_numpy() << _NODE_BITS) | node)],
                    ["rid", "x", "region", "cell"])

            kind = points.schema["rid"].dataType.simpleString()
            points = _by_region(heads, points, self.parts, {}, fit, place,
                                f"rid {kind}, x array<double>, region long, cell long")
        else:
            points = points.withColumn("cell", F.shiftleft("region", _NODE_BITS))
        self.points = checkpoint(points.select(
            "rid", "region", "cell", *[F.col("x")[i].alias(a) for i, a in enumerate(at)]))
        self.boxes = checkpoint(self.points.groupBy("region", "cell").agg(
            F.array(*[F.min(a) for a in at]).alias("low"), F.array(*[F.max(a) for a in at]).alias("high")))
        # one row per region, about as many as the square root of the number of cells
        found = self.boxes.groupBy("region").agg(
            F.array(*[F.min(F.col("low")[i]) for i in range(width)]).alias("low"),
            F.array(*[F.max(F.col("high")[i]) for i in range(width)]).alias("high")).toPandas()
        self.empty = found.empty
        self.regions = spark.sparkContext.broadcast((
            found["region"].to_numpy(np.int64), np.array(found["low"].tolist(), float).reshape(-1, width),
            np.array(found["high"].tolist(), float).reshape(-1, width)))

    def _nearest_region(self) -> Column:
        """The region of the nearest box."""
        regions = self.regions

        @F.pandas_udf("long")
        def nearest(frame: pd.DataFrame) -> pd.Series:
            ids, low, high = regions.value
            x, step = frame.to_numpy(dtype=float), max(1, HELD_GAPS // max(len(ids), 1))
            return pd.Series(np.concatenate([
                ids[_gaps(x[i:i + step], low, high).argmin(axis=1)]
                for i in range(0, len(x), step)] or [np.zeros(0, np.int64)]))

        return nearest(F.struct(*self.at))

    def _reached_regions(self) -> Column:
        """The regions whose box lies within ``bound``."""
        regions = self.regions

        @F.pandas_udf("array<long>")
        def reached(frame: pd.DataFrame, bound: pd.Series) -> pd.Series:
            ids, low, high = regions.value
            x, limit = frame.to_numpy(dtype=float), bound.to_numpy()[:, None] * (1 + 1e-9)
            step, out = max(1, HELD_GAPS // max(len(ids), 1)), []
            for i in range(0, len(x), step):
                out += [ids[row].tolist() for row in
                        _gaps(x[i:i + step], low, high) <= limit[i:i + step]]
            return pd.Series(out)

        return reached(F.struct(*self.at), F.col("bound"))

    def nearest(self, probes: DataFrame) -> DataFrame:
        """(probe, hit): square and id of each probe's closest point, the smallest id on ties."""
        homes = probes.withColumn("region", self._nearest_region()).withColumn(
            "bound", F.lit(float("inf")))
        first = checkpoint(self._visit(homes))
        bounded = first.select("probe", F.col("region").alias("own"), "bound", *[
            F.col("x")[i].alias(a) for i, a in enumerate(self.at)])
        others = bounded.withColumn("region", F.explode(self._reached_regions())).where(
            "region <> own")
        hits = first.unionByName(self._visit(others)).select(
            "probe", F.struct(F.col("bound").alias("d2"), "rid").alias("hit"))
        return hits.groupBy("probe").agg(F.min("hit").alias("hit"))

    def _visit(self, placed: DataFrame) -> DataFrame:
        """(probe, region, x, bound, rid): probes that have a point within their bound in the
        region they are placed in, with the closest and its squared distance."""
        # one row per region
        spread = {r["region"]: -(-r["count"] // PROBES_AT_ONCE)
                  for r in placed.groupBy("region").count().collect()}
        width, ids = len(self.at), self.points.schema["rid"].dataType.simpleString()
        kind = placed.schema["probe"].dataType.simpleString()

        def start(table: pa.Table | None):
            return None if table is None else _Held(table, width)

        def step(held: _Held, batch: pa.RecordBatch):
            x = _matrix(batch.column("x"), width)
            best, at = held.closest(x, batch.column("bound").to_numpy())
            found = pa.array(np.flatnonzero(at >= 0))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(found) for c in ("probe", "region", "x")],
                 pa.array(best).take(found), held.rid.take(pa.array(at).take(found))],
                ["probe", "region", "x", "bound", "rid"])

        heads = self.points.select("rid", "region", "cell", F.array(*self.at).alias("x"))
        rows = placed.select("probe", "region", F.array(*self.at).alias("x"), "bound")
        return _by_region(heads, rows, self.parts, spread, start, step,
                          f"probe {kind}, region long, x array<double>, bound double, rid {ids}")

    def home(self, probes: DataFrame) -> DataFrame:
        """(probe, cell): the cell of the nearest box in the region of the nearest box."""
        placed = probes.withColumn("region", self._nearest_region())

        def step(state, batch):
            ids, low, high = state
            x, size = _matrix(batch.column("x"), low.shape[1]), max(1, HELD_GAPS // len(ids))
            best = [_gaps(x[i:i + size], low, high).argmin(axis=1) for i in range(0, len(x), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("probe"), pa.array(ids[np.concatenate(best)])], ["probe", "cell"])

        return self._look(placed, [], step)

    def within(self, probes: DataFrame) -> DataFrame:
        """(probe, cell): cells but the ``own`` one that may hold a point within ``bound``."""
        placed = probes.withColumn("region", F.explode(self._reached_regions()))

        def step(state, batch):
            ids, low, high = state
            x, size = _matrix(batch.column("x"), low.shape[1]), max(1, HELD_GAPS // len(ids))
            limit = batch.column("bound").to_numpy()[:, None] * (1 + 1e-9)
            own = batch.column("own").to_numpy()[:, None]
            for i in range(0, len(x), size):
                near = _gaps(x[i:i + size], low, high) <= limit[i:i + size]
                row, col = np.nonzero(near & (ids[None] != own[i:i + size]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("probe").take(pa.array(row + i)), pa.array(ids[col])],
                    ["probe", "cell"])

        return self._look(placed, ["bound", "own"], step)

    def _look(self, placed: DataFrame, more: Sequence[str], step: Callable) -> DataFrame:
        """Stream probes past the boxes of the region they are placed in."""
        placed = checkpoint(placed.select("probe", "region", F.array(*self.at).alias("x"), *more))
        # one row per region
        spread = {r["region"]: -(-r["count"] // PROBES_AT_ONCE)
                  for r in placed.groupBy("region").count().collect()}
        width, kind = len(self.at), placed.schema["probe"].dataType.simpleString()

        def start(table: pa.Table | None):
            if table is None:
                return None
            return (table["cell"].to_numpy(), *[
                np.concatenate([_matrix(c, width) for c in table[b].chunks]) for b in ("low", "high")])

        return _by_region(self.boxes, placed, self.parts, spread, start, step,
                          f"probe {kind}, cell long")


def nearest_join(
    queries: DataFrame, reference: DataFrame, dims: Sequence[str], query_id: str, reference_id: str
) -> DataFrame:
    """For each query row the closest reference row: (query_id, reference_id, distance).

    Euclidean; missing coordinates count as 0; the smallest reference id wins ties.  Copies of a
    point are collapsed on both sides before any comparison, so a third of all rows being the same
    point costs one comparison.
    """
    dims = list(dims)
    at = [f"x{i}" for i in range(len(dims))]
    # "+ 0.0" turns -0.0 into 0.0 so that equal points are equal keys.
    coords = [(F.coalesce(S.present(F.col(c).cast("double")), F.lit(0.0)) + F.lit(0.0)).alias(a)
              for c, a in zip(dims, at, strict=True)]
    points = reference.select(F.col(reference_id).alias("rid"), *coords).groupBy(*at).agg(
        F.min("rid").alias("rid"))
    asked = queries.select(F.col(query_id).alias("qid"), *coords)
    probes = asked.groupBy(*at).agg(F.min("qid").alias("probe"))
    # Both are narrow and read several times below.
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    probes = checkpoint(probes)
    cells = Cells(points, at)
    points.unpersist()
    if cells.empty:
        return asked.select(F.col("qid").alias(query_id),
                            F.lit(None).cast(reference.schema[reference_id].dataType)
                            .alias(reference_id),
                            F.lit(None).cast("double").alias("distance"))

    answered = probes.join(cells.nearest(probes), "probe")
    return asked.join(answered.select(*at, "hit"), at).select(
        F.col("qid").alias(query_id),
        F.col("hit.rid").alias(reference_id),
        F.sqrt("hit.d2").alias("distance"),
    )


def exact_match_labels(
    matches: DataFrame, reference: DataFrame, reference_id: str, label: str
) -> DataFrame:
    """Label distribution of the reference rows hit at distance zero: (label, rows, share)."""
    hits = matches.where("distance = 0").groupBy(reference_id).agg(F.count("*").alias("hits"))
    rows = hits.join(reference.select(reference_id, label), reference_id)
    counts = rows.groupBy(label).agg(F.sum("hits").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("rows"), total))
