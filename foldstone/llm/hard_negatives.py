"""Hard negatives by a secondary sort of packed scores and a streaming pass over each anchor.

Rows and anchors are packed in blocks of bounded size, and each block of rows meets each block of
anchors once: a stated set of queries against all rows.  Two such passes keep what a block can
contribute: first its best positives of each anchor, then, with the positives known, its best
negatives inside the score window of each positive.  What any block leaves out is beaten by enough
rows of that same block, so the union holds the answer.  The surviving pairs become sort keys
(anchor, descending score, kind, id), are shuffled by anchor and sorted within partitions.  One
iterator reads them in order: a positive opens a window, a negative is emitted for each open
window that admits it, and at most ``positives`` windows are held at any time.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component
take no part.  Rows that share an id are one row, the one of least label and then least vector.
Missing components of shorter vectors count as zero; an empty vector scores zero with all.  Ties
go to the smaller id.  An anchor without positives, or a positive whose window admits nobody, gives
no row; an empty table gives none.  Scores are exact integers; one that 64 bits cannot hold
raises an error.  Only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Bytes of one packed block of rows and of one of anchors.
BLOCK_BYTES = 1 << 20
#: Blocks of anchors are sent to all tasks up to so many bytes, and are joined beyond.
SHARED_BYTES = 32 << 20
PAIR = "anchor_id long, id long, score long, positive boolean"


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v): one row per id with integer components, rows that take no part left out."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          label.cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("id is not null and label is not null and v is not null").filter(fine)
    # floor of a double kept as a double: exact, and free of the range of a long
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double"))
                        .otherwise(x * SCALE))
    return (rows.select("id", F.struct("label", whole.alias("v")).alias("row"))
            .groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v"))


def _pack(rows: DataFrame, extra: str = "") -> DataFrame:
    """Rows of (id, label, v and the long lists in ``extra``) in blocks, one binary row each.

    A block ends at ``BLOCK_BYTES``; a task packs the rows it meets.
    """
    lists = extra.split()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_table(part)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], ["rows"])

        for batch in parts:
            width = pa.compute.list_value_length(batch.column("v")).fill_null(0).to_numpy(
                zero_copy_only=False).astype(np.int64) * 8 + 32
            start = 0
            while start < batch.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(width[start:]),
                                                          BLOCK_BYTES - size, "right")))
                held.append(batch.slice(start, stop - start))
                size += int(width[start:stop].sum())
                start = stop
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select("id", "label", "v", *lists).mapInArrow(run, "rows binary")


class Block:
    """An unpacked block: ids, labels, integer vectors (as doubles) and further lists."""

    def __init__(self, packed: bytes):
        t = pa.ipc.open_stream(packed).read_all().combine_chunks()
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        self.id, self.label, self.table = t["id"].to_numpy(), t["label"].to_numpy(), t
        flat, at = _flat(t["v"])
        sizes = np.diff(at)
        self.v = np.zeros((len(self.id), max(sizes, default=0)))
        self.v[np.repeat(np.arange(len(sizes)), sizes),
               np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = flat

    def longs(self, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A list column as a matrix and a mask of what is filled."""
        flat, at = _flat(self.table[name])
        sizes = np.diff(at)
        out, filled = np.zeros((len(sizes), width), np.int64), np.zeros((len(sizes), width), bool)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        cols = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
        out[rows, cols], filled[rows, cols] = flat, True
        return out, filled


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]] if len(lists) else \
        np.zeros(0), at - at[0] if len(at) else np.zeros(1, np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held in doubles, as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(d, 1)
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ \
        np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    if exact.size and max(abs(int(x)) for x in exact.flat) >= 1 << 62:
        raise OverflowError("an inner product does not fit in 64 bits")
    return exact.astype(np.int64)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest allowed scores of each row, ties to the lower column."""
    low = np.iinfo(np.int64).min
    kept = np.where(allowed, score, low)
    if kept.shape[1] > k:
        least = np.partition(kept, kept.shape[1] - k, axis=1)[:, kept.shape[1] - k]
        allowed = allowed & (kept >= least[:, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -kept[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _meet(rows: DataFrame, anchors: DataFrame, judge) -> DataFrame:
    """``judge(anchor block, row block)`` for every pair of blocks; gives PAIR rows.

    Blocks of anchors are numbered, blocks of rows are repeated once for each number, and the two
    are joined by number; the anchors are broadcast only while measured to be small.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in parts:
            for mine, theirs in zip(batch.column("anchors"), batch.column("rows")):
                mine, theirs = mine.as_py(), theirs.as_py()
                if theirs != last:
                    last, block = theirs, Block(theirs)
                anchor, other, score, positive = judge(Block(mine), block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(other), pa.array(score),
                     pa.array(np.full(len(anchor), positive))],
                    ["anchor_id", "id", "score", "positive"])

    anchors = staged(anchors.withColumnRenamed("rows", "anchors"))
    n, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.length("anchors")), F.lit(0))).first()
    n = max(1, n)
    numbered = anchors.withColumn("n", F.pmod(F.xxhash64("anchors"), F.lit(n)))
    pairs = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(
        F.broadcast(numbered) if size <= SHARED_BYTES else numbered, "n")
    return pairs.select("anchors", "rows").mapInArrow(run, PAIR)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label: Column | str = "label",
                   vector_col: str = "embedding", every: int = 100, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``.  Each of an anchor's first
    ``positives`` rows of its own label gets its first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = staged(usable(vectors, id_col, label, vector_col))
    anchors = rows.filter(F.pmod("id", F.lit(every)) == 0)
    blocks = staged(_pack(rows))

    def same(mine: Block, theirs: Block):
        s = scores(mine.v, theirs.v)
        r, c = best(s, (mine.label[:, None] == theirs.label[None])
                    & (mine.id[:, None] != theirs.id[None]), positives)
        return mine.id[r], theirs.id[c], s[r, c], True

    near = _sorted(_meet(blocks, _pack(anchors), same))
    first = staged(near.mapInArrow(_leaders(positives), PAIR))
    windows = first.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_distinct(F.collect_list("score")).alias("own"))  # at most ``positives`` of them

    def other(mine: Block, theirs: Block):
        s = scores(mine.v, theirs.v)
        own, filled = mine.longs("own", positives)
        apart = mine.label[:, None] != theirs.label[None]
        found = np.zeros(s.shape, bool)
        for j in range(own.shape[1]):
            p = own[:, j:j + 1]
            inside = apart & filled[:, j:j + 1] & _admits(p, s, low, high)
            r, c = best(s, inside, negatives)
            found[r, c] = True
        r, c = np.nonzero(found)
        return mine.id[r], theirs.id[c], s[r, c], False

    far = _meet(blocks, _pack(anchors.join(windows, "id"), "own"), other)
    return _sorted(first.unionByName(far)).mapInArrow(
        _open_windows(positives, negatives, low, high),
        "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long")


def _admits(p, s, low: int, high: int):
    """Whether a positive's window holds a score, without leaving 64 bits."""
    if isinstance(p, np.ndarray) and max(np.abs(p).max(initial=0), np.abs(s).max(initial=0)) \
            >= 2**55:
        p, s = p.astype(object), s.astype(object)
        return ((low * p <= 100 * s) & (100 * s <= high * p)).astype(bool)
    return (low * p <= 100 * s) & (100 * s <= high * p)


def _sorted(pairs: DataFrame) -> DataFrame:
    """The secondary sort: anchors dealt to partitions, (descending score, kind, id) inside."""
    key = [F.col("anchor_id"), F.col("score").desc(), F.col("positive").desc(), F.col("id")]
    return pairs.repartition(partitions(pairs.sparkSession), "anchor_id").sortWithinPartitions(*key)


def _leaders(k: int):
    """The first k rows of each anchor of sorted batches."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in parts:
            anchor = batch.column("anchor_id").to_numpy()
            at = np.arange(len(anchor))
            begins = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(begins, at, 0))
            place = at - begin
            if len(anchor) and anchor[0] == last:
                place[begin == 0] += n
            if len(anchor):
                last, n = anchor[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < k))

    return run


def _open_windows(positives: int, negatives: int, low: int, high: int):
    """The streaming pass over sorted pairs: state is the open windows of one anchor."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []  # a window: [positive id, its score, rows emitted]
        for batch in parts:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("anchor_id", "id", "score", "positive")]
            for a, i, s, opens in zip(*columns):
                if a != anchor:
                    anchor, windows = a, []
                if opens:
                    windows.append([i, s, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and _admits(w[1], s, low, high):
                        w[2] += 1
                        out.append((a, w[0], w[2], i, w[1], s))
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else \
                [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run
