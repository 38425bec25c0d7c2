"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Hadamard transform; the hash of a vector is
the signed axis nearest to the rotated vector.  A table joins several such hashes; probing also
enters the bucket where the least certain one takes its second-nearest axis.  All pairs that share
a bucket and a label are verified by their cosine in doubles.

Vectors equal in label and numbers are one row of the index, with their number.  A pair that meets
in several buckets is counted in the first of them only.  Large buckets are dealt in chunks and
every pair of chunks is a task; a task returns a number for each of its vectors and a spanning forest of
its links, never the pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link with
nothing.  Vectors of different lengths have no cosine and do not link.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, staged

TABLES, HASHES, SEED = 6, 2, 11
MIN_COSINE = 0.98
CHUNK = 512


def _size(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows of a power-of-two length."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        x = x.reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, turn: int, seed: int = SEED) -> np.ndarray:
    """Rows padded to a power of two and turned by the rotation of a number."""
    n = _size(x.shape[1])
    signs = np.random.default_rng((seed, turn)).choice((-1.0, 1.0), (3, n))
    y = np.zeros((len(x), n))
    y[:, :x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES,
            seed: int = SEED) -> np.ndarray:
    """(rows, tables, 2) bucket numbers: a vector's own bucket and the one probed besides."""
    out = np.zeros((len(x), tables, 2), np.int64)
    for t in range(tables):
        own = np.zeros(len(x), np.int64)
        doubt = np.full(len(x), np.inf)
        change = np.zeros(len(x), np.int64)
        for k in range(hashes):
            y = rotate(x, t * hashes + k, seed)
            n = 2 * y.shape[1]
            size = np.abs(y)
            at = np.arange(len(x))
            best = size.argmax(1)
            top = size[at, best]
            code = 2 * best + (y[at, best] < 0)
            size[at, best] = -1.0
            second = size.argmax(1)
            gap = top - size[at, second]
            other = 2 * second + (y[at, second] < 0)
            change = np.where(gap < doubt, (other - code) * n**(hashes - 1 - k), change * 1)
            doubt = np.minimum(doubt, gap)
            own = own * n + code
        out[:, t, 0], out[:, t, 1] = own, own + change
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean matrix of links."""
    n, root, out = len(linked), list(range(len(linked))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen = np.zeros(n, bool)
    for q in range(n):
        if seen[q]:
            continue
        seen[q] = True
        stack = [q]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            out += [(x, int(y)) for y in new]
            stack += new.tolist()
    return out


def link_counts(vectors: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES,
                hashes: int = HASHES, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(a, n, b): per task, vector a has n further links; b is a linked vector or null.

    ``vectors`` has node (distinct), label, times and v (array of finite doubles, not zero).
    """

    def enter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column("v")
            sizes = pa.compute.list_value_length(lists).to_numpy()
            nodes, labels = batch.column("node").to_pylist(), batch.column("label").to_pylist()
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                codes = buckets(_matrix(lists.take(pa.array(own))), tables, hashes, seed)
                rows = []
                for i, c in zip(own, codes):
                    for t in range(tables):
                        for code in {int(c[t, 0]), int(c[t, 1])}:
                            rows.append((t, int(d), labels[i], code, nodes[i], c.ravel().tolist()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                         pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()),
                         pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.int64()))],
                        ["t", "d", "label", "code", "node", "codes"])

    entries = staged(vectors.select("node", "label", "v").mapInArrow(
        enter, "t int, d int, label string, code long, node long, codes array<long>"))
    key = ["t", "d", "label", "code"]
    sizes = entries.groupBy(key).agg(F.count("*").alias("members")).filter("members > 1")
    split = F.ceil(F.col("members") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("split")).cast("int")
    dealt = (entries.join(sizes, key).withColumn("split", split).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .select(*key, "i", "j", "own", "node", "codes"))
    full = dealt.join(vectors.select("node", "times", "v"), "node")
    group = [*key, "i", "j"]

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def solve():
            t, i, j = now[0], now[4], now[5]
            node = np.array([r[1] for r in held])
            side = np.array([r[0] for r in held])
            times = np.array([r[2] for r in held], np.int64)
            x = np.array([r[3] for r in held], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= min_cosine
            np.fill_diagonal(linked, False)
            if i != j:  # pairs within a chunk belong to that chunk's own task
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                return
            codes = np.array([r[4] for r in held], np.int64).reshape(len(held), -1, 2)
            a, b = np.nonzero(linked)
            met = np.zeros(len(a), bool)
            for u in range(t + 1):  # met in an earlier bucket: counted there
                for p, q in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    same = codes[a, u, p] == codes[b, u, q]
                    if u == t:
                        same &= codes[a, u, p] < now[3]
                    met |= same
            n = np.bincount(a[~met], times[b[~met]], len(held)).astype(np.int64)
            tree = _forest(linked)
            out = [(int(node[k]), int(n[k]), None) for k in np.flatnonzero(n)]
            out += [(int(node[p]), 0, int(node[q])) for p, q in tree]
            p, q, r = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()),
                                              pa.array(r, pa.int64())], ["a", "n", "b"])

        for batch in parts:
            cols = [batch.column(c).to_pylist() for c in
                    (*group, "own", "node", "times", "v", "codes")]
            for row in zip(*cols):
                if row[:6] != now:
                    if len(held) > 1:
                        yield from solve()
                    held, now = [], row[:6]
                held.append(row[6:])
        if len(held) > 1:
            yield from solve()

    return (full.repartition(partitions(vectors.sparkSession), *group)
            .sortWithinPartitions(*group).mapInArrow(verify, "a long, n long, b long"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", **options) -> DataFrame:
    """(id, n_links, component_id): one row for each row of ``table``."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string")
                        .alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite
                      & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("good", good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = staged(rows.withColumn("node", F.xxhash64("label", "v")))
    vectors = staged(rows.filter("good").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("times"),
        F.min("id").alias("least")))
    found = staged(link_counts(vectors, **options))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    grouped = components(found.filter("b is not null").select("a", "b").distinct())
    classed = (vectors.select("node", "times", "least")
               .join(links, F.col("node") == F.col("a"), "left")
               .join(grouped.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
               .select("node", F.coalesce("root", "node").alias("root"), "least",
                       (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    per = classed.join(least, "root").select(F.col("node").alias("c_node"), "n_links", "component_id")
    own = F.col("good") & (F.col("node") == F.col("c_node"))
    return rows.join(per, own, "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
