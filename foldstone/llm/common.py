"""Helpers shared by the operators: tables, staging, row keys, hashing of words, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text; rows equal in both are interchangeable."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\u0001"), F.col(text_col))


def worker_store() -> dict:
    """What a Python worker keeps from one task to the next.

    Functions of this subpackage reach tasks by value, each with globals of its own, so a module
    global or a cached function starts anew in every task; this entry of the process does not.
    """
    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__


def kept(kind: str, key, make):
    """The worker's one object of a kind: made again when it was made for another key."""
    store = worker_store()
    if kind not in store or store[kind][0] != key:
        store.pop(kind, None)  # the old one goes before the new one comes
        store[kind] = (key, make())
    return store[kind][1]


def release() -> None:
    """Give memory that is no longer used back to the machine.

    Workers go on to the tasks of later stages, and their allocators keep what a task has freed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run):
    """A function for ``mapInArrow`` after which the worker gives its memory back."""

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            release()

    return wrapped


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20):
    """Jobs run inside hand their rows to Python in batches of at most so many rows and bytes.

    The default batches hold tens of megabytes of texts, several times over on their way.
    """
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
            "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base % (1 << 64)), dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all stretches of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SEEDS[data] * powers(_BASE, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_inverse(_BASE), n - width + 1))


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and the n + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLD = np.arange(256, dtype=np.uint8)
#: Bytes hashed at a time.
_BLOCK = 1 << 19
_FOLD[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z as a-z, and how many words precede each text's start.

    A word is a run of bytes other than the six ASCII white spaces, so never crosses texts.
    """
    hashes, starts, done = [], [], 0
    while done < len(data):  # in blocks that end at a white space, so memory stays small
        stop = min(len(data), done + _BLOCK)
        while stop < len(data):
            tail = data[stop - min(stop - done, 4096):stop]
            white = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(white):
                stop -= len(tail) - 1 - white[-1]
                break
            stop = min(len(data), stop + 4096)
        lo, hi = np.searchsorted(at, (done, stop), "right")
        cuts = np.r_[done, at[lo:hi], stop] - done
        h, s = _block_hashes(data[done:stop], cuts)
        hashes.append(h)
        starts.append(s + done)
        done = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def _block_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(ends_at) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SEEDS[_FOLD[data]] * powers(_BASE, n), out=sums[1:])
    down = powers(_inverse(_BASE), n)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts


def batches(parts: Iterator[pa.RecordBatch], size: int = 8 << 20,
            column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, at least one row."""
    for batch in parts:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        width = np.cumsum(np.frombuffer(
            pa.compute.binary_length(col).fill_null(0).cast(pa.int64()).buffers()[1],
            np.int64, len(col)))
        start = 0
        while start < len(col):
            before = width[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(width, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges can reach.

    Alternates large-star and small-star steps; each is one grouping of the edges, and the number
    of rounds grows with the logarithm of the longest chain.  Every round is a written table.
    Nodes without an edge to another node are absent.
    """
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter("u <> v").distinct())
    total = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"),
                                                    F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        now = staged(small)
        # a forest of stars has one edge for each node and no node that is also a root
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == total:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        total = seen
