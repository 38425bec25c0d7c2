"""Publishing one result to several folders: all of them or none, and never half of one.

Data is written beside what is there, under a new name.  Every folder then gets a manifest that
names its data and one commit record, and last of all that record is created in the first folder,
a single small file.  Readers take the newest manifest whose commit record exists, so until then
all folders show what they showed before, whatever failed on the way.  Works on stores that cannot
rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foldstone.session import checkpoint
from foldstone.sources.tables import exists, read_csv


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that exists is an error."""
    fs, target = _at(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's manifests, newest first."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted((n for n in names if n.startswith("manifest-")), reverse=True)


def as_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def as_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def publish(
    df: DataFrame, paths: str | Sequence[str], write: Callable[[DataFrame, str], None] = as_csv,
) -> str:
    """Write ``df``, computed once, to every folder and make all copies visible together; its name.

    Earlier versions stay until ``prune``; a failure leaves only files that no manifest shows.
    """
    spark = df.sparkSession
    paths = [p.rstrip("/") for p in ([paths] if isinstance(paths, str) else paths)]
    if not paths:
        raise ValueError("no folder to publish to")
    name = uuid.uuid4().hex
    stored = checkpoint(df)
    for path in paths:
        write(stored, f"{path}/data-{name}")
    commit = f"{paths[0]}/commit-{name}"
    for path in paths:
        newest = _manifests(spark, path)
        turn = 1 + (int(newest[0].split("-")[1]) if newest else 0)
        _create(spark, f"{path}/manifest-{turn:010d}-{name}.json",
                json.dumps({"data": f"data-{name}", "commit": commit}))
    _create(spark, commit, "")
    return name


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the data that a published folder shows now."""
    path = path.rstrip("/")
    for manifest in _manifests(spark, path):
        said = json.loads(_text(spark, f"{path}/{manifest}"))
        if exists(spark, said["commit"]):
            return f"{path}/{said['data']}"
    return None


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV rows that a published folder shows now."""
    shown = published(spark, path)
    if shown is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return read_csv(spark, shown, schema)


def prune(spark: SparkSession, path: str) -> list[str]:
    """Remove a folder's data that it does not show: older versions and failed writes.

    Not while something is being published there.  Commit records, which other folders may rely
    on, stay.
    """
    shown, fs_target = published(spark, path), _at(spark, path)
    fs, target = fs_target
    keep = shown.rsplit("/", 1)[1] if shown else None
    gone = [s.getPath() for s in fs.listStatus(target)
            if s.getPath().getName().startswith("data-") and s.getPath().getName() != keep]
    for old in gone:
        fs.delete(old, True)
    return sorted(p.getName() for p in gone)
