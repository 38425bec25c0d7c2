"""Reading records: declared CSV schemas, path resolution, prediction files, Parquet tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.functions.scalar import present

# --- fixed values: column names and types of the input files -------------------------------
RECORD_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("deathdate", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("avg_temperature", T.DoubleType()),
    T.StructField("max_temperature", T.DoubleType()),
    T.StructField("min_temperature", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("is_climate_sensitive", T.IntegerType()),
])
ENRICHMENT_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("rain_sum_7d", T.DoubleType()),
    T.StructField("rain_sum_30d", T.DoubleType()),
    T.StructField("rain_sum_90d", T.DoubleType()),
    T.StructField("rain_days_30d", T.IntegerType()),
    T.StructField("max_daily_rain_30d", T.DoubleType()),
    T.StructField("tavg_7d", T.DoubleType()),
    T.StructField("tavg_30d", T.DoubleType()),
    T.StructField("tavg_90d", T.DoubleType()),
    T.StructField("tmax_30d", T.DoubleType()),
    T.StructField("tmin_30d", T.DoubleType()),
    T.StructField("hot_days_30d", T.IntegerType()),
    T.StructField("temp_range_mean_30d", T.DoubleType()),
    T.StructField("ndvi_30d", T.DoubleType()),
    T.StructField("ndvi_90d", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("slope", T.DoubleType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("TargetF1", T.IntegerType()),
    T.StructField("TargetRAUC", T.DoubleType()),
])
# --- end of fixed values -------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files that a path or glob names, those directly in it for a folder."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(conf)
    found = []
    for status in fs.globStatus(pattern) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in inner if not s.isDirectory()]
    return sorted(p.toString() for p in found if p.getName()[0] not in "_.")


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names in a file's first line, read without a job; compressed files too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        data = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(data, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.lstrip("\ufeff")]))) if line else ()


def by_header(spark: SparkSession, files: Sequence[str]) -> dict[tuple, list[str]]:
    """Files grouped by their header, without those that have none."""
    groups: dict[tuple, list[str]] = {}
    for file in files:
        if header := header_of(spark, file):
            groups.setdefault(header, []).append(file)
    return groups


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, columns matched to the schema by header name.

    Columns no file has are left out, as are file columns the schema does not know; files may
    have their columns in different orders, and one that a file lacks is missing there.  NaN text in
    number columns is missing.  Only header lines are read on the driver.
    """
    groups = by_header(spark, _files(spark, path))
    if not groups:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    known = {f.name: f.dataType for f in schema.fields}
    parts = []
    for header, files in groups.items():
        raw = spark.read.option("header", True).schema(T.StructType(
            [T.StructField(c, T.StringType()) for c in header])).csv(files)
        typed = []
        for c in header:
            if c not in known:
                continue
            value = F.col(f"`{c}`").try_cast(known[c])
            if isinstance(known[c], T.DoubleType):
                value = present(value)
            typed.append(value.alias(c))
        parts.append(raw.select(*typed))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_record_id(df: DataFrame, target: str = "is_climate_sensitive") -> DataFrame:
    """Rename the file's key and label to the names operators use."""
    renamed = df.withColumnRenamed("ID", "record_id")
    return renamed.withColumnRenamed(target, "target") if target in df.columns else renamed


def read_prediction_sets(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """(source, id, label, score) of all CSV files whose header has the label column.

    Files are grouped by header on the driver (names only); each group is one scan.
    """
    files = sorted({f for pattern in patterns for f in _files(spark, pattern)})
    out = spark.createDataFrame([], "source string, id string, label int, score double")
    for header, group in by_header(spark, files).items():
        if "TargetF1" not in header:
            continue
        raw = spark.read.option("header", True).schema(T.StructType(
            [T.StructField(c, T.StringType()) for c in header])).csv(group)

        def pick(name, kind):
            return F.col(name).try_cast(kind) if name in header else F.lit(None).cast(kind)

        out = out.unionByName(raw.select(
            F.col("_metadata.file_path").alias("source"), pick("ID", "string").alias("id"),
            pick("TargetF1", "int").alias("label"), pick("TargetRAUC", "double").alias("score")))
    return out


def scan_prediction_files(
    spark: SparkSession, patterns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows of prediction files, and what was turned away: (rows, rejects).

    Rows are (source, id, label, score) with the file each comes from, as the reader tells.
    Rejects are (source, reason, rows): files without a header or without the label column, whose
    rows are not read (``rows`` is null), and per file the rows whose id is missing or whose label or
    score is no number; those rows are not among the rows.
    """
    files = sorted({f for pattern in patterns for f in _files(spark, pattern)})
    groups = by_header(spark, files)
    known = {f for group in groups.values() for f in group}
    turned = [(f, "no header", None) for f in files if f not in known]
    rows = spark.createDataFrame([], "source string, id string, label int, score double, reason string")
    for header, group in groups.items():
        if "TargetF1" not in header:
            turned += [(f, "no label column", None) for f in group]
            continue
        raw = spark.read.option("header", True).schema(T.StructType(
            [T.StructField(c, T.StringType()) for c in header])).csv(group)
        text = lambda c: F.col(f"`{c}`") if c in header else F.lit(None).cast("string")
        label = text("TargetF1").try_cast("double").try_cast("int")
        score = present(text("TargetRAUC").try_cast("double"))
        reason = (F.when(text("ID").isNull(), "no id")
                  .when(label.isNull(), "label is no number")
                  .when(text("TargetRAUC").isNotNull() & score.isNull(), "score is no number"))
        rows = rows.unionByName(raw.select(
            F.col("_metadata.file_path").alias("source"), text("ID").alias("id"),
            label.alias("label"), score.alias("score"), reason.alias("reason")))
    bad = rows.where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("rows"))
    rejects = bad.unionByName(spark.createDataFrame(turned, "source string, reason string, rows long"))
    return rows.where("reason is null").drop("reason"), rejects
