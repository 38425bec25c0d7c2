"""Query of the suffix-array deduplication."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .suffix_dedup import remove, repeats


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    kept = remove(repeats(table(spark, sf_dir, "documents")))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))
