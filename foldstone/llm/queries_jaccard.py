"""Query of the n-gram Jaccard join."""

from pyspark.sql import functions as F

from .common import table
from .jaccard_join import jaccard_classes
from .registry import query


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
