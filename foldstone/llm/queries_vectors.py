"""Query of the near-duplicate embeddings."""

from pyspark.sql import functions as F

from .common import table
from .hadamard_lsh import near_vectors
from .registry import query


@query("op6_cross_polytope")
def op6_cross_polytope(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").cast("long").alias("vec_id"), "n_links",
                        F.col("component_id").cast("long").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
