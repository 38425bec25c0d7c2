"""Query of the search for personal data."""

from pyspark.sql import functions as F

from .common import table
from .pii_boost import KINDS, find_personal, in_order
from .registry import query
from .secret_scan import span_text


@query("op8_pii_boost")
def op8_pii_boost(spark, sf_dir):
    found = find_personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(in_order(F.col("base"))), 256).alias("base_sha256"),
        span_text(in_order(F.concat("base", "more"))).alias("spans"))
