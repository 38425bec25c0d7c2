"""Query of the secret scan."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .secret_scan import KINDS, find_secrets, in_order, span_text


@query("op2_secret_layers")
def op2_secret_layers(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(in_order(F.col("base"))), 256).alias("base_sha256"),
        span_text(in_order(F.concat("base", "inner"))).alias("spans"))
