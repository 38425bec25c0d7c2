"""Query of the toxicity scores."""

from .common import table
from .registry import query
from .toxicity import toxicity


@query("op3_weak_toxicity")
def op3_weak_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")
