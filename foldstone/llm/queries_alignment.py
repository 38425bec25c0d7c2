"""Query of the alignment of two tokenizers."""

from pyspark.sql import functions as F

from .common import table
from .queries_bpe import vocabulary_path
from .registry import query
from .token_alignment import align_tokens


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    found = align_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), piece_path())
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups",
                        "n_links", "n_best", "count_sum", "groups_sha256")
