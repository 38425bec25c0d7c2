"""Query of the BPE operator."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import compile_lexicon, encode
from .common import table
from .registry import query


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """n_tokens and digests of ids and decoded texts, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    coded = encode(docs, compile_lexicon(docs, vocab_path), with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_bpe_lexicon")
def op1_bpe_lexicon(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())
