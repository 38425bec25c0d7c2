"""Query of the quality rules."""

from .common import table
from .ngram_quality import RESULT, assess
from .registry import query


@query("op4_ngram_quality")
def op4_ngram_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return assess(docs, keep_text=False).select("doc_id", *RESULT, "perplexity", "lang")
