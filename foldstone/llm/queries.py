"""All queries of this subpackage."""

from . import queries_alignment, queries_bpe, queries_html, queries_jaccard, queries_mix, queries_negatives, queries_pii, queries_quality, queries_secrets, queries_suffix, queries_toxicity, queries_vectors, queries_warc  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
