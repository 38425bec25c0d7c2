"""foldstone: feature, validation and scoring jobs for dated, located, labelled records on Spark.

Every operator takes and returns DataFrames.  Nothing here depends on row order; rows are
identified by a key column, folds are a column, and predictions are a long table.
"""

from foldstone.session import checkpoint, get_session

__all__ = ["checkpoint", "get_session"]
