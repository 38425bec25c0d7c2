"""Model training jobs and end-to-end workflows built on pyspark.ml."""
