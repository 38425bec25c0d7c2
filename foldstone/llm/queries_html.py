"""Query of the main text of pages."""

from pyspark.sql import functions as F

from .common import table
from .host_boilerplate import main_text
from .registry import query


@query("op11_host_suffixes")
def op11_host_suffixes(spark, sf_dir):
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text",
                        F.length("text").cast("long").alias("n_chars"))
