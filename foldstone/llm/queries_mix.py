"""Query of the Poisson mixing operator and its SQL."""

from pyspark.sql import functions as F

from .common import table
from .poisson_mix import mix_sources
from .registry import query

ALPHA, SEED = 0.5, 7

COUNTS_SQL = """
  per as (select source, count(*) as rows, sqrt(count(*)) as want from {docs} group by source),
  rated as (select source, want / (select sum(want) from per) * (select sum(rows) from per) / rows
              as rate from per),
  steps as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::int + 1)) as k
            from rated),
  cdf as (select source, list(p order by k) as cdf from (
            select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1)))
              over (partition by source order by k) as p from steps) group by source),
  drawn as (select d.*, len(list_filter(c.cdf, lambda p: p <= ('0x' || substr(md5('{seed}|'
              || coalesce(d.doc_id::varchar, '') || '|' || md5(coalesce(d.text, ''))), 1, 13))::ubigint
              / 4503599627370496.0)) as times
            from {docs} d join cdf c on d.source is not distinct from c.source)
"""


@query("op10_poisson_mix", "with " + COUNTS_SQL.format(docs="documents", seed=SEED) + """
  select doc_id, source, copy, sha256(coalesce(text, '')) as text_sha256 from (
    select *, unnest(range(1, times + 1)) as copy from drawn)""")
def op10_poisson_mix(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), alpha=ALPHA, seed=SEED)
    return mixed.select("doc_id", "source", "copy",
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
