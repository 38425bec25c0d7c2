"""Query of the hard-negative mining and its SQL."""

from pyspark.sql import functions as F

from .common import table
from .hard_negatives import hard_negatives
from .registry import query


@query("op12_hard_negatives", """
  with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                    list_transform(embedding, lambda x: floor(256 * x::double)) as v
             from embeddings where label is not null and vec_id is not null and embedding is not null
               and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
               list_inner_product(a.v, b.v)::bigint as score
        from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select anchor_id, id, score from s where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
  n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id,
               s.score as negative_score, row_number() over (
                 partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
        from p join s on s.anchor_id = p.anchor_id and not s.same
         and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
  select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
  from n where rank <= 10""")
def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10) \
        .otherwise(F.col("label"))
    return hard_negatives(vectors, label=label)
