"""Query of the WARC writer and its SQL."""

from .common import table
from .registry import query
from .warc_zstd import read_archives, write_archives


@query("op7_warc_zstd", """
  with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
                    sha1(coalesce(html, '')) as payload_digest from pages),
  h as (select payload_digest, max(page_id) as head from p where payload_bytes >= 1000
        group by payload_digest having count(*) > 1)
  select page_id, payload_bytes, p.payload_digest,
    case when head is null or page_id = head then 'response' else 'revisit' end as record_type,
    case when page_id <> head then head end as refers_to
  from p left join h on p.payload_digest = h.payload_digest and payload_bytes >= 1000""")
def op7_warc_zstd(spark, sf_dir):
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
