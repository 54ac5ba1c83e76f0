"""op4: pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.registry import query, table
from inkprobe.llm.warc import archive_records, read_warc, write_warc
from inkprobe.session import staging_path

SQL = """WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts"""


@query("op4_warc", SQL)
def op4_warc(spark, sf_dir):
    """One record per page; responses are read with their payloads, revisits by their headers alone."""
    pages = table(spark, sf_dir, "pages")
    path = staging_path(spark, "warc")
    write_warc(archive_records(pages), path)
    row_id = F.col("fields")["x-row-id"].cast(pages.schema["page_id"].dataType)
    responses = read_warc(spark, path).filter(F.col("record_type") == "response").select(
        row_id.alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )
    revisits = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(
        row_id.alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        F.col("fields")["x-refers-to-row-id"].cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )
    return responses.unionByName(revisits)
