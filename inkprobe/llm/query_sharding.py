"""op1: documents dealt to 16 shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.registry import query, table
from inkprobe.llm.sharding import interleave

SHARDS = 16

# CRC-32 byte by byte; its table comes from the reversed polynomial.
SQL = f"""WITH crc_table AS (
  SELECT list(list_reduce([n] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
    ORDER BY n) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
sized AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda p: CAST('0x' || p AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    md5(concat_ws('|', '17', doc_id)) AS digest
  FROM documents, crc_table),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
    CAST('0x' || md5(concat_ws('|', '17', 'first', CASE WHEN source IS NULL THEN 'true' ELSE 'false' END, coalesce(source, '')))[1:3] AS BIGINT) AS u
  FROM sized),
spots AS (
  SELECT *, row_number() OVER (ORDER BY (rank * 4096 + u)::DOUBLE / (n * 4096), coalesce(source, ''), source IS NULL, rank) - 1 AS spot,
    count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, CAST(spot * {SHARDS} // total AS INTEGER) AS shard FROM spots)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard,
  CAST(spot - (CAST(shard AS BIGINT) * total + {SHARDS} - 1) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""


@query("op1_sharding", SQL)
def op1_sharding(spark, sf_dir):
    """All documents in 16 shards of equal row counts, each with the mixture of sources of the whole."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return interleave(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
