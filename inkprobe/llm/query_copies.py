"""op13: exact copies of documents."""

from __future__ import annotations

from inkprobe.llm.exact_dedup import exact_dedup
from inkprobe.llm.registry import query, table

SQL = r"""WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) AS place FROM texts)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY place) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size, place = 1 AS kept, text_sha256 FROM ranked"""


@query("op13_exact_dedup", SQL)
def op13_exact_dedup(spark, sf_dir):
    """Every document with the one that stays for it."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
