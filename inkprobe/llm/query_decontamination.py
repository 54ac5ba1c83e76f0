"""op7: what documents share with benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.decontamination import find_contamination
from inkprobe.llm.registry import query, table

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL = f"""WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, words[i : i + least(len(words), 10) - 1] AS win
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
places AS (
  SELECT doc_id, size, i, words[i : i + size - 1] AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
found AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, win)),
hits AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS w FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op7_decontamination", SQL)
def op7_decontamination(spark, sf_dir):
    """Windows of 10 words of all benchmark items against every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
