"""op10: groups of similar documents."""

from __future__ import annotations

from inkprobe.llm.ngram_join import similarity_components
from inkprobe.llm.registry import query, table

SQL = r"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(words[i : i + 4], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM docs WHERE len(words) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 75 * (s.n + t.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)"""


@query("op10_ngram_join", SQL)
def op10_ngram_join(spark, sf_dir):
    """Five words, similarity 0.75 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_components(docs, size=5, similarity=(3, 4))
