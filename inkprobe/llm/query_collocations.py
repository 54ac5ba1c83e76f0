"""op12: collocations in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.collocations import collocations, first_of_each
from inkprobe.llm.registry import query, table

SQL = r"""WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM docs),
totals AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, words[i : i + k - 1] AS gram FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words)),
phrases AS (SELECT lang, k, gram, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, gram, f AS a, unnest(range(1, k)) AS cut FROM phrases WHERE k >= 2),
scored AS (
  SELECT c.lang, c.k, c.gram, c.a, x.f AS l, y.f AS r, n, cut, 1000 * c.a * n // (x.f * y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.gram = c.gram[1 : cut]
  JOIN phrases y ON y.lang = c.lang AND y.gram = c.gram[cut + 1 : c.k] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, gram[i : i + m - 1] AS gram, max(f) AS longer
  FROM phrases, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.gram = l.gram WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (
  SELECT *, array_to_string(gram, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""


@query("op12_collocations", SQL)
def op12_collocations(spark, sf_dir):
    """Phrases of 2 to 5 words with 100 occurrences in a language; the first 2000 of each."""
    found = collocations(table(spark, sf_dir, "documents").select("lang", "text"), threshold=100, longest=5, contained=100)
    return first_of_each(found, 2000).select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
