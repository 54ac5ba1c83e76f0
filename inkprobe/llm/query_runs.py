"""op11: periodic runs of words in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.periodic_runs import periodic_runs
from inkprobe.llm.registry import query, table

WORDS = r"[^\x20\x09-\x0D]+"

# CRC-32 byte by byte; its table comes from the reversed polynomial.
SQL = r"""WITH crc_table AS (
  SELECT list(list_reduce([n] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
    ORDER BY n) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'),
      lambda p: CAST('0x' || p AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table),
planned AS (
  SELECT doc_id, own, len(own) AS n, h % 10 = 0 AND len(own) > 0 AS planted, (h // 10) % greatest(len(own), 1) AS a, h // 10 AS g FROM hashed),
docs AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n),
    lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE own END AS words FROM planned),
places AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM docs),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y USING (doc_id, word) WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
lists AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM places ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs LEFT JOIN lists USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN collapsed USING (doc_id)"""


def planted(docs):
    """``doc_id, text``, where one document in ten repeats its own words from a place on, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    # The words are bound to a lambda's variable: a column of them would be computed anew for each word.
    bound = F.array(F.struct(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("w"), F.floor(F.col("h") / 10).alias("g")))
    bound = F.transform(F.filter(bound, lambda x: F.size(x.w) > 0), lambda x: F.struct(x.w, x.g, F.size(x.w).cast("long").alias("n"), (x.g % F.size(x.w)).alias("a")))
    bound = F.transform(bound, lambda x: F.struct(x.w, x.n, x.a, (1 + F.floor((x.n - x.a) / (3 + x.g % 8))).alias("p")))
    place = lambda x, i: F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p).cast("int")
    text = F.transform(bound, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x.n - 1), lambda i: F.get(x.w, place(x, i))), " "))
    return own.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(F.get(text, 0), "text")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", SQL)
def op11_periodic_runs(spark, sf_dir):
    """Every whole document, with the planted repetitions."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), keep=["doc_id"])
    more, less = "a.length * b.period > b.length * a.period", "a.length * b.period < b.length * a.period"
    before = f"{more} OR (NOT ({less}) AND struct(a.start, a.period) < struct(b.start, b.period))"
    best = F.expr(f"aggregate(runs, runs[0], (b, a) -> IF({before}, a, b))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best").getField(k).alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
