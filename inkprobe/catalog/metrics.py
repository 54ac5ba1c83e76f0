"""Distribution metrics on full logit vectors, weighted means, pooling, scaling.

The 64 numbers of an embedding stand for the logits of one position over a vocabulary of
64 tokens; the positions of a class form a text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import query, r6, rounded, table
from inkprobe.functions import dense
from inkprobe.operators import averages, pooling, scaling

LOGITS_SQL = """logits AS (
  SELECT vec_id, label, (vec_id * 7) % 64 AS y, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS z
  FROM embeddings),
soft AS (SELECT *, z - ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lp FROM logits),
seen AS (SELECT vec_id, lp AS ly FROM soft WHERE i = y),
position AS (
  SELECT vec_id, label, max(ly) AS lp, -sum(exp(lp) * lp) AS entropy, max(lp) AS top,
    (1 + count(*) FILTER (lp > ly)) / 64.0 AS rank, sum(exp(lp)) FILTER (lp >= ly) AS mass,
    count(*) FILTER (lp >= ly) / 64.0 AS rank_ge
  FROM soft JOIN seen USING (vec_id) GROUP BY vec_id, label)"""


def logit_rows(spark, sf_dir):
    """``text_id, vec_id, logits, y, w``; class 3 has no weight at all."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("text_id"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("logits"),
        ((F.col("vec_id") * 7) % 64).cast("int").alias("y"),
        F.when(F.col("label") == 3, 0.0).otherwise(1.0).alias("w"),
    )


@query("log_softmax", f"WITH {LOGITS_SQL} SELECT vec_id, i AS pos, round(lp, 6) AS lp FROM soft")
def log_softmax(spark, sf_dir):
    rows = logit_rows(spark, sf_dir).select("vec_id", F.posexplode(dense.log_softmax(F.col("logits"))).alias("pos", "lp"))
    return rounded(rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "lp"))


@query(
    "position_metrics",
    f"""WITH {LOGITS_SQL} SELECT vec_id, round(lp, 6) AS "Mlog_prob", round(entropy, 6) AS "Mentropy",
  round(top, 6) AS "Mmax_log_prob", round(rank, 6) AS "Mrank", round(mass, 6) AS "Mtop_p",
  round(rank_ge, 6) AS "Mrank_ge" FROM position""",
)
def position_metrics(spark, sf_dir):
    """All six metrics of every position from its full vector."""
    rows = dense.position_metrics(logit_rows(spark, sf_dir))
    return rounded(rows.select("vec_id", *averages.METRICS, "Mrank_ge"))


_MEANS = """WITH {logits} SELECT CAST(label AS BIGINT) AS text_id,
  round(CASE WHEN label = 3 THEN 0 ELSE avg(lp) END, 6) AS {score}"""


@query(
    "pawn_metrics",
    f"""WITH {LOGITS_SQL}, means AS (
  SELECT CAST(label AS BIGINT) AS text_id, label <> 3 AS active, avg(lp) AS lp, avg(entropy) AS entropy, avg(top) AS top,
    avg(rank) AS rank, avg(mass) AS mass FROM position GROUP BY label)
SELECT text_id, round(CASE WHEN active THEN lp ELSE 0 END, 6) AS "Mlog_prob",
  round(CASE WHEN active THEN entropy ELSE 0 END, 6) AS "Mentropy",
  round(CASE WHEN active THEN top ELSE 0 END, 6) AS "Mmax_log_prob",
  round(CASE WHEN active THEN rank ELSE 0 END, 6) AS "Mrank",
  round(CASE WHEN active THEN mass ELSE 0 END, 6) AS "Mtop_p" FROM means""",
)
def pawn_metrics(spark, sf_dir):
    """Five metrics per text; a text without weight has zeros."""
    return rounded(averages.pawn_metrics(logit_rows(spark, sf_dir)))


@query(
    "sequence_log_likelihood",
    _MEANS.format(logits=LOGITS_SQL, score="score") + " FROM position GROUP BY label",
)
def sequence_log_likelihood(spark, sf_dir):
    return rounded(averages.sequence_log_likelihood(logit_rows(spark, sf_dir)))


@query(
    "weighted_mean",
    """SELECT l_orderkey, round(sum(l_extendedprice * l_discount) / greatest(sum(l_discount), 1), 6) AS l_extendedprice,
  round(sum(l_quantity * l_discount) / greatest(sum(l_discount), 1), 6) AS l_quantity
FROM lineitem GROUP BY l_orderkey""",
)
def weighted_mean(spark, sf_dir):
    """Weights below one in total meet the floor of one."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount")]
    )
    return rounded(averages.weighted_mean(lines, ["l_extendedprice", "l_quantity"], "l_discount", ["l_orderkey"]))


@query(
    "score_unmasked_mean",
    f"""WITH {LOGITS_SQL}, sums AS (
  SELECT label AS text_id, label >= 5 AS batch, sum(lp) AS total, count(*) AS n FROM position GROUP BY label)
SELECT CAST(text_id AS BIGINT) AS text_id, round(total / max(n) OVER (PARTITION BY batch), 6) AS score FROM sums""",
)
def score_unmasked_mean(spark, sf_dir):
    """The older score divides by the padded length of the batch."""
    rows = logit_rows(spark, sf_dir).withColumn("batch", F.col("text_id") >= 5)
    return rounded(averages.score_unmasked_mean(rows, "batch"))


@query(
    "mc_average",
    """SELECT o_custkey, round(avg(m), 6) AS price FROM (
  SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_custkey""",
)
def mc_average(spark, sf_dir):
    """A mean of means: each order status counts once per customer, whatever its size."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    draws = averages.weighted_mean(orders.withColumn("w", F.lit(1.0)), ["price"], by=["o_custkey", "o_orderstatus"])
    return rounded(averages.mc_average(draws, ["price"], ["o_custkey"]))


# ---- pooling of token vectors: the vectors of a class are the tokens of a text


def _vectors(spark, sf_dir):
    return logit_rows(spark, sf_dir).select(
        "text_id", F.col("vec_id").alias("pos"), F.col("logits").alias("vec"), "w"
    )


def _long(df):
    """One row per text and dimension."""
    rows = df.select("text_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.select("text_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


_POOL = """SELECT CAST(label AS BIGINT) AS text_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v)::DOUBLE, 6) AS value
FROM (SELECT label, {pick}(embedding, vec_id) AS v FROM embeddings GROUP BY label)"""


@query("pool_last", _POOL.format(pick="max_by"))
def pool_last(spark, sf_dir):
    return _long(pooling.pool_last(_vectors(spark, sf_dir)))


@query("pool_first", _POOL.format(pick="min_by"))
def pool_first(spark, sf_dir):
    return _long(pooling.pool_first(_vectors(spark, sf_dir)))


@query(
    "pool_mean",
    f"""WITH {LOGITS_SQL} SELECT CAST(label AS BIGINT) AS text_id, i AS dim,
  round(CASE WHEN label = 3 THEN 0 ELSE avg(z) END, 6) AS value FROM logits GROUP BY label, i""",
)
def pool_mean(spark, sf_dir):
    return _long(pooling.pool_mean(_vectors(spark, sf_dir)))


@query(
    "standard_scale",
    """WITH split AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY md5(concat_ws('|', '42', 'split', o_orderkey))) <= floor(0.2 * count(*) OVER (PARTITION BY o_orderstatus) + 0.5)
    AS is_test FROM orders),
stats AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM split WHERE NOT is_test)
SELECT o_orderkey, is_test, round((o_totalprice - m) / s, 6) AS price, 0.0::DOUBLE AS flat FROM split, stats""",
)
def standard_scale(spark, sf_dir):
    """Fitted on the training rows, applied to all; a constant column becomes 0."""
    from inkprobe.operators.sampling import stratified_split

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"), F.lit(4.5).alias("flat")
    )
    split = stratified_split(orders, "o_orderstatus", 0.2, 42, "o_orderkey")
    scaled = scaling.standard_scale(split.filter(~F.col("is_test")), split, ["price", "flat"])
    return rounded(scaled.drop("o_orderstatus"))
