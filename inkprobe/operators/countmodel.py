"""Language model by counting: exact distribution metrics without a V-wide vector.

With ``n`` uses of a token in a context, ``N`` uses of the context and smoothing ``a``,
``P = (n + a) / (N + aV)``. Every metric of a position depends on its context and on ``n`` alone, and
unseen tokens all share one value. The log-probability needs ``n`` and the sum of the context; ranks, masses and entropies come from the
counts of counts of the context, (context, n) -> tokens, which are few however large the vocabulary is.
``contexts.text_sums`` computes them where all positions of a context meet, and uses :func:`count_metrics` for contexts that are too large for that.

Tokens are 64-bit hashes (``tokens.hashed``). ``part`` names the model a row belongs to, so several models
(cross-fit halves) are fitted in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from inkprobe.functions.keys import half_key

CONTEXT = ["part", "left", "right"]
PAIR = [*CONTEXT, "token"]
PAIR_METRICS = ["Mlog_prob", "Mentropy", "Mmax_log_prob", "Mrank", "Mtop_p", "Mrank_ge"]
PARTS = 2


def cross_fit_half(seed: int, *ids: str):
    """Half 0 or 1 of a row. Texts of one half are scored by counts of the other."""
    return F.when(half_key(seed, F.lit("half"), *[F.col(i) for i in ids]) < "80000000", 0).otherwise(1)


def count_metrics(pairs: DataFrame, vocab_size: int, alpha: float, metrics: Sequence[str] = PAIR_METRICS) -> DataFrame:
    """The ``metrics`` of every used count: ``part, left, right, n, asked, <metrics>``.

    ``pairs`` holds ``n`` and ``uses`` of every pair, once each. Pairs of a context with one count have the same metrics.
    """
    v, a = F.lit(float(vocab_size)), F.lit(float(alpha))
    asked = F.count_if(F.col("uses") > 0).alias("asked")
    kinds = pairs.groupBy(*CONTEXT, "n").agg(F.count(F.lit(1)).alias("kinds_at"), asked)
    # Tokens that were never counted in the context are in ``kinds_at`` of n = 0 only if they were used: they don't count as kinds.
    kinds = kinds.withColumn("kinds_at", F.when(F.col("n") > 0, F.col("kinds_at")).otherwise(F.lit(0)))
    by_use = Window.partitionBy(*CONTEXT).orderBy(F.desc("n"))
    whole = by_use.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = by_use.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    smoothed = F.col("n") + a
    table = kinds.select(
        *CONTEXT, "n", "asked", "kinds_at",
        F.sum(F.col("n") * F.col("kinds_at")).over(whole).alias("total"),
        F.max("n").over(whole).alias("top"),
        F.sum("kinds_at").over(whole).alias("kinds"),
        F.sum(F.col("kinds_at") * smoothed * F.ln(smoothed)).over(whole).alias("plogp"),
        F.sum(F.col("n") * F.col("kinds_at")).over(above).alias("uses_ge"),
        F.sum("kinds_at").over(above).alias("kinds_ge"),
    ).filter("asked > 0")
    mass = F.col("total") + a * v
    values = {
        "Mlog_prob": F.ln(smoothed) - F.ln(mass),
        "Mentropy": F.ln(mass) - (F.col("plogp") + (v - F.col("kinds")) * a * F.ln(a)) / mass,
        "Mmax_log_prob": F.ln(F.col("top") + a) - F.ln(mass),
        "Mrank": (F.col("kinds_ge") - F.col("kinds_at") + 1) / v,
        "Mtop_p": F.when(F.col("n") > 0, (F.col("uses_ge") + a * F.col("kinds_ge")) / mass).otherwise(F.lit(1.0)),
        "Mrank_ge": F.when(F.col("n") > 0, F.col("kinds_ge") / v).otherwise(F.lit(1.0)),
    }
    return table.select(*CONTEXT, "n", "asked", *[values[m].alias(m) for m in metrics])
