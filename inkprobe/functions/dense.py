"""Distribution metrics of one position from its full logit vector.

``logits`` is ``array<double>`` over the vocabulary, ``target`` the zero-based id of the
observed token. Everything runs on the array inside the row: no explode, no shuffle.
Comparisons use the logits themselves, whose order is that of the probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top)))


def log_softmax(logits: Column) -> Column:
    """``z - ln(sum(exp(z)))`` for each entry."""
    norm = log_sum_exp(logits)
    return F.transform(logits, lambda z: z - norm)


def _at(logits: Column, target: Column) -> Column:
    return F.element_at(logits, target + 1)


def log_prob(logits: Column, target: Column, norm: Column | None = None) -> Column:
    return _at(logits, target) - (log_sum_exp(logits) if norm is None else norm)


def entropy(logits: Column, norm: Column | None = None) -> Column:
    norm = log_sum_exp(logits) if norm is None else norm
    return -F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - norm) * (z - norm))


def max_log_prob(logits: Column, norm: Column | None = None) -> Column:
    return F.array_max(logits) - (log_sum_exp(logits) if norm is None else norm)


def rank(logits: Column, target: Column) -> Column:
    """One plus the number of strictly larger entries, as a share of the vocabulary."""
    seen = _at(logits, target)
    larger = F.aggregate(logits, F.lit(0), lambda acc, z: acc + F.when(z > seen, 1).otherwise(0))
    return (larger + 1) / F.size(logits)


def rank_ge(logits: Column, target: Column) -> Column:
    """Number of entries at least as large, as a share of the vocabulary."""
    seen = _at(logits, target)
    at_least = F.aggregate(logits, F.lit(0), lambda acc, z: acc + F.when(z >= seen, 1).otherwise(0))
    return at_least / F.size(logits)


def top_p(logits: Column, target: Column, norm: Column | None = None) -> Column:
    """Probability mass of the entries at least as large as the observed one."""
    norm = log_sum_exp(logits) if norm is None else norm
    seen = _at(logits, target)
    return F.aggregate(
        logits, F.lit(0.0), lambda acc, z: acc + F.when(z >= seen, F.exp(z - norm)).otherwise(F.lit(0.0))
    )


def position_metrics(df: DataFrame, logits: str = "logits", target: str = "y") -> DataFrame:
    """Add the five position metrics and ``Mrank_ge``; the normaliser is computed once."""
    z, y = F.col(logits), F.col(target)
    with_norm = df.withColumn("_norm", log_sum_exp(z))
    norm = F.col("_norm")
    return with_norm.select(
        "*",
        log_prob(z, y, norm).alias("Mlog_prob"),
        entropy(z, norm).alias("Mentropy"),
        max_log_prob(z, norm).alias("Mmax_log_prob"),
        rank(z, y).alias("Mrank"),
        top_p(z, y, norm).alias("Mtop_p"),
        rank_ge(z, y).alias("Mrank_ge"),
    ).drop("_norm")
