"""Per-text averages of position metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from inkprobe.functions import dense

METRICS = ["Mlog_prob", "Mentropy", "Mmax_log_prob", "Mrank", "Mtop_p"]


def weighted_mean(
    positions: DataFrame, metrics: Sequence[str], weight: str = "w", by: Sequence[str] = ("text_id",)
) -> DataFrame:
    """``sum(m * w) / max(sum(w), 1)`` per text; no weight at all gives 0, not null.

    Summed map-side first, so the shuffle carries one row per text and task.
    """
    w = F.col(weight)
    floor = F.greatest(F.sum(w), F.lit(1.0))
    used = lambda m: F.when(w != 0, F.col(m) * w).otherwise(F.lit(0.0))
    return positions.groupBy(*by).agg(*[(F.sum(used(m)) / floor).alias(m) for m in metrics])


def with_empty_texts(
    positions: DataFrame, texts: DataFrame, metrics: Sequence[str], weight: str = "w", by: Sequence[str] = ("text_id",)
) -> DataFrame:
    """Add one weightless row per text, so a text without positions still gets its row."""
    empty = texts.select(*by, *[F.lit(0.0).alias(m) for m in metrics], F.lit(0.0).alias(weight))
    return positions.select(*by, *metrics, weight).unionByName(empty)


def pawn_metrics(
    positions: DataFrame,
    logits: str = "logits",
    target: str = "y",
    weight: str = "w",
    by: Sequence[str] = ("text_id",),
) -> DataFrame:
    """The five metrics of every text from full logit vectors.

    Weightless positions skip the vector math and count as zero rows, which keeps their
    texts in the result.
    """
    active = dense.position_metrics(positions.filter(F.col(weight) != 0), logits, target)
    rows = with_empty_texts(active, positions.filter(F.col(weight) == 0), METRICS, weight, by)
    return weighted_mean(rows, METRICS, weight, by)


def sequence_log_likelihood(
    positions: DataFrame,
    logits: str = "logits",
    target: str = "y",
    weight: str = "w",
    by: Sequence[str] = ("text_id",),
) -> DataFrame:
    """Mean log-probability of the observed tokens of every text, as ``score``."""
    active = positions.filter(F.col(weight) != 0).withColumn("score", dense.log_prob(F.col(logits), F.col(target)))
    rows = with_empty_texts(active, positions.filter(F.col(weight) == 0), ["score"], weight, by)
    return weighted_mean(rows, ["score"], weight, by)


def score_unmasked_mean(
    positions: DataFrame, batch: str, logits: str = "logits", target: str = "y", by: Sequence[str] = ("text_id",)
) -> DataFrame:
    """Older score: mean over *all* slots of the padded batch, padding included.

    ``positions`` holds the real and the padded slots of a text with their logits; the
    padded length is the longest text of its ``batch``.
    """
    scored = positions.withColumn("score", dense.log_prob(F.col(logits), F.col(target)))
    sums = scored.groupBy(batch, *by).agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("slots"))
    longest = sums.groupBy(batch).agg(F.max("slots").alias("padded"))
    return sums.join(longest, batch).select(*by, (F.col("total") / F.col("padded")).alias("score"))


def mc_average(per_draw: DataFrame, metrics: Sequence[str] = tuple(METRICS), by: Sequence[str] = ("text_id",)) -> DataFrame:
    """Mean over the draws of each draw's own mean (a mean of means, not a pooled one)."""
    return per_draw.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
