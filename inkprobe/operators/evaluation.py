"""Exact classification metrics as grouped aggregates.

Everything is read off one small table: the rows of each class per distinct score. It is
counted map-side first, so tied scores collapse before the shuffle. ``by`` evaluates many
runs (folds, models, strategies) in one job; its columns must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprobe.session import stage

RATES = ["roc_auc", "accuracy", "f1", "recall", "precision"]

# Distinct scores that one window ranks; the score axis is cut at quantiles so that no slot has many more.
WINDOW_ROWS = 200_000


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` of 0/1 labels and predictions."""
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def confusion_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, F1, recall and precision; an undefined rate is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "recall": _ratio(tp, tp + fn),
            "precision": _ratio(tp, tp + fp),
        }
    )


def score_tallies(df: DataFrame, score_col: str, label_col: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``by, score, pos, neg``: rows of each class per distinct score.

    Staged, so the scoring job above it runs once for all metrics; this job runs while the plan is built.
    A null or NaN score has no place in a ranking and raises; infinite scores rank like others.
    """
    tallies = df.groupBy(*by, F.col(score_col).cast("double").alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) != 1).alias("neg")
    )
    tallies = stage(tallies, "tallies")
    if not tallies.filter(F.col("score").isNull() | F.isnan("score")).isEmpty():
        raise ValueError(f"{score_col} has null or NaN scores")
    return tallies


def _negatives_below(tallies: DataFrame, by: Sequence[str], window_rows: int) -> DataFrame:
    """Add the number of negatives with a smaller score in the same run."""
    runs = list(by)
    below = lambda *keys: (
        Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Cut points are few enough to become literals, and as literals every pass uses the very same ones.
    n = -(-tallies.count() // window_rows)
    cuts = tallies.agg(F.percentile_approx("score", [i / n for i in range(1, n)], 20_000)).first()[0] if n > 1 else []
    finite = sorted({float(c) for c in cuts if math.isfinite(c)} or {0.0})
    splits = [float("-inf"), *finite, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="slot").transform(tallies)
    before = Window.partitionBy(*runs).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = cut.groupBy(*runs, "slot").agg(F.sum("neg").alias("n"))
    slots = slots.select(*runs, "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("neg_before"))
    inside = F.coalesce(F.sum("neg").over(below(*runs, "slot")), F.lit(0))
    return (
        cut.join(slots, [*runs, "slot"])
        .withColumn("neg_below", F.col("neg_before") + inside)
        .drop("slot", "neg_before")
    )


def _area(pairs: Column, pos: Column, neg: Column) -> Column:
    return F.when((pos == 0) | (neg == 0), F.lit(float("nan"))).otherwise(pairs / (pos * neg))


def roc_auc(
    df: DataFrame, score_col: str, label_col: str = "label", by: Sequence[str] = (), window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Exact area under the ROC curve; ties count one half, a single class gives NaN."""
    return evaluate_scores(df, score_col, label_col, by=by, window_rows=window_rows).select(*by, "roc_auc")


def evaluate_scores(
    df: DataFrame,
    score_col: str = "score",
    label_col: str = "label",
    threshold: float = 0.5,
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``roc_auc, accuracy, f1, recall, precision`` of each run, in one aggregate."""
    ranked = _negatives_below(score_tallies(df, score_col, label_col, by), by, window_rows)
    hit = F.col("score") >= F.lit(float(threshold))
    pos, neg = F.col("pos"), F.col("neg")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(pos)).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
        F.sum(pos * (F.col("neg_below") + neg / 2)).alias("pairs"),
    )
    area = _area(F.col("pairs"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"))
    return confusion_rates(sums.withColumn("roc_auc", area)).select(*by, *RATES)


def accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions."""
    return confusion_rates(confusion_counts(df, label_col, pred_col, by)).select(*by, "accuracy")


def precision(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Right share of the predicted positives."""
    return confusion_rates(confusion_counts(df, label_col, pred_col, by)).select(*by, "precision")


def recall(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Found share of the true positives."""
    return confusion_rates(confusion_counts(df, label_col, pred_col, by)).select(*by, "recall")


def f1(df: DataFrame, label_col: str = "label", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Harmonic mean of precision and recall."""
    return confusion_rates(confusion_counts(df, label_col, pred_col, by)).select(*by, "f1")


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted means.

    Works for any number of classes; built on the counts per (label, prediction).
    """
    cells = df.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )
    right = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sums = (
        cells.withColumn("right", right)
        .select("right", F.posexplode(sides).alias("side", "s"))
        .groupBy(F.col("s.class").alias("class"))
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("right")).otherwise(0)).alias("right"),
            F.sum("s.support").alias("support"),
            F.sum("s.said").alias("said"),
        )
    )
    per_class = sums.select(
        F.col("class").cast("string").alias("class"),
        _ratio(F.col("right"), F.col("said")).alias("precision"),
        _ratio(F.col("right"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("right"), F.col("said") + F.col("support")).alias("f1"),
        F.col("support"),
        F.col("right"),
    )
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    overall = F.sum("right") / total
    summary = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                overall.alias("precision"),
                overall.alias("recall"),
                overall.alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("right").unionByName(summary)
