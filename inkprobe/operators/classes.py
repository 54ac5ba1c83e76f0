"""Class counts, shares and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from inkprobe.functions.text import label_name


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Per cent of rows per class, with the display name of the class."""
    counts = class_counts(df, label_col)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label_name(F.col(label_col)).alias("class_name"), (F.col("n") * 100.0 / total).alias("share"))


def balanced_weights(df: DataFrame, label_col: str = "label", name: str = "weight") -> DataFrame:
    """Add ``n / (classes * rows of the class)`` to every row.

    The class table has one row per class and is the only thing broadcast.
    """
    return _with_class_value(df, label_col, name, lambda n, total, kinds, inverse: total / (kinds * n))


def inverse_freq_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Class table ``label, weight`` with ``(1/n_c) / sum(1/n)``.

    With a single class present, both classes 0 and 1 get weight 1.
    """
    counts = class_counts(df, label_col)
    every = Window.partitionBy()
    weighted = counts.select(
        F.col(label_col),
        ((1 / F.col("n")) / F.sum(1 / F.col("n")).over(every)).alias("weight"),
        F.count(F.lit(1)).over(every).alias("kinds"),
    )
    alone = weighted.filter(F.col("kinds") == 1).select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias(label_col), F.lit(1.0).alias("weight")
    )
    return weighted.filter(F.col("kinds") > 1).select(label_col, "weight").unionByName(alone)


def _with_class_value(df: DataFrame, label_col: str, name: str, value) -> DataFrame:
    counts = class_counts(df, label_col)
    every = Window.partitionBy()
    table = counts.select(
        F.col(label_col),
        value(F.col("n"), F.sum("n").over(every), F.count(F.lit(1)).over(every), None).alias(name),
    )
    return df.join(F.broadcast(table), label_col)
