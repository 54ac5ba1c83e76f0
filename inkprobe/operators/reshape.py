"""Cleaning, reshaping, union and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from inkprobe.functions import text as tx
from inkprobe.session import stage_counting


def clean_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Write the cleaned ``text_col`` to ``text`` and drop rows whose text is null."""
    return df.filter(F.col(text_col).isNotNull()).withColumn("text", tx.clean(F.col(text_col)))


def melt_binary_text(df: DataFrame, pos_col: str, neg_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide pair to long ``text,label`` rows: ``pos_col`` as 1, ``neg_col`` as 0.

    One scan feeds both classes; nulls are kept; ``keep`` carries key columns along.
    """
    pairs = F.array(
        F.struct(F.col(pos_col).alias("text"), F.lit(1).alias("label")),
        F.struct(F.col(neg_col).alias("text"), F.lit(0).alias("label")),
    )
    return df.select(*keep, F.inline(pairs))


def invert_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Flip a 0/1 label column; the input frame stays as it is."""
    return df.withColumn(col, tx.invert_label(F.col(col)))


def copy_column(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Second name for a column."""
    return df.withColumn(dst, F.col(src))


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows with any or all of ``cols`` missing (null or NaN)."""
    return df.na.drop(how=how, subset=list(cols))


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("text_id", "label")) -> DataFrame | None:
    """The named feature columns in fixed order, or ``None`` when one is missing."""
    if not set(names) <= set(df.columns):
        return None
    return df.select(*[c for c in keep if c in df.columns], *names)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns absent from a frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assemble_features(base: DataFrame, features: Mapping[str, DataFrame], key: str = "text_id") -> DataFrame:
    """Side-by-side features of several models, columns named ``<metric>_<model>``.

    All inputs are keyed alike, so one hash partitioning serves the whole chain of joins.
    """
    for model, frame in features.items():
        renamed = frame.select(key, *[F.col(c).alias(f"{c}_{model}") for c in frame.columns if c != key])
        base = base.join(renamed, key, "left")
    return base


def align_features(features: DataFrame, labels: DataFrame, key: str = "text_id", check: bool = True) -> DataFrame:
    """Features joined to labels one to one; raises when keys repeat or do not match.

    The check is part of the join: both sides are run once, met in a full outer join by key and staged, and rows that lack a side or share their key are
    counted while they are written. Without ``check`` it is a plain join.
    """
    if not check:
        return labels.join(features, key)
    left, right = _free_name("labelled", labels, features), _free_name("featured", labels, features)
    met = labels.withColumn(left, F.lit(True)).join(features.withColumn(right, F.lit(True)), key, "full_outer")
    several = _free_name("several", labels, features)
    met = met.withColumn(several, F.count(F.lit(1)).over(Window.partitionBy(key)) > 1)
    wrong = F.col(left).isNull() | F.col(right).isNull() | F.col(several) | F.col(key).isNull()
    aligned, bad = stage_counting(met, "aligned", wrong)
    if bad:
        raise ValueError(f"features and labels do not match one to one on {key}: {aligned.filter(wrong).select(key, left, right).first().asDict()}")
    return aligned.drop(left, right, several)


def _free_name(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name
