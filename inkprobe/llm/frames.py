"""Helpers for operators in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def packed(df: DataFrame, keep: Sequence[str]) -> Column:
    """All columns to return as one struct, so that no inner name can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("boolean")


def unpacked(df: DataFrame, name: str, keep: Sequence[str], added: Sequence[str | Column]) -> DataFrame:
    """The columns of the struct ``name``, and ``added``."""
    return df.select(*[F.col(name).getField(c).alias(c) for c in keep], *added)


def kept_columns(df: DataFrame, keep: Sequence[str] | None, added: Sequence[str]) -> list[str]:
    """Columns to carry: ``keep``, or all but those that the operator adds (a clashing column is replaced)."""
    names = {n.lower() for n in added}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
