"""Labelled corpora in one shape: ``row_key, text, label`` with label 1 = human.

Each loader reads one source layout, declares its schema, cleans the text and derives the
label. With ``n_total`` it returns the class-balanced sample (``text_id, text, label``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkprobe.functions.text import derive_label
from inkprobe.operators.reshape import clean_text, invert_label, melt_binary_text
from inkprobe.operators.sampling import balanced_sample


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON-lines files by extension; parquet when there is none."""
    reader = spark.read.schema(schema) if schema else spark.read
    bare = path.rstrip("/").rstrip("*")
    if bare.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if bare.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return reader.json(path)
    return reader.parquet(path)


def file_row_key() -> Column:
    """Key of a row that has none: its parquet file and its place in that file.

    Stable under task retries, and equal rows keep different keys.
    """
    return F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def _finish(df: DataFrame, key: Column, n_total: int | None, seed: int) -> DataFrame:
    corpus = clean_text(df).select(key.alias("row_key"), "text", F.col("label").cast("int").alias("label"))
    if n_total is None:
        return corpus
    return balanced_sample(corpus, "label", n_total, seed).select("text_id", "text", "label")


def from_plain(df: DataFrame, key: Column, n_total: int | None = None, seed: int = 41) -> DataFrame:
    """``text, label`` with label 1 = human."""
    return _finish(df, key, n_total, seed)


def from_generation(df: DataFrame, key: Column, n_total: int | None = None, seed: int = 41) -> DataFrame:
    """``generation, model``: the text is ``generation``; human where ``model`` says so."""
    labelled = df.withColumn("text", F.col("generation")).withColumn("label", derive_label(F.col("model")))
    return _finish(labelled, key, n_total, seed)


def from_source(df: DataFrame, key: Column, n_total: int | None = None, seed: int = 41) -> DataFrame:
    """``source, text``: human where ``source`` says so."""
    return _finish(df.withColumn("label", derive_label(F.col("source"))), key, n_total, seed)


def from_paired(
    df: DataFrame,
    key: Column,
    pos: str = "human_output",
    neg: str = "model_output",
    n_total: int | None = None,
    seed: int = 41,
) -> DataFrame:
    """One row with a human and a machine text side by side."""
    long = melt_binary_text(df.withColumn("pair_key", key), pos, neg, keep=["pair_key"])
    return _finish(long, F.concat_ws("|", F.col("pair_key").cast("string"), F.col("label")), n_total, seed)


def from_inverted(df: DataFrame, key: Column, n_total: int | None = None, seed: int = 41) -> DataFrame:
    """``text, label`` with label 0 = human."""
    return _finish(invert_label(df), key, n_total, seed)


def _load(spark: SparkSession, path: str, columns: str, id_col: str | None, id_type: str) -> tuple[DataFrame, Column]:
    schema = columns if id_col is None else f"{id_col} {id_type}, {columns}"
    df = read_table(spark, path, schema)
    if id_col is not None:
        return df, F.col(id_col)
    return df.withColumn("_file_key", file_row_key()), F.col("_file_key")


def load_plain(spark, path, n_total=None, seed=41, id_col=None, id_type="bigint") -> DataFrame:
    """Files with ``text, label``."""
    df, key = _load(spark, path, "text string, label int", id_col, id_type)
    return from_plain(df, key, n_total, seed)


def load_generation(spark, path, n_total=None, seed=41, id_col=None, id_type="bigint") -> DataFrame:
    """Files with ``generation, model``."""
    df, key = _load(spark, path, "generation string, model string", id_col, id_type)
    return from_generation(df, key, n_total, seed)


def load_source(spark, path, n_total=None, seed=41, id_col=None, id_type="bigint") -> DataFrame:
    """Files with ``source, text``."""
    df, key = _load(spark, path, "source string, text string", id_col, id_type)
    return from_source(df, key, n_total, seed)


def load_paired(
    spark, path, pos="human_output", neg="model_output", n_total=None, seed=41, id_col=None, id_type="bigint"
) -> DataFrame:
    """Files with two sibling text columns; other columns are never read."""
    df, key = _load(spark, path, f"{pos} string, {neg} string", id_col, id_type)
    return from_paired(df, key, pos, neg, n_total, seed)


def load_inverted(spark, path, n_total=None, seed=41, id_col=None, id_type="bigint") -> DataFrame:
    """Files with ``text, label`` where 0 = human."""
    df, key = _load(spark, path, "text string, label int", id_col, id_type)
    return from_inverted(df, key, n_total, seed)
