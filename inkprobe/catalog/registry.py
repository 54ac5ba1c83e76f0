"""Registry of queries and the shared pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkprobe.functions.text import WHITESPACE_CLASS
from inkprobe.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is one."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared staging folder."""
    return staging_path(spark, name)


def r6(column: Column | str) -> Column:
    """Six decimals: sums of doubles depend on row order beyond that."""
    return F.round(column if isinstance(column, Column) else F.col(column), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITESPACE_CLASS}+', ' ', 'g'))"


# ---- corpora built from the test tables

TURN_KEY = "concat_ws('-', conv_id, turn)"


def quality_rows(spark, sf_dir) -> DataFrame:
    """``id, text, label``: documents with their quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def toxicity_rows(spark, sf_dir) -> DataFrame:
    """``id, text, label``: documents with their toxicity label, 0 being the good class."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def turn_rows(spark, sf_dir) -> DataFrame:
    """``id, text, source``: user and assistant turns."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return turns.select(
        F.expr(TURN_KEY).alias("id"), "text", F.when(F.col("role") == "user", "human").otherwise("ai").alias("source")
    )


def pair_rows(spark, sf_dir) -> DataFrame:
    """``id, human_output, model_output``: a user turn and the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("human_output"))
    said = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("model_output")
    )
    return asked.join(said, ["conv_id", "turn"]).select(F.expr(TURN_KEY).alias("id"), "human_output", "model_output")


# CTEs of the same corpora: row_key, text, label.
QUALITY_SQL = f"""quality AS (
  SELECT doc_id AS row_key, {clean_sql('text')} AS text, label FROM (
    SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)) WHERE text IS NOT NULL)"""
TOXICITY_SQL = f"""toxicity AS (
  SELECT doc_id AS row_key, {clean_sql('text')} AS text, 1 - toxic AS label
  FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)"""
TURNS_SQL = f"""turns AS (
  SELECT conv_id || '-' || turn AS row_key, {clean_sql('text')} AS text, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label
  FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL)"""


def largest_balanced(rows: DataFrame) -> int:
    """Size of the largest class-balanced sample of human and machine rows."""
    smallest = rows.groupBy("source").count().agg(F.min("count")).first()[0]
    return 2 * smallest


def sample_sql(source: str, n_total: int | None, seed: int = 41) -> str:
    """CTE ``sample`` of a corpus CTE: text_id, text, label of the balanced sample.

    Without ``n_total`` it is the largest one.
    """
    per_class = n_total // 2 if n_total else f"(SELECT min(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY label))"
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{seed}', 'sample', row_key))) AS place
  FROM {source}),
sample AS (
  SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', 'shuffle', row_key))) - 1 AS text_id, text, label
  FROM ranked WHERE place <= {per_class})"""
