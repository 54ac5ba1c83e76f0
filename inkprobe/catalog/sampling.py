"""Sampling, shuffling, splitting, ordering, class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import (
    QUALITY_SQL, TURNS_SQL, quality_rows, query, rounded, sample_sql, table, turn_rows,
)
from inkprobe.operators import classes, reporting, sampling
from inkprobe.sources import corpora


@query(
    "random_sample",
    "SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws('|', '7', 'sample', doc_id)) LIMIT 300",
)
def random_sample(spark, sf_dir):
    return sampling.random_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 300, 7, "doc_id")


@query(
    "shuffle",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'shuffle', o_orderkey))) - 1 AS text_id
FROM orders""",
)
def shuffle(spark, sf_dir):
    return sampling.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("balanced_sample", f"WITH {QUALITY_SQL}, {sample_sql('quality', 101)} SELECT * FROM sample")
def balanced_sample(spark, sf_dir):
    """An odd total gives one row less: 50 of each class."""
    rows = quality_rows(spark, sf_dir)
    return corpora.from_plain(rows, F.col("id"), n_total=101)


@query("balanced_sample_source", f"WITH {TURNS_SQL}, {sample_sql('turns', 400, 5)} SELECT * FROM sample")
def balanced_sample_source(spark, sf_dir):
    return corpora.from_source(turn_rows(spark, sf_dir), F.col("id"), n_total=400, seed=5)


@query(
    "balanced_sample_missing_label",
    """WITH marked AS (SELECT conv_id || '-' || turn AS row_key, role = 'user' AS human FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY human
  ORDER BY md5(concat_ws('|', '3', 'sample', row_key))) AS place FROM marked)
SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '3', 'shuffle', row_key))) - 1 AS text_id, row_key,
  CASE WHEN human THEN 1 END AS label FROM ranked WHERE place <= 100""",
)
def balanced_sample_missing_label(spark, sf_dir):
    """A missing label is the negative class."""
    rows = table(spark, sf_dir, "conversations").select(
        F.expr("concat_ws('-', conv_id, turn)").alias("row_key"), F.when(F.col("role") == "user", 1).alias("label")
    )
    return sampling.balanced_sample(rows, "label", 200, 3).select("text_id", "row_key", "label")


_RANKED = """(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat_ws('|', '42', '{purpose}', {id}))) AS place,
  count(*) OVER (PARTITION BY {label}) AS n FROM {table})"""


@query(
    "stratified_split",
    f"""SELECT doc_id, quality, place <= floor(0.2 * n + 0.5) AS is_test
FROM {_RANKED.format(label='quality', purpose='split', id='doc_id', table='labels')}""",
)
def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.stratified_split(labels, "quality", 0.2, 42, "doc_id")


@query(
    "stratified_kfold",
    f"""SELECT o_orderkey, o_orderstatus, CAST((place * 5 - 1) // n AS INTEGER) AS fold
FROM {_RANKED.format(label='o_orderstatus', purpose='fold', id='o_orderkey', table='orders')}""",
)
def stratified_kfold(spark, sf_dir):
    """Folds work for any number of classes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_kfold(orders, "o_orderstatus", 5, 42, "o_orderkey")


@query(
    "sort_desc_top1",
    """SELECT event_id, event_type, round(value, 6) AS value FROM events
WHERE value < 100 ORDER BY value DESC, event_id LIMIT 1""",
)
def sort_desc_top1(spark, sf_dir):
    """The largest values are made NaN: a NaN never wins."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    broken = events.withColumn("value", F.when(F.col("value") >= 100, F.lit(float("nan"))).otherwise(F.col("value")))
    return rounded(reporting.sort_desc_top1(broken, "value", "event_id"))


@query("class_counts", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_counts(spark, sf_dir):
    return classes.class_counts(table(spark, sf_dir, "labels"), "toxic")


@query(
    "class_share",
    """SELECT CASE WHEN quality = 1 THEN 'Humano' ELSE 'IA' END AS class_name,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality""",
)
def class_share(spark, sf_dir):
    return rounded(classes.class_share(table(spark, sf_dir, "labels"), "quality"))


@query(
    "balanced_weights",
    """SELECT doc_id, quality, round((count(*) OVER ()) / (2.0 * count(*) OVER (PARTITION BY quality)), 6) AS weight
FROM labels""",
)
def balanced_weights(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return rounded(classes.balanced_weights(labels, "quality"))


@query(
    "inverse_freq_weights",
    """SELECT toxic, round((1.0 / n) / sum(1.0 / n) OVER (), 6) AS weight
FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)""",
)
def inverse_freq_weights(spark, sf_dir):
    return rounded(classes.inverse_freq_weights(table(spark, sf_dir, "labels"), "toxic"))
