"""Cleaning, labels, scalar functions, reshaping, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import clean_sql, pair_rows, quality_rows, query, r6, rounded, table
from inkprobe.catalog.sources import PAIRS_SQL
from inkprobe.functions import text as tx
from inkprobe.operators import reshape


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents WHERE text IS NOT NULL")
def clean_text(spark, sf_dir):
    return reshape.clean_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "clean_html",
    f"SELECT page_id, {clean_sql('html')} AS text FROM pages WHERE html IS NOT NULL",
)
def clean_html(spark, sf_dir):
    """The same cleaning on another column and on raw markup."""
    return reshape.clean_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html").drop("html")


@query(
    "derive_label",
    """SELECT conv_id, turn, CASE WHEN who = 'human' THEN 1 ELSE 0 END AS label FROM (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS who FROM conversations)""",
)
def derive_label(spark, sf_dir):
    """System turns have no author: a null value is not equal to human."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.derive_label(who).alias("label"))


@query("invert_label", "SELECT doc_id, quality, 1 - toxic AS toxic FROM labels")
def invert_label(spark, sf_dir):
    return reshape.invert_label(table(spark, sf_dir, "labels"), "toxic")


@query("label_name", "SELECT doc_id, CASE WHEN quality = 1 THEN 'Humano' ELSE 'IA' END AS class_name FROM labels")
def label_name(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", tx.label_name(F.col("quality")).alias("class_name"))


@query(
    "coerce_numeric",
    """SELECT o_orderkey, round(TRY_CAST(replace(raw, ',', '.') AS DOUBLE), 6) AS number FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
    ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ',') END AS raw FROM orders)""",
)
def coerce_numeric(spark, sf_dir):
    """Prices printed with a decimal comma; finished orders carry text instead."""
    printed = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    raw = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(printed)
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(tx.coerce_numeric(raw)).alias("number"))


_HOLES = """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
    CASE WHEN value > 20 THEN NULL ELSE user_id END AS user_id FROM events"""


def _holes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("value") <= 20, F.col("user_id")).alias("user_id"),
    )


@query("drop_missing_any", f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL AND user_id IS NOT NULL")
def drop_missing_any(spark, sf_dir):
    return reshape.drop_missing(_holes(spark, sf_dir), ["value", "user_id"], "any")


@query("drop_missing_all", f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL OR user_id IS NOT NULL")
def drop_missing_all(spark, sf_dir):
    return reshape.drop_missing(_holes(spark, sf_dir), ["value", "user_id"], "all")


@query("select_features", "SELECT doc_id, toxic, quality FROM labels")
def select_features(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    assert reshape.select_features(labels, ["quality", "absent"]) is None
    return reshape.select_features(labels, ["toxic", "quality"], keep=("doc_id",))


@query("copy_column", "SELECT vec_id, label, label AS real_class FROM embeddings")
def copy_column(spark, sf_dir):
    return reshape.copy_column(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "real_class")


@query(
    "melt_binary_text",
    f"""WITH {PAIRS_SQL} SELECT human_output AS text, 1 AS label FROM pairs
UNION ALL SELECT model_output, 0 FROM pairs""",
)
def melt_binary_text(spark, sf_dir):
    return reshape.melt_binary_text(pair_rows(spark, sf_dir), "human_output", "model_output")


@query(
    "concat_frames",
    """SELECT doc_id AS key, lang, NULL AS role, text FROM documents
UNION ALL SELECT conv_id, NULL, role, text FROM conversations
UNION ALL SELECT item_id, NULL, NULL, text FROM benchmark""",
)
def concat_frames(spark, sf_dir):
    return reshape.concat_frames(
        [
            table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "text"),
            table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "role", "text"),
            table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text"),
        ]
    )


def _surface(spark, sf_dir, what: str):
    size = F.length("text") if what == "chars" else F.size(tx.words(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), size.cast("bigint").alias("size"), F.sqrt(size.cast("double")).alias("root")
    )


@query(
    "assemble_features",
    f"""SELECT doc_id AS text_id, lang, CAST(length(text) AS BIGINT) AS size_chars,
  round(sqrt(length(text)), 6) AS root_chars,
  n AS size_words, round(sqrt(n), 6) AS root_words
FROM (SELECT *, CAST(CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS BIGINT) AS n
  FROM (SELECT *, {clean_sql('lower(text)')} AS flat FROM documents))""",
)
def assemble_features(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "lang")
    features = {what: _surface(spark, sf_dir, what) for what in ("chars", "words")}
    return rounded(reshape.assemble_features(base, features))


@query(
    "align_features",
    "SELECT doc_id AS text_id, quality AS label, CAST(length(text) AS BIGINT) AS size FROM documents JOIN labels USING (doc_id)",
)
def align_features(spark, sf_dir):
    rows = quality_rows(spark, sf_dir).withColumnRenamed("id", "text_id")
    features = rows.select("text_id", F.length("text").cast("bigint").alias("size"))
    return reshape.align_features(features, rows.select("text_id", "label"))


_PROBS = "list_value(embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE)"


@query(
    "threshold_predict",
    """SELECT vec_id, CASE WHEN embedding[1] >= 0.0 THEN 1 ELSE 0 END AS log_odds_pred,
  CASE WHEN embedding[1] >= 0.5 THEN 1 ELSE 0 END AS pred FROM embeddings""",
)
def threshold_predict(spark, sf_dir):
    first = F.element_at("embedding", 1)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", tx.threshold_predict(first, 0.0).alias("log_odds_pred"), tx.threshold_predict(first).alias("pred")
    )


@query("argmax_predict", f"SELECT vec_id, CAST(list_position({_PROBS}, list_max({_PROBS})) - 1 AS INTEGER) AS pred FROM embeddings")
def argmax_predict(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", tx.argmax_predict(F.slice("embedding", 1, 3)).alias("pred")
    )


@query(
    "round4",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN twice - floor(twice) = 0 AND floor(twice) % 2 = 1
    THEN CASE WHEN floor(twice / 2) % 2 = 0 THEN floor(twice / 2) ELSE floor(twice / 2) + 1 END
    ELSE floor(twice / 2 + 0.5) END AS BIGINT) AS ten_thousandths
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount AS DECIMAL(18, 2)) * CAST(l_tax AS DECIMAL(18, 2)) *
    CAST(0.125 AS DECIMAL(6, 3)) * 20000 AS DECIMAL(38, 9)) AS twice FROM lineitem)""",
)
def round4(spark, sf_dir):
    """Discount times tax over eight has halves at the fourth decimal: they go to even."""
    exact = F.col("l_discount").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(18,2)") * F.lit("0.125").cast("decimal(6,3)")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (tx.round4(exact) * 10_000).cast("bigint").alias("ten_thousandths")
    )
