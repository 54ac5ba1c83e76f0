"""Metrics of scored rows: every order line is a scored row, returned or not is its label."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import query, rounded, table
from inkprobe.functions.text import threshold_predict
from inkprobe.operators import evaluation as ev

# Few distinct discounts give many ties; prices give few.
SCORED_SQL = """scored AS (
  SELECT l_linenumber AS run, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CAST(l_discount AS DOUBLE) - 0.05 AS score, CAST(l_extendedprice AS DOUBLE) AS price,
    CASE WHEN CAST(l_discount AS DOUBLE) - 0.05 >= 0.0 THEN 1 ELSE 0 END AS pred FROM lineitem)"""

CELLS_SQL = """cells AS (SELECT run, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM scored GROUP BY run)"""


def rate_sql(name: str) -> str:
    top, bottom = {
        "accuracy": ("tp + tn", "tp + fp + fn + tn"),
        "f1": ("2 * tp", "2 * tp + fp + fn"),
        "recall": ("tp", "tp + fn"),
        "precision": ("tp", "tp + fp"),
    }[name]
    return f"round(coalesce(({top}) / nullif({bottom}, 0), 0), 6) AS {name}"


def auc_sql(source: str, run: str, score: str = "score", label: str = "label") -> str:
    """CTE ``areas``: Mann-Whitney form, from mid ranks."""
    return f"""mid AS (
  SELECT {run}, {label} AS y, rank() OVER (PARTITION BY {run} ORDER BY {score})
    + (count(*) OVER (PARTITION BY {run}, {score}) - 1) / 2.0 AS r FROM {source}),
areas AS (
  SELECT {run}, CASE WHEN p = 0 OR q = 0 THEN 'nan'::DOUBLE ELSE (s - p * (p + 1) / 2.0) / (p * q) END AS roc_auc FROM (
    SELECT {run}, sum(CASE WHEN y = 1 THEN r ELSE 0 END)::DOUBLE AS s, count(*) FILTER (y = 1)::DOUBLE AS p,
      count(*) FILTER (y <> 1)::DOUBLE AS q FROM mid GROUP BY {run}))"""


def scored_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    score = F.col("l_discount").cast("double") - 0.05
    return lines.select(
        F.col("l_linenumber").alias("run"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        score.alias("score"),
        F.col("l_extendedprice").cast("double").alias("price"),
        threshold_predict(score, 0.0).alias("pred"),
    )


@query("confusion_counts", f"WITH {SCORED_SQL}, {CELLS_SQL} SELECT * FROM cells")
def confusion_counts(spark, sf_dir):
    return ev.confusion_counts(scored_rows(spark, sf_dir), by=["run"])


@query("accuracy", f"WITH {SCORED_SQL}, {CELLS_SQL} SELECT run, {rate_sql('accuracy')} FROM cells")
def accuracy(spark, sf_dir):
    return rounded(ev.accuracy(scored_rows(spark, sf_dir), by=["run"]))


@query("precision", f"WITH {SCORED_SQL}, {CELLS_SQL} SELECT run, {rate_sql('precision')} FROM cells")
def precision(spark, sf_dir):
    return rounded(ev.precision(scored_rows(spark, sf_dir), by=["run"]))


@query("recall", f"WITH {SCORED_SQL}, {CELLS_SQL} SELECT run, {rate_sql('recall')} FROM cells")
def recall(spark, sf_dir):
    return rounded(ev.recall(scored_rows(spark, sf_dir), by=["run"]))


@query("f1", f"WITH {SCORED_SQL}, {CELLS_SQL} SELECT run, {rate_sql('f1')} FROM cells")
def f1(spark, sf_dir):
    return rounded(ev.f1(scored_rows(spark, sf_dir), by=["run"]))


@query("roc_auc", f"WITH {SCORED_SQL}, {auc_sql('scored', 'run')} SELECT run, round(roc_auc, 6) AS roc_auc FROM areas")
def roc_auc(spark, sf_dir):
    """Few distinct scores: nearly every pair of rows is a tie."""
    return rounded(ev.roc_auc(scored_rows(spark, sf_dir), "score", by=["run"]))


@query(
    "roc_auc_many_scores",
    f"WITH {SCORED_SQL}, {auc_sql('scored', 'run', 'price')} SELECT run, round(roc_auc, 6) AS roc_auc FROM areas",
)
def roc_auc_many_scores(spark, sf_dir):
    """Many distinct scores, ranked slot by slot as on a cluster."""
    return rounded(ev.roc_auc(scored_rows(spark, sf_dir), "price", by=["run"], window_rows=1000))


@query(
    "evaluate_scores",
    f"""WITH {SCORED_SQL}, {CELLS_SQL}, {auc_sql('scored', 'run')}
SELECT run, round(roc_auc, 6) AS roc_auc, {', '.join(rate_sql(n) for n in ('accuracy', 'f1', 'recall', 'precision'))}
FROM cells JOIN areas USING (run)""",
)
def evaluate_scores(spark, sf_dir):
    """All five metrics of every run at once, at threshold 0."""
    return rounded(ev.evaluate_scores(scored_rows(spark, sf_dir), threshold=0.0, by=["run"]))


@query(
    "evaluate_one_class",
    f"""WITH {SCORED_SQL}, {CELLS_SQL} SELECT 'nan'::DOUBLE AS roc_auc,
  {', '.join(rate_sql(n) for n in ('accuracy', 'f1', 'recall', 'precision'))}
FROM (SELECT 0 AS tp, sum(fp) AS fp, 0 AS fn, sum(tn) AS tn FROM cells)""",
)
def evaluate_one_class(spark, sf_dir):
    """Without positives the area is NaN and the undefined rates are 0."""
    return rounded(ev.evaluate_scores(scored_rows(spark, sf_dir).filter(F.col("label") == 0), threshold=0.0))


@query(
    "classification_report",
    """WITH scored AS (
  SELECT o_orderstatus AS label, CASE WHEN o_totalprice >= 300000 THEN 'F' WHEN o_totalprice >= 150000 THEN 'O' ELSE 'P' END
    AS pred FROM orders),
classes AS (SELECT DISTINCT unnest([label, pred]) AS class FROM scored),
sums AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS hit, count(*) FILTER (label = class) AS support,
  count(*) FILTER (pred = class) AS said FROM scored, classes GROUP BY class),
per_class AS (SELECT class, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r,
  coalesce(2 * hit / nullif(said + support, 0), 0) AS f, support, hit FROM sums)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM per_class
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
  round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM per_class
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM per_class""",
)
def classification_report(spark, sf_dir):
    """Three classes, guessed from the price."""
    price = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("label"),
        F.when(price >= 300_000, "F").when(price >= 150_000, "O").otherwise("P").alias("pred"),
    )
    return rounded(ev.classification_report(orders))
