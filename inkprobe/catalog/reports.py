"""Report tables over result rows computed from the corpora, and performance rows.

The results are direct evaluations of plain text statistics on three corpora; the
performance rows are the events table read as run times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.evaluation import auc_sql, rate_sql
from inkprobe.catalog.registry import (
    QUALITY_SQL, TOXICITY_SQL, TURNS_SQL, quality_rows, query, rounded, scratch, table, toxicity_rows, turn_rows,
)
from inkprobe.operators import reporting as rp
from inkprobe.operators.evaluation import evaluate_scores
from inkprobe.operators.reshape import concat_frames
from inkprobe.operators.sampling import number_in_order
from inkprobe.session import stage
from inkprobe.sources import corpora, results as rs

DATASETS = ["turns", "quality", "toxicity"]
PARADIGMS = {"chars": "Length", "tokens": "Counts"}
KEYS = ["dataset", "model", "strategy", "classifier"]

# Statistics of a text (model), how far from a reference value counts (strategy), and the
# direction of the decision (classifier); "twice" ranks like "up" and so ties with it.
LONG_SQL = f"""{QUALITY_SQL}, {TOXICITY_SQL}, {TURNS_SQL},
corpus AS (SELECT 'quality' AS dataset, text, label FROM quality UNION ALL SELECT 'toxicity', text, label FROM toxicity
  UNION ALL SELECT 'turns', text, label FROM turns),
stats AS (SELECT dataset, label, unnest(['chars', 'tokens', 'zlast']) AS model, unnest([length(text)::DOUBLE,
  len(string_split(text, ' '))::DOUBLE, unicode(right(text, 1))::DOUBLE]) AS v FROM corpus),
ways AS (SELECT dataset, label, model, unnest(['above', 'near']) AS strategy,
  unnest([v - 150, -abs(v - 150)]) AS v FROM stats),
scored AS (SELECT dataset, label, model, strategy, unnest(['down', 'twice', 'up']) AS classifier,
  unnest([-v, 2 * v, v]) AS score FROM ways),
named AS (SELECT concat_ws('|', dataset, model, strategy, classifier) AS run, * FROM scored)"""

RESULTS_SQL = f"""{LONG_SQL}, {auc_sql('named', 'run')},
cells AS (SELECT run, dataset, model, strategy, classifier, count(*) FILTER (label = 1 AND score >= 0) AS tp,
  count(*) FILTER (label = 0 AND score >= 0) AS fp, count(*) FILTER (label = 1 AND score < 0) AS fn,
  count(*) FILTER (label = 0 AND score < 0) AS tn FROM named GROUP BY ALL),
results AS (SELECT dataset, model, strategy, classifier, roc_auc,
  {', '.join(rate_sql(n) for n in ('accuracy', 'f1', 'recall', 'precision'))} FROM cells JOIN areas USING (run))"""


def result_rows(spark, sf_dir):
    """``dataset, model, strategy, classifier`` and the five metrics, from all texts."""
    corpus = concat_frames(
        [
            corpora.from_plain(quality_rows(spark, sf_dir), F.col("id")).withColumn("dataset", F.lit("quality")).drop("row_key"),
            corpora.from_inverted(toxicity_rows(spark, sf_dir), F.col("id")).withColumn("dataset", F.lit("toxicity")).drop("row_key"),
            corpora.from_source(turn_rows(spark, sf_dir), F.col("id")).withColumn("dataset", F.lit("turns")).drop("row_key"),
        ]
    )
    last = F.ascii(F.right("text", F.lit(1)))
    words = F.when(F.col("text") == "", 1).otherwise(F.size(F.split("text", " ")))
    each = lambda name, of: F.inline(F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias("v")) for k, v in of.items()]))
    stats = corpus.select("dataset", "label", each("model", {"chars": F.length("text"), "tokens": words, "zlast": last}))
    v = F.col("v")
    ways = stats.select("dataset", "label", "model", each("strategy", {"above": v - 150, "near": -F.abs(v - 150)}))
    scored = ways.select("dataset", "label", "model", "strategy", each("classifier", {"down": -v, "twice": v * 2, "up": v}))
    return evaluate_scores(scored, "v", threshold=0.0, by=KEYS)


@query("direct_score_eval", f"WITH {RESULTS_SQL} SELECT * REPLACE (round(roc_auc, 6) AS roc_auc) FROM results")
def direct_score_eval(spark, sf_dir):
    """Threshold 0 on signed scores, no fit, every row used: all runs in one job."""
    return rounded(result_rows(spark, sf_dir))


# The best classifier per group. Equal areas differ in the last bit between engines'
# sums, so the SQL compares them to 12 decimals and takes the first name.
BEST_SQL = f"""{RESULTS_SQL}, best AS (
  SELECT *, CASE model WHEN 'chars' THEN 'Length' WHEN 'tokens' THEN 'Counts' END AS paradigm FROM results
  WHERE NOT isnan(roc_auc)
  QUALIFY row_number() OVER (PARTITION BY dataset, model, strategy ORDER BY round(roc_auc, 12) DESC, classifier) = 1)"""

_BEST_COLUMNS = "paradigm, model, strategy, classifier, round(roc_auc, 6) AS roc_auc, accuracy, f1"


@query("main_tables", f"WITH {BEST_SQL} SELECT dataset, {_BEST_COLUMNS} FROM best WHERE dataset IN ('turns', 'quality')")
def main_tables(spark, sf_dir):
    """Best classifier per dataset, model and strategy; an absent dataset is skipped."""
    return rounded(rp.main_tables(result_rows(spark, sf_dir), ["turns", "quality", "absent"], paradigms=PARADIGMS))


@query(
    "best_classifier_per_strategy",
    f"""WITH {RESULTS_SQL}, best AS (
  SELECT *, CASE model WHEN 'chars' THEN 'Length' WHEN 'tokens' THEN 'Counts' END AS paradigm FROM results
  WHERE dataset = 'turns'
  QUALIFY row_number() OVER (PARTITION BY model, strategy ORDER BY round(roc_auc, 12) DESC, classifier) = 1)
SELECT row_number() OVER (ORDER BY paradigm NULLS LAST, model, strategy) AS place, {_BEST_COLUMNS} FROM best""",
)
def best_classifier_per_strategy(spark, sf_dir):
    """With the place in the sorted table: an unknown paradigm comes last."""
    turns = result_rows(spark, sf_dir).filter(F.col("dataset") == "turns")
    return rounded(number_in_order(rp.best_classifier_per_strategy(turns, paradigms=PARADIGMS), "place"))


@query(
    "sort_results",
    f"""WITH {RESULTS_SQL} SELECT row_number() OVER (ORDER BY paradigm NULLS LAST, dataset, model, strategy, classifier) AS place,
  paradigm, dataset, model, strategy, classifier FROM (
  SELECT *, CASE model WHEN 'chars' THEN 'Length' WHEN 'tokens' THEN 'Counts' END AS paradigm FROM results)""",
)
def sort_results(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("paradigm", rp.paradigm_of(F.col("model"), PARADIGMS))
    return number_in_order(rp.sort_results(rows, ["paradigm", *KEYS]).select("paradigm", *KEYS), "place")


@query("best_model", f"WITH {RESULTS_SQL} SELECT model, round(roc_auc, 6) AS roc_auc FROM results ORDER BY round(roc_auc, 12) DESC, model LIMIT 1")
def best_model(spark, sf_dir):
    return rounded(rp.best_model(result_rows(spark, sf_dir)))


def _pivot_sql(where: str, datasets=DATASETS) -> str:
    # Half to even at the fourth decimal; a tie at the fifth would need an area that is a
    # short decimal, so both roundings agree.
    cells = ", ".join(f"round(max(roc_auc) FILTER (dataset = '{d}'), 4) AS {d}" for d in datasets)
    return f"WITH {RESULTS_SQL} SELECT model, strategy, {cells} FROM results WHERE {where} GROUP BY model, strategy"


@query("pivot_best", _pivot_sql("model IN ('chars', 'zlast')"))
def pivot_best(spark, sf_dir):
    """Two models by all datasets; a dataset nobody ran has no column."""
    return rp.pivot_best(result_rows(spark, sf_dir), ["chars", "zlast"], ["turns", "absent", "quality", "toxicity"])


@query("family_table", _pivot_sql("dataset IN ('turns', 'toxicity')", ["turns", "toxicity"]))
def family_table(spark, sf_dir):
    family = result_rows(spark, sf_dir).filter(F.col("dataset").isin("turns", "toxicity"))
    return rp.family_table(family, DATASETS)


@query("small_model_table", _pivot_sql("model IN ('tokens')"))
def small_model_table(spark, sf_dir):
    return rp.small_model_table(result_rows(spark, sf_dir), ["tokens"], DATASETS)


@query("large_model_table", _pivot_sql("model IN ('chars', 'zlast')"))
def large_model_table(spark, sf_dir):
    return rp.large_model_table(result_rows(spark, sf_dir), ["chars", "zlast", "absent"], DATASETS)


@query("filter_models", f"WITH {RESULTS_SQL} SELECT dataset, model, strategy, classifier FROM results WHERE model IN ('tokens', 'zlast')")
def filter_models(spark, sf_dir):
    return rp.filter_models(result_rows(spark, sf_dir), ["tokens", "zlast"]).select(*KEYS)


@query(
    "paradigm_of",
    f"""WITH {RESULTS_SQL} SELECT dataset, model, strategy, classifier,
  CASE model WHEN 'chars' THEN 'Length' WHEN 'tokens' THEN 'Counts' END AS paradigm FROM results""",
)
def paradigm_of(spark, sf_dir):
    return result_rows(spark, sf_dir).select(*KEYS, rp.paradigm_of(F.col("model"), PARADIGMS).alias("paradigm"))


@query(
    "lookup_paradigm",
    """SELECT l_orderkey, l_linenumber, l_partkey AS model, p_type AS paradigm
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
)
def lookup_paradigm(spark, sf_dir):
    """A registry that lacks some names leaves null."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_size") > 10)
    registry = parts.select(F.col("p_partkey").alias("model"), F.col("p_type").alias("paradigm"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("model"))
    return rp.lookup_paradigm(lines, registry)


_WIDE = ", ".join(
    f"round(max({m}) FILTER (classifier = '{c}'), 6) AS {p}_{m}"
    for c, p in (("up", "u"), ("down", "d"))
    for m in ("roc_auc", "accuracy", "f1", "precision", "recall")
)


@query("comparison_by_score", f"WITH {RESULTS_SQL} SELECT score_col, {_WIDE} FROM (SELECT *, dataset || ' ' || model || ' ' || strategy AS score_col FROM results) GROUP BY score_col")
def comparison_by_score(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("score_col", F.concat_ws(" ", "dataset", "model", "strategy"))
    return rounded(rp.comparison_by_score(rows, "score_col", {"up": "u", "down": "d"}, "u_roc_auc"))


# ---- files


@query("read_results", f"WITH {RESULTS_SQL} SELECT * REPLACE (round(roc_auc, 6) AS roc_auc) FROM results")
def read_results(spark, sf_dir):
    """Written as CSV with ``write_results`` and read back with the declared schema."""
    path = rs.write_results(result_rows(spark, sf_dir), None, scratch(spark, "results"))
    return rounded(rs.read_results(spark, path))


@query("read_results_many", f"WITH {RESULTS_SQL} SELECT * REPLACE (round(roc_auc, 6) AS roc_auc) FROM results WHERE dataset <> 'toxicity'")
def read_results_many(spark, sf_dir):
    """One file per dataset; those that do not exist are passed over."""
    folder = scratch(spark, "results")
    rows = stage(result_rows(spark, sf_dir), "results")
    for name in ("turns", "quality"):
        rs.write_results(rows.filter(F.col("dataset") == name), None, f"{folder}/{name}")
    assert rs.read_results_many(spark, [f"{folder}/absent.csv"]) is None
    return rounded(rs.read_results_many(spark, [f"{folder}/{n}.csv" for n in ("turns", "absent", "quality")]))


PERFORMANCE_SQL = """performance AS (
  SELECT event_type AS dataset, 'user' || user_id AS model, CASE WHEN value >= 10 THEN 'slow' ELSE 'fast' END AS strategy,
    value AS time_seconds, NULL::DOUBLE AS vram_peak_gb, NULL::DOUBLE AS cpu_ram_delta_gb, event_type = 'view' AS cached,
    CASE WHEN value >= 10 THEN 'long' ELSE 'short' END AS experiment FROM events)"""
_PERFORMANCE = "dataset, model, strategy, round(time_seconds, 6) AS time_seconds, vram_peak_gb, cpu_ram_delta_gb, cached"


def performance_rows(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("model"),
        F.when(value >= 10, "slow").otherwise("fast").alias("strategy"),
        value.cast("double").alias("time_seconds"),
        F.lit(None).cast("double").alias("vram_peak_gb"),
        F.lit(None).cast("double").alias("cpu_ram_delta_gb"),
        (F.col("event_type") == "view").alias("cached"),
    )


def _performance_files(spark, sf_dir) -> str:
    folder = scratch(spark, "performance")
    rows = performance_rows(spark, sf_dir)
    empty = rows.limit(0)
    for name, part in (("long", F.col("time_seconds") >= 10), ("short", F.col("time_seconds") < 10)):
        rs.write_results(empty, rows.filter(part), f"{folder}/{name}")
    return folder


@query("read_with_provenance", f"WITH {PERFORMANCE_SQL} SELECT {_PERFORMANCE}, experiment FROM performance WHERE time_seconds IS NOT NULL")
def read_with_provenance(spark, sf_dir):
    return rounded(rs.read_with_provenance(spark, _performance_files(spark, sf_dir)))


@query("performance_table", f"WITH {PERFORMANCE_SQL} SELECT {_PERFORMANCE}, experiment FROM performance WHERE NOT cached AND time_seconds IS NOT NULL")
def performance_table(spark, sf_dir):
    return rounded(rp.performance_table(rs.read_with_provenance(spark, _performance_files(spark, sf_dir))))


@query("unified_performance", f"WITH {PERFORMANCE_SQL} SELECT experiment || '_performance.csv' AS source_file, {_PERFORMANCE} FROM performance WHERE time_seconds IS NOT NULL")
def unified_performance(spark, sf_dir):
    return rounded(rs.unified_performance(spark, _performance_files(spark, sf_dir)))


@query("filter_uncached", f"WITH {PERFORMANCE_SQL} SELECT {_PERFORMANCE} FROM performance WHERE NOT cached")
def filter_uncached(spark, sf_dir):
    return rounded(rp.filter_uncached(performance_rows(spark, sf_dir)))


@query(
    "read_csv_lenient",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 7 <> 1 THEN CAST(o_custkey AS VARCHAR) END AS price
FROM orders WHERE o_orderkey % 5 <> 0""",
)
def read_csv_lenient(spark, sf_dir):
    """Every fifth line has a field too many and goes, every seventh is short and is filled; words among numbers stay."""
    path = scratch(spark, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.when(F.col("o_orderkey") % 7 != 1, F.col("o_custkey").cast("string")))
    surplus = F.when(F.col("o_orderkey") % 5 == 0, F.lit("surplus,more"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, surplus)
    table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 1 OR o_orderkey % 5 <> 0 OR o_orderstatus = 'P'").select(line.alias("line")).write.text(path)
    rows = rs.read_csv_lenient(spark, path, ["o_orderkey", "price"], header=False)
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "price")
