"""What SQL can state about fits: optima of one column, the first split of a booster, isotonic curves, the rows held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.evaluation import auc_sql, rate_sql
from inkprobe.catalog.learning import vector_rows
from inkprobe.catalog.registry import query, quality_rows, rounded, table
from inkprobe.fits.boosting import BoostSpec, fit_boosters
from inkprobe.fits.grouped import fit_runs, row_key
from inkprobe.fits.isotonic import fit_isotonic
from inkprobe.operators.sampling import stratified_kfold
from inkprobe.plans import harness as hs
from inkprobe.session import stage

FOLDS, SEED = 5, 42


def _lengths(spark, sf_dir):
    """``text_id, label, score``: every labelled document by the logarithm of its length."""
    rows = quality_rows(spark, sf_dir).filter("text IS NOT NULL")
    return rows.select(F.col("id").alias("text_id"), "label", F.log1p(F.length("text")).alias("score"))


# Newton's method on one column for each fold's training rows: 25 whole steps from zero.
_FITS = f"""RECURSIVE rows_of AS (
  SELECT doc_id AS text_id, quality AS label, ln(1 + length(text)) AS x FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{SEED}', 'fold', text_id))) AS r, count(*) OVER (PARTITION BY label) AS n FROM rows_of),
folded AS (SELECT text_id, label, x, {' + '.join(f'(r > {f} * n // {FOLDS})::INT' for f in range(1, FOLDS))} AS fold FROM ranked),
train AS (
  SELECT run, label AS y, x, count(*) OVER (PARTITION BY run)::DOUBLE / (2 * count(*) OVER (PARTITION BY run, label)) AS s
  FROM folded, (SELECT unnest(range({FOLDS})) AS run) WHERE run <> fold),
fit(run, i, w, b) AS (
  SELECT unnest(range({FOLDS})), 0, 0::DOUBLE, 0::DOUBLE
  UNION ALL
  SELECT run, i + 1, w - (d * gw - c * gb) / (a * d - c * c), b - (a * gb - c * gw) / (a * d - c * c) FROM (
    SELECT fit.run, i, w, b, w + sum(s * (p - y) * x) AS gw, sum(s * (p - y)) AS gb,
      1 + sum(s * p * (1 - p) * x * x) AS a, sum(s * p * (1 - p) * x) AS c, sum(s * p * (1 - p)) AS d
    FROM fit JOIN train ON train.run = fit.run, LATERAL (SELECT 1 / (1 + exp(-(w * x + b))) AS p) GROUP BY fit.run, i, w, b)
  WHERE i < 25)"""


@query("fold_weights", f"WITH {_FITS} SELECT CAST(run AS INTEGER) AS run, round(w, 6) AS weight, round(b, 6) AS intercept FROM fit WHERE i = 25")
def fold_weights(spark, sf_dir):
    """The regressions of all folds, fitted together."""
    rows = _lengths(spark, sf_dir).select("text_id", row_key().alias("key"), "label", F.array("score").alias("x"))
    folded = stratified_kfold(stage(rows, "vectors"), "label", FOLDS, SEED)
    train = stage(folded.withColumn("runs", F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: f != F.col("fold"))), "folds")
    models = fit_runs("logreg", train.select("key", "label", "runs", "x"))
    found = [(run, float(m.weights[0]), float(m.weights[1])) for run, m in models.items()]
    return rounded(spark.createDataFrame(found, "run int, weight double, intercept double"))


_CROSSED = f"""WITH {_FITS},
scored AS (SELECT fold, label, 1 / (1 + exp(-(w * x + b))) AS score FROM folded JOIN fit ON run = fold AND i = 25),
cells AS (SELECT fold, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label <> 1 AND score >= 0.5) AS fp,
  count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label <> 1 AND score < 0.5) AS tn FROM scored GROUP BY fold),
{auc_sql('scored', 'fold')},
rates AS (SELECT roc_auc, {', '.join(rate_sql(n).replace('round(', '(').replace(', 6)', ')') for n in ('accuracy', 'f1', 'recall', 'precision'))} FROM cells JOIN areas USING (fold))
SELECT 'logreg' AS classifier, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('roc_auc', 'accuracy', 'f1', 'recall', 'precision'))} FROM rates"""


@query("cross_validated_score", _CROSSED)
def cross_validated_score(spark, sf_dir):
    """Five folds of the regression on a single column."""
    return rounded(hs.cross_validated_eval(_lengths(spark, sf_dir), ["score"], ["logreg"], FOLDS, SEED))


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c).cast("double") * 100)
    return lines.select(
        F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").cast("double").alias("quantity"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax"),
        F.xxhash64("l_orderkey", "l_linenumber").alias("key"),
    )


@query(
    "boosted_stump",
    """WITH rows_of AS (
  SELECT (l_returnflag = 'R')::INT AS y, l_quantity::DOUBLE AS quantity, round(l_discount::DOUBLE * 100) AS discount, round(l_tax::DOUBLE * 100) AS tax FROM lineitem),
cells AS (
  SELECT feature, value, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM (
    SELECT 0 AS feature, quantity AS value, y FROM rows_of UNION ALL SELECT 1, discount, y FROM rows_of UNION ALL SELECT 2, tax, y FROM rows_of) GROUP BY ALL),
cuts AS (SELECT feature, value AS cut, sum(g) OVER below AS gl, sum(h) OVER below AS hl, sum(g) OVER (PARTITION BY feature) AS g, sum(h) OVER (PARTITION BY feature) AS h
  FROM cells WINDOW below AS (PARTITION BY feature ORDER BY value)),
gains AS (SELECT *, (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2 AS gain FROM cuts WHERE hl >= 1 AND h - hl >= 1)
SELECT CAST(feature AS INTEGER) AS feature, cut, round(-0.3 * gl / (hl + 1), 6) AS left_value, round(-0.3 * (g - gl) / (h - hl + 1), 6) AS right_value
FROM gains ORDER BY gain DESC, feature, cut LIMIT 1""",
)
def boosted_stump(spark, sf_dir):
    """The first split of a booster over all lines: second-order gain with L2."""
    rows = _lines(spark, sf_dir).select("key", "label", F.array(F.lit(0)).alias("runs"), F.array("quantity", "discount", "tax").alias("x"))
    model = fit_boosters(stage(rows, "lines"), BoostSpec(rounds=1, rate=0.3, depth=1))[0]
    tree = model.trees[0]
    left = int(tree.left[0])
    found = (int(tree.feature[0]), float(model.cuts[tree.feature[0]][tree.cut[0]]), float(tree.value[left]), float(tree.value[left + 1]))
    return rounded(spark.createDataFrame([found], "feature int, cut double, left_value double, right_value double"))


@query(
    "isotonic_curve",
    """WITH points AS (
  SELECT l_linenumber AS run, round(l_discount::DOUBLE * 100) AS score, sum((l_returnflag = 'R')::INT)::DOUBLE AS total, count(*) AS weight FROM lineitem GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score) AS k, sum(total) OVER upto AS totals, sum(weight) OVER upto AS weights
  FROM points WINDOW upto AS (PARTITION BY run ORDER BY score)),
means AS (SELECT a.run, a.k AS i, b.k AS j, (b.totals - a.totals + a.total) / (b.weights - a.weights + a.weight) AS mean FROM placed a JOIN placed b ON a.run = b.run AND b.k >= a.k),
lows AS (SELECT p.run, p.k, i, min(mean) AS low FROM placed p JOIN means m ON m.run = p.run AND m.i <= p.k AND m.j >= p.k GROUP BY ALL),
fitted AS (SELECT run, k, max(low) AS value FROM lows GROUP BY ALL)
SELECT CAST(run AS INTEGER) AS run, score, round(value, 6) AS value FROM fitted JOIN placed USING (run, k)""",
)
def isotonic_curve(spark, sf_dir):
    """Ascending curves of all line numbers at once, read at every score."""
    rows = _lines(spark, sf_dir).select(F.col("line").cast("int").alias("run"), F.col("discount").alias("score"), "label")
    curves = fit_isotonic(rows)
    scores = [(r.run, r.score) for r in rows.select("run", "score").distinct().collect()]
    return rounded(spark.createDataFrame([(run, s, float(curves[run](s))) for run, s in scores], "run int, score double, value double"))


def _held_out(name: str):
    def run(spark, sf_dir):
        scores = hs.holdout_scores(vector_rows(spark, sf_dir), ["embedding"], [name])
        return scores.select("classifier", "text_id", "label", F.col("score").between(0.0, 1.0).alias("in_range"))

    run.__doc__ = f"Every held-out vector, scored by {name}."
    return run


for _name in ("logreg", "random_forest", "gbt", "gbt_calibrated", "mlp"):
    query(
        f"holdout_rows_{_name}",
        f"""WITH rows_of AS (SELECT vec_id AS text_id, (label >= 5)::INTEGER AS label FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{SEED}', 'split', text_id))) AS r, count(*) OVER (PARTITION BY label) AS n FROM rows_of)
SELECT '{_name}' AS classifier, text_id, label, TRUE AS in_range FROM ranked WHERE r <= floor(0.2 * n + 0.5)""",
    )(_held_out(_name))
