import math
import random

import pytest
from pyspark.sql import functions as F

from inkprobe.operators import evaluation as ev
from inkprobe.operators import reporting as rp
from inkprobe.plans.harness import direct_score_eval


def frame(spark, scores, labels, run="a"):
    return spark.createDataFrame([(run, float(s), int(y)) for s, y in zip(scores, labels)], "run string, score double, label int")


def pairwise(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_perfect_separation(spark):
    row = direct_score_eval(frame(spark, [5, 3, -2, -4], [1, 1, 0, 0])).first()
    assert (row.roc_auc, row.accuracy, row.f1) == (1.0, 1.0, 1.0)


def test_direct_threshold_is_zero(spark):
    assert direct_score_eval(frame(spark, [0.3, -0.3], [1, 0])).first().accuracy == 1.0


@pytest.mark.parametrize("window_rows", [10**6, 10])
def test_area_equals_pair_counting(spark, window_rows):
    rng = random.Random(3)
    runs = {}
    for run, digits in (("ties", 1), ("few", 2), ("many", 9)):
        runs[run] = ([round(rng.gauss(0, 1), digits) for _ in range(300)], [rng.random() < 0.4 for _ in range(300)])
    # A third of all rows share one score.
    runs["hot"] = ([0.0] * 150 + runs["many"][0][:150], runs["many"][1])
    df = None
    for run, (scores, labels) in runs.items():
        part = frame(spark, scores, labels, run)
        df = part if df is None else df.unionByName(part)
    got = {r.run: r.roc_auc for r in ev.roc_auc(df, "score", by=["run"], window_rows=window_rows).collect()}
    assert got == {run: pytest.approx(pairwise(*v), abs=1e-12) for run, v in runs.items()}


def test_single_class_is_nan_and_undefined_rates_are_zero(spark):
    row = ev.evaluate_scores(frame(spark, [0.1, 0.2], [0, 0])).first()
    assert math.isnan(row.roc_auc)
    assert (row.accuracy, row.f1, row.recall, row.precision) == (1.0, 0.0, 0.0, 0.0)


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "label int, pred int")
    rows = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["0"].recall == 0.5
    assert rows["accuracy"].f1 == pytest.approx(0.6)
    assert rows["macro avg"].f1 == pytest.approx((rows["0"].f1 + rows["1"].f1) / 2)
    assert rows["weighted avg"].f1 == pytest.approx((2 * rows["0"].f1 + 3 * rows["1"].f1) / 5)


RESULTS = "dataset string, model string, strategy string, classifier string, roc_auc double, accuracy double, f1 double"


def test_best_classifier_ties_nan_and_unknown_paradigm(spark):
    nan = float("nan")
    rows = [
        ("mage", "gpt2", "score", "b", 0.8, 0.1, 0.1),
        ("mage", "gpt2", "score", "a", 0.8, 0.2, 0.2),
        ("mage", "gpt2", "score", "c", nan, 0.9, 0.9),
        ("mage", "mystery", "score", "a", 0.9, 0.3, 0.3),
        ("raid", "bert", "pawn", "a", 0.12345, 0.3, 0.3),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    best = rp.best_classifier_per_strategy(df.filter("dataset = 'mage'")).collect()
    assert [(r.paradigm, r.model, r.classifier) for r in best] == [("Autoregressive", "gpt2", "a"), (None, "mystery", "a")]
    ordered = df.withColumn("place", F.when(F.col("classifier") == "b", 1).otherwise(2))
    assert rp.best_classifier(ordered, ["model"], ["place"]).filter("model = 'gpt2'").first().classifier == "b"
    assert rp.best_model(df).first().model == "mystery"
    assert rp.sort_desc_top1(df, "roc_auc").first().model == "mystery"
    table = rp.pivot_best(df)
    assert table.columns == ["model", "strategy", "mage", "raid"]
    assert {r.model: r.raid for r in table.collect()}["bert"] == 0.1234
    assert rp.small_model_table(df).columns == ["model", "strategy", "raid"]
    assert [r.dataset for r in rp.main_tables(df).collect()] == ["mage", "mage", "raid"]


def test_scores_without_a_place_raise_and_infinite_ones_rank(spark):
    rows = [(float("inf"), 1), (float("-inf"), 0), (float("-inf"), 1), (0.5, 0), (0.7, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    areas = [ev.roc_auc(df, "score", window_rows=n).first().roc_auc for n in (5, 2, 10**6)]
    assert areas[0] == areas[1] == areas[2]
    for bad in (None, float("nan")):
        with pytest.raises(ValueError):
            ev.roc_auc(spark.createDataFrame([*rows, (bad, 1)], "score double, label int"), "score")
