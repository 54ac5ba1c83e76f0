import math

import pytest

from inkprobe.operators import averages

SCHEMA = "text_id int, pos int, logits array<double>, y int, w double"


def softmax(z):
    e = [math.exp(x) for x in z]
    return [x / sum(e) for x in e]


def test_top_token(spark):
    row = averages.pawn_metrics(spark.createDataFrame([(0, 0, [2.0, 1.0, 0.0, 0.0], 0, 1.0)], SCHEMA)).first()
    assert row.Mlog_prob == row.Mmax_log_prob
    assert row.Mrank == 0.25
    assert row.Mtop_p == pytest.approx(softmax([2, 1, 0, 0])[0])
    assert row.Mentropy > 0


def test_ties_share_the_best_rank_and_the_whole_mass(spark):
    row = averages.pawn_metrics(spark.createDataFrame([(0, 0, [1.0, 1.0, 1.0, 0.0], 2, 1.0)], SCHEMA)).first()
    assert row.Mrank == 0.25
    assert row.Mtop_p == pytest.approx(3 * softmax([1, 1, 1, 0])[0])


def test_weights_choose_positions(spark):
    rows = [(0, 0, [5.0, 0.0], 0, 1.0), (0, 1, [0.0, 5.0], 1, 1.0), (1, 0, [5.0, 0.0], 0, 1.0), (1, 1, [0.0, 5.0], 1, 0.0)]
    both, first = averages.pawn_metrics(spark.createDataFrame(rows, SCHEMA)).orderBy("text_id").collect()
    for metric in averages.METRICS:
        assert both[metric] == pytest.approx(first[metric])


def test_sequence_log_likelihood_is_the_mean(spark):
    rows = [(0, 0, [5.0, 0.0], 0, 1.0), (0, 1, [0.0, 5.0], 1, 1.0)]
    expected = math.log(softmax([5, 0])[0])
    assert averages.sequence_log_likelihood(spark.createDataFrame(rows, SCHEMA)).first().score == pytest.approx(expected)


def test_each_text_is_scored_alone(spark):
    confident = [(0, p, [10.0, 0.0, 0.0, 0.0, 0.0], 0, 1.0) for p in range(3)]
    uniform = [(1, p, [0.0] * 5, 0, 1.0) for p in range(3)]
    score = lambda rows: {r.text_id: r.score for r in averages.sequence_log_likelihood(spark.createDataFrame(rows, SCHEMA)).collect()}
    together = score(confident + uniform)
    assert together[0] > together[1]
    assert together == {**score(confident), **score(uniform)}


def test_no_weight_gives_zero_not_null(spark):
    rows = [(0, 0, [1.0, 0.0], 0, 0.0)]
    row = averages.pawn_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert [row[m] for m in averages.METRICS] == [0.0] * 5


def test_mean_of_means(spark):
    draws = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0)], "text_id int, draw int, m double")
    assert averages.mc_average(draws, ["m"]).first().m == 3.0
