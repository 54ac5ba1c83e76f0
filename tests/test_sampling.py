import pytest
from pyspark.sql import functions as F

from inkprobe.operators import classes, sampling


def labelled(spark, ones, zeros, extra_null=0):
    rows = [(i, 1, f"text-{i}") for i in range(ones)]
    rows += [(ones + i, 0, f"text-{ones + i}") for i in range(zeros)]
    rows += [(ones + zeros + i, None, "none") for i in range(extra_null)]
    return spark.createDataFrame(rows, "row_key bigint, label int, text string")


def test_balanced_sample_is_exact_and_without_repeats(spark):
    rows = sampling.balanced_sample(labelled(spark, 700, 300), "label", 400, 0).collect()
    assert sum(r.label for r in rows) == 200 and len(rows) == 400
    assert len({r.text for r in rows}) == 400
    assert sorted(r.text_id for r in rows) == list(range(400))


def test_balanced_sample_raises_when_a_class_is_short(spark):
    with pytest.raises(ValueError, match="10 positive and 500 negative"):
        sampling.balanced_sample(labelled(spark, 10, 500), "label", 100, 0)


def test_odd_total_loses_one_row_and_null_label_is_negative(spark):
    rows = sampling.balanced_sample(labelled(spark, 20, 0, extra_null=10), "label", 21, 3).collect()
    assert len(rows) == 20 and sum(r.label is None for r in rows) == 10


def test_sample_depends_on_the_seed_only(spark):
    draw = lambda seed: [r.text for r in sampling.balanced_sample(labelled(spark, 60, 60), "label", 40, seed).orderBy("text_id").collect()]
    assert draw(1) == draw(1) != draw(2)
    moved = labelled(spark, 60, 60).repartition(7)
    assert [r.text for r in sampling.balanced_sample(moved, "label", 40, 1).orderBy("text_id").collect()] == draw(1)


def test_repeated_ids_are_refused(spark):
    rows = spark.createDataFrame([(7, 1)] * 5 + [(8, 0)] * 5, "row_key bigint, label int")
    with pytest.raises(ValueError, match="not unique"):
        sampling.balanced_sample(rows, "label", 4, 0)


def test_random_sample_and_shuffle(spark):
    ids = spark.range(1000).withColumnRenamed("id", "text_id")
    assert sampling.random_sample(ids, 137, 5).count() == 137
    assert sampling.random_sample(ids, 5000, 5).count() == 1000
    assert sampling.random_sample(ids, 0, 5).count() == 0
    order = [r.text_id for r in sampling.shuffle(ids.withColumnRenamed("text_id", "k"), 5, "k").orderBy("text_id").select(F.col("k").alias("text_id")).collect()]
    assert sorted(order) == list(range(1000)) and order != list(range(1000))


@pytest.mark.parametrize("ones, zeros, k", [(53, 31, 5), (7, 4, 3), (3, 2, 5)])
def test_folds_are_stratified_and_even(spark, ones, zeros, k):
    rows = sampling.stratified_kfold(labelled(spark, ones, zeros), "label", k, 42, "row_key").collect()
    for label, size in ((1, ones), (0, zeros)):
        sizes = [sum(r.fold == f and r.label == label for r in rows) for f in range(k)]
        assert sum(sizes) == size and max(sizes) - min(sizes) <= 1


def test_split_keeps_class_shares(spark):
    rows = sampling.stratified_split(labelled(spark, 53, 31), "label", 0.2, 42, "row_key").collect()
    assert sum(r.is_test and r.label == 1 for r in rows) == 11
    assert sum(r.is_test and r.label == 0 for r in rows) == 6


def test_class_weights(spark):
    df = labelled(spark, 6, 2)
    weights = {r.label: r.weight for r in classes.balanced_weights(df).select("label", "weight").distinct().collect()}
    assert weights == {1: pytest.approx(8 / 12), 0: pytest.approx(2.0)}
    inverse = {r.label: r.weight for r in classes.inverse_freq_weights(df).collect()}
    assert inverse == {1: pytest.approx(0.25), 0: pytest.approx(0.75)}
    alone = {r.label: r.weight for r in classes.inverse_freq_weights(labelled(spark, 6, 0)).collect()}
    assert alone == {0: 1.0, 1: 1.0}
