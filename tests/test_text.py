import pytest
from pyspark.sql import functions as F

from inkprobe.functions import text as tx
from inkprobe.operators import reshape


def test_clean_text_covers_python_whitespace(spark):
    every = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert len(every) == 29
    rows = [(1, f"a{every}b"), (2, f"{every}x{every}"), (3, " \t\n"), (4, None), (5, "keep  me")]
    out = {r.i: r.text for r in reshape.clean_text(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert out == {1: "a b", 2: "x", 3: "", 5: "keep me"}


def test_words_of_blank_text_are_none(spark):
    rows = spark.createDataFrame([(1, "A b  C"), (2, "  "), (3, "")], "i int, text string")
    assert {r.i: r.w for r in rows.select("i", tx.words(F.col("text")).alias("w")).collect()} == {1: ["a", "b", "c"], 2: [], 3: []}


def test_melt_gives_long_rows(spark):
    wide = spark.createDataFrame(
        [("h1", "m1", "x"), ("h2", None, "x")], "human_output string, model_output string, unused_column string"
    )
    long = reshape.melt_binary_text(wide, "human_output", "model_output")
    assert long.columns == ["text", "label"]
    assert sorted((r.label, str(r.text)) for r in long.collect()) == [(0, "None"), (0, "m1"), (1, "h1"), (1, "h2")]


def test_invert_label_leaves_the_input(spark):
    df = spark.createDataFrame([(0,), (1,), (0,), (1,)], "label int")
    assert sorted(r.label for r in reshape.invert_label(df).collect()) == [0, 0, 1, 1]
    flipped = {(r.label, r.flip) for r in df.withColumn("flip", tx.invert_label(F.col("label"))).collect()}
    assert flipped == {(0, 1), (1, 0)}


def test_labels_and_numbers(spark):
    df = spark.createDataFrame([("human", "1,5"), ("gpt", "x"), (None, None)], "m string, n string")
    got = df.select(tx.derive_label(F.col("m")).alias("l"), tx.coerce_numeric(F.col("n")).alias("n")).collect()
    assert [(r.l, r.n) for r in got] == [(1, 1.5), (0, None), (0, None)]
    halves = spark.createDataFrame([(0.00125,), (0.00135,), (0.12345,)], "x double").select(tx.round4(F.col("x")).alias("r"))
    assert [r.r for r in halves.collect()] == [0.0012, 0.0014, 0.1234]


def test_parse_vector(spark):
    rows = spark.createDataFrame([("[0.5 -1.25]",), ("[ 0.5,\n -1.25 ]",), ("[0.5  -1.25]",)], "v string")
    for row in rows.select(tx.parse_vector(F.col("v")).alias("v")).collect():
        assert row.v == [0.5, -1.25]
    for bad in ("0.5 1", "[a b]"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "v string").select(tx.parse_vector(F.col("v"))).collect()


def test_select_features_and_alignment(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 1, 3.0)], "text_id bigint, label int, a double")
    assert reshape.select_features(df, ["a", "b"]) is None
    assert reshape.select_features(df, ["a"]).columns == ["text_id", "label", "a"]
    labels = df.select("text_id", "label")
    assert reshape.align_features(df.select("text_id", "a"), labels).count() == 2
    with pytest.raises(ValueError, match="one to one"):
        reshape.align_features(df.select("text_id", "a").limit(1), labels)
    with pytest.raises(ValueError, match="one to one"):
        reshape.align_features(df.select("text_id", "a").union(df.select("text_id", "a")), labels)


def test_drop_missing_drops_nan_too(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, None), (1.0, 2.0)], "a double, b double")
    assert reshape.drop_missing(df, ["a", "b"]).count() == 1
    assert reshape.drop_missing(df, ["a", "b"], "all").count() == 2
