import pytest
from pyspark.sql import functions as F

from inkprobe.functions import prompts


def candidates(spark, *ids):
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(ids)], "ord int, ids array<int>")


def test_first_single_token_candidate_wins(spark):
    assert prompts.resolve_single_token(candidates(spark, [7], [5])).first().token_id == 7
    assert prompts.resolve_single_token(candidates(spark, [1, 2], [5])).first().token_id == 5


def test_no_single_token_candidate_raises(spark):
    with pytest.raises(Exception, match="single token"):
        prompts.resolve_single_token(candidates(spark, [1, 2], [3, 4])).collect()


def test_log_odds_is_the_logit_difference(spark):
    rows = spark.createDataFrame([([5.0, 0.0, 0.0],), ([0.0, 5.0, 1.0],), ([2.0, 2.0, 2.0],)], "z array<double>")
    assert [r[0] for r in rows.select(prompts.yes_no_log_odds(F.col("z"), 0, 1)).collect()] == [5.0, -5.0, 0.0]


def test_long_text_is_cut_and_the_prompt_survives(spark):
    prompt = list(range(100, 115))
    limit = len(prompt) + 10
    rows = spark.createDataFrame([([1] * 10_000,), ([2, 3, 4],)], "ids array<int>")
    long, short = (r.ids for r in rows.select(prompts.build_causal_prompt(F.col("ids"), prompt, limit, [-1], [-2]).alias("ids")).collect())
    assert long[0] == -1 and long[-1] == -2 and long[1:-1][-15:] == prompt and len(long) == limit
    assert short == [-1, 2, 3, 4, *prompt, -2]


def test_cloze_keeps_slot_and_suffix(spark):
    prefix, suffix = [11, 12], [13]
    limit = len(prefix) + 1 + len(suffix) + 10
    rows = spark.createDataFrame([([999] + [1] * 10_000,), ([],)], "ids array<int>")
    built = prompts.build_cloze(F.col("ids"), prefix, 999, suffix, limit, [-1], [-2])
    out = rows.select(built.alias("ids"), prompts.mask_position(built, 999).alias("slot")).collect()
    for row in out:
        assert row.ids[1:-1][-4:] == [11, 12, 999, 13]
        assert len(row.ids) <= limit
        assert row.slot == len(row.ids) - 3  # the last 999, although the text starts with one


def test_tiny_limit_keeps_one_text_token(spark):
    rows = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert rows.select(prompts.build_causal_prompt(F.col("ids"), [9, 9, 9], 2).alias("ids")).first().ids == [1, 9, 9, 9]


def test_last_real_position_on_either_padding_side(spark):
    rows = spark.createDataFrame([([1, 1, 0],), ([0, 1, 1],), ([0, 0, 0],)], "m array<int>")
    assert [r[0] for r in rows.select(prompts.last_real_position(F.col("m"))).collect()] == [1, 2, 0]
