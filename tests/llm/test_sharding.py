from collections import Counter

import pytest

from inkprobe.llm.sharding import interleave

ROWS = (
    [(i, "big", "t", i) for i in range(700)]
    + [(i, f"s{i % 5}", "t", i) for i in range(700, 1000)]
    + [(i, None, "t", i) for i in range(1000, 1100)]
    + [(i, f"only{i}", "t", i) for i in range(1100, 1150)]
    + [(None, "big", None, 1)] * 30
    + [(7, "big", "t", 7)] * 20
)
SCHEMA = "doc_id long, source string, text string, shard long"


@pytest.mark.parametrize("bucket_rows", [20_000, 37])
@pytest.mark.parametrize("shards", [1, 7, 16])
def test_law_and_mixture(spark, shards, bucket_rows):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    out = interleave(df, shards, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in ROWS)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(shards):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sizes[shard]))
    # A source of n rows has n / shards rows in each shard, but for the rounding of the other sources' shares.
    sources = Counter(r[1] for r in ROWS)
    per_shard = Counter((r.source, r.shard) for r in out)
    for source, n in sources.items():
        if n > 50:
            assert all(abs(per_shard[source, s] - n / shards) <= 0.1 * n / shards + 4 for s in range(shards))


def test_buckets_do_not_change_the_result(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None][:1150], SCHEMA)
    placed = lambda rows, parts: {(r.doc_id, r.shard, r.slot) for r in interleave(df.repartition(parts), 9, bucket_rows=rows).collect()}
    assert placed(20_000, 3) == placed(11, 8)


def test_empty(spark):
    out = interleave(spark.createDataFrame([], SCHEMA), 4)
    assert out.columns == ["doc_id", "source", "text", "shard", "slot"] and out.count() == 0
    with pytest.raises(ValueError):
        interleave(out, 0)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "s", 1, 2, 3) for i in range(20)], "doc_id long, source string, __md5 int, __rank int, __row int")
    out = interleave(df, 4).collect()
    assert len(out) == 20 and all((r["__md5"], r["__rank"], r["__row"]) == (1, 2, 3) for r in out)
