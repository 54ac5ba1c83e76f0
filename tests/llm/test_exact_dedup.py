import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkprobe.llm import bloom, exact_dedup as ed
from inkprobe.llm.query_copies import op13_exact_dedup

SCHEMA = "doc_id long, text string, digest string, row int, kept string"
ROWS = (
    [(i, f"text number {i}", "d", i, "x") for i in range(300)]
    + [(1000 - i, "the same\t\t text", "d", i, "x") for i in range(400)]
    + [(2000 + i, "the same \n text", "d", i, "x") for i in range(5)]
    + [(3000 + i, t, "d", i, None) for i, t in enumerate([None, "", "", " ", "  ", " ", "a" * 200_000, "a" * 200_000, "A", "a"])]
    + [(None, "nobody's", "d", 1, "x")] * 3
    + [(None, "text number 7", "d", 1, "x"), (7, "text number 7", "d", 7, "x"), (9, "another text of nine", "d", 9, "x")]
)


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc, text in rows:
        groups[norm(text)].append(doc)
    out = Counter()
    for text, docs in groups.items():
        docs.sort(key=lambda d: (d is None, d))
        for i, d in enumerate(docs):
            out[(d, docs[0], len(docs), i == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("cells, blocks", [(64, 16_384), (1, 1)])
def test_against_brute_force(spark, monkeypatch, cells, blocks):
    monkeypatch.setattr(ed, "CELLS_PER_ROW", cells)
    monkeypatch.setattr(bloom, "MOST_BLOCKS", blocks)
    out = ed.exact_dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(7)).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out)
    assert got == brute([r[:2] for r in ROWS])


def test_columns_and_empty(spark):
    df = spark.createDataFrame(ROWS[:3], SCHEMA)
    out = ed.exact_dedup(df)
    assert out.columns == ["doc_id", "text", "digest", "row", "text_sha256", "keep_id", "group_size", "kept"]
    assert ed.exact_dedup(df, keep=["row"]).columns == ["row", "text_sha256", "keep_id", "group_size", "kept"]
    assert ed.exact_dedup(df.limit(0)).count() == 0


def test_filter_misses_no_key_and_moves_few_others(spark, monkeypatch):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("key"))
    marked = bloom.BloomFilter(keys, "key", 5000).mark(spark.range(5000 * 7919).filter("id % 97 = 0 OR id % 7919 = 0"), "id", "hit")
    missed, wrong, others = marked.select(
        F.sum((~F.col("hit") & (F.col("id") % 7919 == 0)).cast("int")), F.sum((F.col("hit") & (F.col("id") % 7919 != 0)).cast("int")), F.count("*")
    ).first()
    assert missed == 0 and wrong < 0.02 * others
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_query_over_the_whole_table(spark):
    df = op13_exact_dedup(spark, "/root/testdata/sf0.001")
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()) == want
