import numpy as np
import pytest

from inkprobe.llm.prefix_forest import Forest, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k):
    good = {}
    for i, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q in asked:
        if q in good:
            near = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q])))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def rows_of(rng, n, d):
    return [(i, [float(x) for x in rng.standard_normal(d)], "x") for i in range(n)]


def test_all_candidates_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 150, 5)
    rows += [(200 + i, rows[0][1], "copy") for i in range(40)]  # ties
    rows += [(300, None, ""), (301, [], ""), (302, [0.0] * 5, ""), (303, [1.0, None, 0.0, 0.0, 0.0], ""), (304, [float("nan")] * 5, "")]
    rows += [(305, [float("inf"), 0.0, 0.0, 0.0, 0.0], ""), (306, [1.0, 2.0], ""), (306, [1.0, 2.0], ""), rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    # The share counts entries over all trees: more than trees times the block means everything.
    for r in nearest(df, df.filter("vec_id % 5 = 0"), k=6, trees=4, share=4.0, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute(rows, [r[0] for r in rows if r[0] % 5 == 0], 6).items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-13, atol=1e-13)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0], "")], SCHEMA)
    assert nearest(df, df).count() == 0
    assert nearest(one, one).count() == 0


def test_recall_of_the_default_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()])
    assert recall >= 0.9


@pytest.mark.parametrize("least", [1, 30, 400])
def test_climbing_stops_at_the_deepest_level_with_enough(least):
    rng = np.random.default_rng(1)
    forest = Forest(rng.standard_normal((300, 8)), trees=3, bits=12, seed=2)
    asked = rng.standard_normal((20, 8))
    mask = forest.candidates(asked, least)
    strings = forest._strings(np.column_stack([asked, np.zeros(20)]))
    own = np.empty_like(forest.sorted)
    np.put_along_axis(own, forest.orders, forest.sorted, axis=1)
    for q in range(20):
        for level in range(12, -1, -1):
            inside = (own >> (12 - level)) == (strings[:, q] >> (12 - level))[:, None]
            if inside.sum() >= least or level == 0:
                break
        assert (inside.any(axis=0) == mask[q]).all()


def test_few_candidates_suffice_where_vectors_cluster(spark):
    """200 clusters: a tenth of the entries finds nine of ten neighbours, and only candidates are scored."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((200, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = centres[rng.integers(0, 200, 4000)] + 0.03 * rng.standard_normal((4000, 32))
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    forest = Forest(vectors, 24, 48, 1)
    mask = forest.candidates(vectors[:50], 400)
    assert mask.mean() < 0.35
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, df.filter("vec_id % 40 = 0"), k=10, share=0.1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [i for i in range(0, 4000, 40)], 10)
    hits = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(len(v) for v in want.values())
