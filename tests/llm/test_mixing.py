import random
from collections import defaultdict

import pytest

from inkprobe.llm.mixing import mix, repeat_copies, source_targets


def water(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by raising one common level and stopping each source at its limit."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or set(open_)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5}, {"a": 0, "b": 7}, {"a": 0}, {None: 3},
    {f"s{i}": (i * 37) % 91 for i in range(40)},
])
def test_targets(spark, sizes):
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: r for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = water(sizes)
    assert {s: r.source_size for s, r in got.items()} == sizes
    for s in sizes:
        assert got[s].target == pytest.approx(want[s])


def corpus(rng, n):
    lengths = [0, 1, 3, 10, 30, 100, 101, 102, 2000]
    source = lambda i: ["a", "b", "c", None, "é", "d"][min(5, int(rng.expovariate(0.7)))]
    rows = [(i, " ".join(["w"] * rng.choice(lengths)), source(i), i) for i in range(n)]
    return rows + [(n, None, "a", 0), (n + 1, "", None, 0), (None, "x y z", "b", 0)] + [rows[5]] * 30


def test_mix(spark):
    rows = corpus(random.Random(2), 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mix(df).cache()
    got = out.collect()
    assert len(got) == len(rows)
    words = lambda t: len((t or "").replace(" ", "_").split())
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += words(text)
    want, taken, copies = water(sizes), defaultdict(int), defaultdict(float)
    for r in got:
        assert r.size == words(r.text) and 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[r.source])
        ratio = want[r.source] / sizes[r.source]
        assert int(ratio + 1e-9) <= r.copies <= int(ratio) + 1
        taken[r.source] += r.copies * r.size
        copies[r.source] += r.copies - ratio
    for source in sizes:
        assert taken[source] == pytest.approx(want[source], rel=0.03)
        assert abs(copies[source]) <= 32  # the repeated row counts for 31
    again = mix(df.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.copies) for r in got) == sorted((r.doc_id or -1, r.copies) for r in again)
    assert repeat_copies(out).count() == sum(r.copies for r in got)
    assert repeat_copies(out).columns == ["doc_id", "text", "source"]


def test_odds_are_the_fractions(spark):
    from inkprobe.llm.mixing import choose_copies

    units = spark.createDataFrame([(i, s, 10, 1) for s in "ab" for i in range(60)], "key long, source string, size long, times long")
    total = defaultdict(int)
    for seed in range(6):
        for r in choose_copies(units, ["key"], seed=seed, group_rows=8).collect():
            total[r.source, r.key] += r.copies
    # Source a wants 10 / 7 copies of each document, b 4 / 7; every run rounds the sum of a source to a neighbour.
    for source, share in (("a", 10 / 7), ("b", 4 / 7)):
        own = [total[source, i] for i in range(60)]
        assert abs(sum(own) - 6 * 60 * share) <= 6
        assert max(abs(n / 6 - share) for n in own) < 0.75


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 7, 8, 9) for i in range(20)], "doc_id long, text string, source string, __size int, own_key int, row int")
    out = repeat_copies(mix(df)).collect()
    assert out and all((r["__size"], r.own_key, r.row) == (7, 8, 9) for r in out)
