import random

import numpy as np
import pytest

from inkprobe.llm.suffix_dedup import _repeated, anchors, remove_repeats
from inkprobe.llm.suffixes import common_prefixes, joined, repeated_starts, suffix_order


def brute(rows, length):
    first, flags = {}, {}
    for doc, text in sorted(set((d if d is not None else 1 << 62, t or "") for d, t in rows)):
        data = text.encode()
        flag = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i : i + length], (doc, i)) != (doc, i):
                flag[i : i + length] = b"\1" * length
        flags[doc] = (data, flag)
    out = {}
    for doc, (data, flag) in flags.items():
        runs = sum(1 for i, f in enumerate(flag) if f and (i == 0 or not flag[i - 1]))
        out[doc if doc < 1 << 62 else None] = (runs, sum(flag), bytes(b for b, f in zip(data, flag) if not f))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "andante", "x", "1", "tion ", "\n", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passages = [text(n) for n in (12, 20, 40, 90, 200)]
    rows = []
    for i in range(250):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 3))
            parts += [p[a : len(p) - rng.randrange(max(1, len(p) // 3))], text(rng.randrange(0, 20))]
        if rng.random() < 0.05:
            parts *= 2
        rows.append((rng.randrange(10**6) * 251 + i, " ".join(parts)))
    rows += [(2 * 10**9 + i, rows[i % 7][1]) for i in range(20)]  # copies
    rows += [(3 * 10**9, "a" * 3000), (3 * 10**9 + 1, "ab" * 700 + "a" * 400), (3 * 10**9 + 2, None), (3 * 10**9 + 3, ""), (5, "a" * 99), (6, "b" * 100)]
    rows += [(7, "b" * 101), rows[3], (None, rows[5][1] + " end"), (8, "Thaen " * 500)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string").repartition(4)
    want = brute(rows, 100)
    out = remove_repeats(df).collect()
    assert len(out) == len(rows)
    for r in out:
        runs, removed, kept = want[r.doc_id]
        assert (len(r.spans), sum(s.end - s.start for s in r.spans), bytes(r.kept)) == (runs, removed, kept)


def test_string_by_string(spark):
    from inkprobe.llm.suffix_dedup import _one_by_one

    rng = random.Random(3)
    value = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 20)))
    rows = [(d, s, value()) for d in range(40) for s in (0, 50)]
    got = {(r.doc, r.start) for r in _one_by_one(spark.createDataFrame([(1, *r) for r in rows], "anchor long, doc long, start long, bytes binary"), 6).collect()}
    hits = repeated_starts([r[2] for r in rows], [(r[0], r[1]) for r in rows], 6)
    assert got == {(d, s + int(h)) for (d, s, _), own in zip(rows, hits) for h in own}


def test_several_texts_of_an_id_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 200), (1, "b" * 200)], "doc_id long, text string")
    with pytest.raises(ValueError):
        remove_repeats(df)
    assert remove_repeats(df.limit(0)).count() == 0


def test_rows_without_id_and_clashing_names(spark):
    a, b = "first " * 40, "second " * 40
    rows = [(None, a + "x"), (None, b), (None, b), (5, a), (6, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, doc int, carried int, start int")
    out = remove_repeats(df).collect()
    kept = {(r.doc_id, r.text): len(r.kept) for r in out}
    # The text with an id stands; the others lose what they repeat of it, or of themselves.
    assert kept[5, a] == kept[None, a + "x"] + 99 or kept[None, a + "x"] < len(a) and len(out) == 5
    assert kept[6, None] == 0 and all((r.doc, r.carried, r.start) == (1, 2, 3) for r in out)
    for length in (31, 287):
        with pytest.raises(ValueError):
            remove_repeats(df, length=length)


@pytest.mark.parametrize("symbols", [1, 2, 4, 30])
def test_suffix_array(symbols):
    rng = random.Random(symbols)
    strings = [bytes(rng.randrange(symbols) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + [b"\xff" * 30, b"\0" * 9]
    x, _ = joined(strings)
    order = suffix_order(x, 80)
    cut = lambda i: tuple(x[i : i + 80])
    assert sorted(order.tolist()) == list(range(len(x)))
    assert all(cut(a) <= cut(b) for a, b in zip(order, order[1:]))
    shared = common_prefixes(x, order, 25)
    for k in range(1, len(x)):
        a, b = x[order[k - 1] :], x[order[k] :]
        n = min(len(a), len(b), 25)
        differ = np.flatnonzero(a[:n] != b[:n])
        assert shared[k] == (differ[0] if len(differ) else n)


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 400))) for _ in range(30)] + [b"a" * 5000, b"abc" * 900, b"x" * 100]
    offsets = np.cumsum([0, *map(len, texts)])
    begin, last, place, value = anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, 100)
    data, seen, covered = b"".join(texts), {}, set()
    for a, b, p, v in zip(begin, last, place, value):
        for s in range(a, b + 1):
            assert s <= p <= s + 68 and s not in covered
            covered.add(s)
            assert seen.setdefault(data[s : s + 100], (p - s, v)) == (p - s, v)
    assert covered == {int(o) + i for o, t in zip(offsets, texts) for i in range(len(t) - 99)}


def test_runs_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(0, 4, (300, 4)), axis=0)
    rows = np.concatenate([rows, rows[10:12], [[9, 9, 9, 9]]])
    rows = rows[np.lexsort(rows.T[::-1])].astype(np.int64)
    settled = pa.array(np.zeros(len(rows), bool))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), settled], names=["anchor", "context", "doc", "packed", "settled"])
    results = []
    for step in (1000, 13, 2, 1):
        out = list(_repeated(batch.slice(i, step) for i in range(0, len(rows), step)))
        results.append(sorted(tuple(r.values()) for o in out for r in o.to_pylist()))
    assert all(r == results[0] for r in results[1:])
    firsts = {tuple(r[:2]) for r in rows.tolist()}
    several = {a for a, _ in firsts if sum(x == a for x, _ in firsts) > 1}
    assert sum(r[3] for r in results[0]) == sum(a in several for a, _ in firsts)
