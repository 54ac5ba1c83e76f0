import random
import re
from collections import Counter

import numpy as np
import pytest

from inkprobe.llm.periodic_runs import periodic_runs
from inkprobe.llm.periods import solve_tiles
from inkprobe.llm.query_runs import planted


def brute(text):
    """Runs by comparing every word with that one period later; words that no run repeats."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                spans.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted((s, q, length) for (s, length), q in spans.items())
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "a a a a a", "a a a a a a", " a\ta\na a a a ", "b" * 100_000, "x y " * 3, "x y " * 4, "é è " * 9 + "é"]
    texts += ["a b c a b c a b c a b", "a b c a b c a b c a b c", "z a a a a a a b a a a a a a y"]
    for _ in range(60):
        words = []
        while len(words) < rng.choice([20, 100, 700]):
            base = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40, 90]))]
            words += (base * rng.randint(1, 7))[: rng.randint(1, 400)]
            words += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 1, 3]))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    thue = "a"
    for _ in range(11):
        thue += thue.translate({97: "b", 98: "a"})
    return texts + [" ".join(thue), "same " * 3000, " ".join(str(i % 700) for i in range(3500)), texts[-1], texts[-1]]


@pytest.mark.parametrize("span", [1 << 16, 64])
def test_against_brute_force(spark, span):
    texts = some_texts(span)
    rows = [(i if i % 9 else None, t, i, "r") for i, t in enumerate(texts)] + [(1, texts[1], 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, runs string").repartition(5)
    out = periodic_runs(df, span=span).collect()
    want = Counter()
    for doc, text, key, _ in rows:
        runs, left = brute(text)
        want[(doc, text, key, tuple(runs), left)] += 1
    got = Counter((r.doc_id, r.text, r.key, tuple((x.start, x.period, x.length) for x in r.runs), r.collapsed) for r in out)
    assert got == want


def test_tiles_meet():
    """A text in one tile and the same text in two give the same stretches after joining."""
    words = np.array([i % 7 for i in range(200)] + list(range(100, 300)), np.uint64)
    one = solve_tiles(words, np.array([0, 400]), *(np.array([v]) for v in (0, 6, 0, 0, 400, 400)))
    assert [tuple(int(c[i]) for c in one[1:]) for i in range(len(one[0]))] == [(7, 0, 193)]


def test_empty_and_columns(spark):
    df = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, hash int")
    assert periodic_runs(df).columns == ["doc_id", "text", "hash", "runs", "collapsed"]
    assert periodic_runs(df, keep=["hash"]).columns == ["hash", "runs", "collapsed"]
    assert periodic_runs(df.limit(0)).count() == 0


def test_planted_words(spark):
    import zlib

    texts = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(200)] + [(None, "a b")]
    for r in planted(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        own = texts[r.doc_id][1].split() if r.doc_id is not None else ["a", "b"]
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and own:
            g, n = h // 10, len(own)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
        assert r.text.split() == own
