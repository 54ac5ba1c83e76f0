import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkprobe.llm import collocations as co
from inkprobe.llm.misra_gries import Summary, pack, summed, unpack


def brute(rows, threshold, longest, contained, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][words[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) >= 2 and a >= threshold}
        rows = []
        for p, a in some.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= contained * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(rows[:most])]
    return sorted(out)


def some_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "ÉA", "x\x00y", "in", "a", "b"] + [f"w{i}" for i in range(30)]
    rows = [(None, None), ("en", ""), (None, " \t "), ("und", "a b a b"), ("en", "..,;!?"), ("de", "q" * 100_000), ("de", "in new york\tcity in  new york city " * 300)]
    for i in range(150):
        words = []
        while len(words) < rng.randint(5, 120):
            words += rng.choice([["new", "york"], ["of", "the", "new", "york"], [rng.choice(vocabulary)], ["once", "upon", "a", "time", "there", "was"]])
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ",", "\n", "\r", " ;", ":", "!", "?", "\x0b"])
        rows.append((rng.choice(["en", "de", "fr", None]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows + rows[40:60]


@pytest.mark.parametrize("seed, threshold, contained, small", [(1, 5, 100, False), (2, 20, 60, True)])
def test_against_brute_force(spark, monkeypatch, seed, threshold, contained, small):
    if small:  # many summaries, a full filter, texts sent early, few counters
        monkeypatch.setattr(co, "_TOGETHER", 500)
        monkeypatch.setattr(co, "_MOST_BITS", 1 << 15)
        monkeypatch.setattr(co, "_PHRASES", 40)
        monkeypatch.setattr(co, "_COUNTERS", 3)
    rows = some_rows(seed)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, phrase int").repartition(6)
    found = co.collocations(df, threshold=threshold, contained=contained)
    got = sorted((r.grp, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.first_of_each(found, 25).collect())
    want = brute(rows, threshold, 5, contained, 25)
    assert len(want) > 20 and got == want


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_summary_keeps_all_heavy_values():
    rng = np.random.default_rng(5)
    stream = np.r_[rng.zipf(1.3, 60_000) % 5000, rng.integers(0, 1 << 32, 100_000)].astype(np.uint32)
    rng.shuffle(stream)
    values, counts = summed(stream)
    for threshold in (20, 200):
        summary = Summary(len(stream), threshold)
        for part in np.array_split(stream, 37):
            summary.add(*unpack(pack(*summed(part)), len(summed(part)[0])))
        assert summary.lost > 0 and len(summary.values) <= summary.capacity * 5
        assert set(values[counts >= threshold]) <= set(summary.heavy())


def test_packed_counts():
    values, counts = np.array([0, 7, 1 << 20, (1 << 32) - 1], np.uint32), np.array([1, 255, 256, 1 << 40])
    got = unpack(pack(values, counts), 4)
    assert (got[0] == values).all() and (got[1] == counts).all()
