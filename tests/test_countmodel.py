"""The closed forms against plain dense evaluation over the whole vocabulary."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe.functions import text
from inkprobe.operators.averages import METRICS
from inkprobe.operators.lookup import skew_safe_join
from inkprobe.operators import tokens as tk
from inkprobe.operators.pooling import pool_mean_by_id
from inkprobe.plans import backbones
from inkprobe.plans.backbones import CountModel, CountSpec

V, ALPHA = 12, 0.3
SPEC = dict(vocab_size=V, alpha=ALPHA, max_length=None)


def corpus(n=24, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(18)]
    # One word makes up a third of all tokens.
    texts = [" ".join(rng.choice(words + ["the"] * 9) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    return {i: t for i, t in enumerate(texts)} | {n: "", n + 1: "solo"}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "text_id bigint, text string")


def encode(texts):
    lists = {i: t.split() for i, t in texts.items()}
    counts = Counter(w for ws in lists.values() for w in ws)
    vocab = {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[: V - 1])}
    return {i: [vocab.get(w, 0) for w in ws] for i, ws in lists.items()}


def half(text_id):
    return 0 if hashlib.md5(f"41|half|{text_id}".encode()).hexdigest()[:8] < "80000000" else 1


def dense(counts, context, token):
    logits = [math.log(counts[(*context, t)] + ALPHA) for t in range(V)]
    norm = math.log(sum(math.exp(z) for z in logits))
    lp = [z - norm for z in logits]
    p = [math.exp(x) for x in lp]
    return [
        lp[token],
        -sum(a * b for a, b in zip(p, lp)),
        max(lp),
        (1 + sum(x > lp[token] for x in lp)) / V,
        sum(x for x in p if x >= p[token]),
    ]


def mean(rows):
    return [sum(c) / len(rows) for c in zip(*rows)] if rows else [0.0] * 5


def neighbours(ids, pos):
    return (ids[pos - 1] if pos else V, ids[pos + 1] if pos + 1 < len(ids) else V + 1)


def check(got, expected):
    rows = {r.text_id: [r[m] for m in METRICS] for r in got.collect()}
    assert rows.keys() == expected.keys()
    for key, values in expected.items():
        assert rows[key] == pytest.approx(values, abs=1e-9), key


def test_causal(spark):
    texts = corpus()
    coded = encode(texts)
    counts = Counter()
    for i, ids in coded.items():
        counts.update((1 - half(i), ids[p - 1], ids[p]) for p in range(1, len(ids)))
    expected = {
        i: mean([dense(counts, (half(i), ids[p - 1]), ids[p]) for p in range(1, len(ids))]) for i, ids in coded.items()
    }
    df = frame(spark, texts)
    model = CountModel.cross_fit(CountSpec("causal", **SPEC), df)
    check(model.pawn_metrics(df), expected)
    scores = {r.text_id: r.score for r in model.score(df).collect()}
    assert scores == {i: pytest.approx(v[0], abs=1e-9) for i, v in expected.items()}
    assert scores[24] == scores[25] == 0.0  # no token to predict


def test_masked(spark):
    texts = corpus()
    coded = encode(texts)
    counts = Counter()
    for i, ids in coded.items():
        counts.update((1 - half(i), *neighbours(ids, p), ids[p]) for p in range(len(ids)))
    expected = {
        i: mean([dense(counts, (half(i), *neighbours(ids, p)), ids[p]) for p in range(len(ids))]) for i, ids in coded.items()
    }
    df = frame(spark, texts)
    check(CountModel.cross_fit(CountSpec("masked", **SPEC), df).pawn_metrics(df), expected)


def numbers(seed, draw, text, size):
    digest = lambda p: hashlib.md5(f"{seed}|{draw // 5}|{text}|{p}".encode()).hexdigest()
    start = 6 * (draw % 5)
    return [int(digest(p)[start : start + 6], 16) / 2**24 for p in range(size)]


def masked_positions(seed, draw, text, size, ratio):
    u = numbers(seed, draw, text, size)
    hit = {p for p in range(size) if u[p] < ratio}
    return hit or {p for p in range(size) if u[p] == min(u)}


def test_diffusion_grid(spark):
    texts = corpus()
    coded = encode(texts)
    counts = Counter()
    for i, ids in coded.items():
        for p, t in enumerate(ids):
            left, right = neighbours(ids, p)
            counts.update((1 - half(i), a, b, t) for a in (left, -1) for b in (right, -1))
    grid = [(0.35, 7), (0.05, 3)]
    df = frame(spark, texts)
    model = CountModel.cross_fit(CountSpec("diffusion", **SPEC), df)
    rows = model.masked_draw_metrics(df, grid)
    for ratio, samples in grid:
        expected = {}
        for i, ids in coded.items():
            draws = []
            for d in range(samples):
                hidden = masked_positions(41, d, i, len(ids), ratio) if ids else set()
                at = []
                for p in hidden:
                    left, right = neighbours(ids, p)
                    context = (half(i), -1 if p - 1 in hidden else left, -1 if p + 1 in hidden else right)
                    at.append(dense(counts, context, ids[p]))
                draws.append(mean(at))
            expected[i] = mean(draws)
        check(rows.filter((rows.mask_ratio == ratio) & (rows.num_samples == samples)), expected)


def test_more_draws_than_one_mask_word(spark):
    tokenized = tk.tokenize(frame(spark, {1: "a b c d e f", 2: "x"}), None)
    draws = tk.mask_draws(tokenized, 0.3, 130, 7)
    got = Counter((r.text_id, r.draw) for r in draws.collect())
    for text, size in ((1, 6), (2, 1)):
        for d in range(130):
            assert got[(text, d)] == len(masked_positions(7, d, text, size, 0.3))
    weights = tk.mask_variants(tokenized, [(0.3, 130)], 7, []).groupBy("text_id").sum("w0").collect()
    assert [r[1] for r in weights] == pytest.approx([1.0, 1.0])


def test_fit_on_other_texts_handles_unknown_contexts(spark):
    train = frame(spark, {0: "a b a b a c"})
    model = CountModel.fit(CountSpec("causal", vocab_size=5, alpha=0.5, max_length=None), train)
    row = model.pawn_metrics(frame(spark, {9: "zzz yyy"})).first()
    # <unk> was never a context: the distribution is uniform.
    assert row.Mlog_prob == pytest.approx(-math.log(5)) and row.Mentropy == pytest.approx(math.log(5))
    assert row.Mmax_log_prob == pytest.approx(-math.log(5)) and row.Mrank == 0.2 and row.Mtop_p == 1.0


def test_max_length_cuts_before_everything_else(spark):
    long = frame(spark, {0: "a b " * 50})
    assert tk.tokenize(long, 5).first().tokens == ["a", "b", "a", "b", "a"]
    assert len(tk.tokenize(long, None).first().tokens) == 100


def test_large_vocabulary_path_gives_the_same_ids(spark, monkeypatch):
    texts = frame(spark, corpus())
    tokenized = tk.tokenize(texts, None)
    vocab = tk.vocabulary(tokenized, V)
    flat = tk.neighbours(tokenized, ["text_id"])
    ids = lambda: sorted(map(tuple, tk.encode(flat, vocab, V, ["left", "token", "right"]).collect()))
    near = ids()
    monkeypatch.setattr(tk, "BROADCAST_TOKENS", 3)
    assert ids() == near


def test_skew_safe_join_keeps_every_row(spark, monkeypatch):
    import inkprobe.operators.lookup as lookup

    monkeypatch.setattr(lookup, "HOT_KEYS", 3)
    facts = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i int, k int")
    keyed = facts.groupBy("k").count().withColumnRenamed("count", "uses").selectExpr("k", "uses", "k * 2 as v")
    rows = skew_safe_join(facts, keyed, ["k"]).collect()
    assert len(rows) == 300 and all(r.v == 2 * r.k for r in rows)


def test_embeddings(spark):
    texts = frame(spark, {0: "a b a", 1: "b", 2: ""})
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id bigint, vec array<float>")
    embed = lambda kind: {
        r.text_id: list(r.embedding)
        for r in CountModel.fit(CountSpec(kind, vocab_size=3, max_length=None), texts).embed(texts, vectors).collect()
    }
    blank = {2: [0.0, 0.0]}
    assert embed("causal") == {0: [1.0, 1.0], 1: [2.0, 1.0]} | blank
    assert embed("masked") == {0: [1.0, 1.0], 1: [2.0, 1.0]} | blank
    assert embed("diffusion") == {0: pytest.approx([4 / 3, 1.0]), 1: pytest.approx([2.0, 1.0])} | blank


def test_pooling_by_id_moves_no_vectors(spark):
    """The mean of the vectors named by id, with the table in one block or in several; between tasks go ids and weights."""
    rng = np.random.default_rng(3)
    table, width = rng.normal(size=(50, 6)), 6
    used = [(t, int(rng.integers(50)), float(rng.integers(0, 4))) for t in range(20) for _ in range(rng.integers(1, 30))] + [(99, 7, 0.0), (98, 3, 0.5)]
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(table)], "vec_id bigint, vec array<double>")
    rows = spark.createDataFrame(used, "text_id long, vec_id bigint, w double").repartition(3)
    for size in (1 << 20, 8 * width * 7):
        pooled = pool_mean_by_id(rows, vectors, block_bytes=size)
        got = {r.text_id: r.embedding for r in pooled.collect()}
        assert set(got) == {t for t, _, _ in used}
        for text, embedding in got.items():
            own = [(i, w) for t, i, w in used if t == text]
            assert np.allclose(embedding, sum(w * table[i] for i, w in own) / max(1.0, sum(w for _, w in own)))
    plan = pool_mean_by_id(rows, vectors)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "vec#" in line]


@pytest.mark.parametrize("paradigm", ["causal", "masked", "diffusion"])
def test_positions_move_once_and_hot_contexts_change_nothing(spark, monkeypatch, paradigm):
    """Only hashes are staged: no table of positions or pairs. Contexts too large for a bucket are dealt by token and give the same."""
    import inkprobe.operators.contexts as cx
    from inkprobe import session

    df = frame(spark, corpus(60))
    spec = CountSpec(paradigm, alpha=ALPHA)
    rows = lambda model: {r.text_id: [r[m] for m in METRICS] for r in model.pawn_metrics(df).collect()}
    before = len(session._staged)
    plain = rows(CountModel.cross_fit(spec, df))
    assert [path.rsplit("/", 1)[1].split("-")[0] for path in session._staged[before:]] == ["hashes"]
    looked_up = []
    table = cx._lookup_table
    monkeypatch.setattr(cx, "_lookup_table", lambda *a: looked_up.append(a[0].num_rows) or table(*a))
    monkeypatch.setattr(cx, "HOT_LEAST", 4)
    dealt = rows(CountModel.cross_fit(spec, df))
    assert looked_up and looked_up[0] > 0 and dealt.keys() == plain.keys()
    for key, values in plain.items():
        assert dealt[key] == pytest.approx(values, abs=1e-9)
    other = CountModel.fit(spec, df)
    new = frame(spark, {900: "the w1 the w2", 901: "never seen", 902: ""})
    again = {r.text_id: r.score for r in other.score(new).collect()}
    monkeypatch.setattr(cx, "HOT_LEAST", 10**6)
    assert again == pytest.approx({r.text_id: r.score for r in CountModel.fit(spec, df).score(new).collect()}, abs=1e-9)


def test_encoding_moves_no_strings(spark, monkeypatch):
    """Ids are looked up in one pass without a join; tokens beyond the shipped table are joined as numbers, and give the same ids."""
    tokenized = tk.tokenize(frame(spark, corpus()), None)
    flat = tk.neighbours(tokenized, ["text_id"])
    columns = ["left", "token", "right"]
    for limit in (None, V):
        vocab, v = tk.sized_vocabulary(tokenized, limit)
        ids = lambda: sorted(map(tuple, tk.encode(flat, vocab, v, columns).collect()))  # noqa: B023, E731
        with monkeypatch.context() as patched:
            whole = tk.encode(flat, vocab, v, columns)
            assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
            near = sorted(map(tuple, whole.collect()))
            by_token = {r.token: r.token_id for r in vocab.collect()}
            texts = {i: t.split() for i, t in corpus().items()}
            get = lambda ws, p: v if p < 0 else v + 1 if p == len(ws) else by_token.get(ws[p], 0)  # noqa: B023, E731
            assert near == sorted((i, len(ws), p, get(ws, p - 1), get(ws, p), get(ws, p + 1)) for i, ws in texts.items() for p in range(len(ws)))
            for most in (3, 0):
                patched.setattr(tk, "ENCODED_TOKENS", most)
                assert ids() == near


def test_end_tokens_are_picked_without_the_others(spark, monkeypatch):
    """Vectors of first and last tokens ask for token ids, but for no hashes of whole texts; both ways of picking agree."""
    staged = []
    monkeypatch.setattr(backbones, "stage", lambda df, name, of=backbones.stage: staged.append(name) or of(df, name))
    words = ["ΑΣ", "b\u2003İ", " \u0085lone\x1c ", "", " \t", None, "B c\nb", "c é😀 x́"]
    texts = spark.createDataFrame(list(enumerate(words)), "text_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "vec_id long, vec array<double>")
    for kind in ("causal", "masked"):
        embed = lambda limit: {r.text_id: r.embedding for r in CountModel.fit(CountSpec(kind, max_length=limit), texts).embed(texts, vectors).collect()}  # noqa: B023, E731
        whole = embed(None)
        assert whole == embed(1000) and sorted(whole) == [0, 1, 2, 3, 4, 6, 7] and whole[3] == whole[4] == [0.0]
    assert "used" in staged and not {"hashes", "vocabulary"} & set(staged)


def test_end_words_are_those_of_the_list(spark):
    blanks = ["\t", "\r\n", "\x1c", " ", "\x85", "\xa0", "\u1680", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000"]
    parts = ["A", "Σας", "ΟΔΟΣ", "\u200b", "\ufeff", "é", "😀z", "x́", ".", "İ"]
    rows = [(b + p + c + q + b,) for b in ["", *blanks] for c in blanks for p in parts for q in ("", "K\u0301", "ΑΣ")]
    df = spark.createDataFrame(rows, "text string").select(text.words(F.col("text")).alias("w"), text.first_word(F.col("text")).alias("a"), text.last_word(F.col("text")).alias("z"))
    assert all((r.w[0], r.w[-1]) == (r.a, r.z) for r in df.collect())
