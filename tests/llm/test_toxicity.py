import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe.llm.arrow import utf8_slices
from inkprobe.llm.toxicity import Cnn, CnnSpec, fit, flagged, hashed_words, learn, score
from inkprobe.llm.wordhash import NOT_BLANK, hash_runs, words

SMALL = CnnSpec(buckets=1 << 12, epochs=(6, 12), visits=6000)
BAD = ["vile", "rotten", "wretch", "fiend"]


def corpus(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(BAD).upper() if rng.random() < 0.3 else rng.choice(BAD))
        rows.append((i, " ".join(text), rng.choice(["en", "fr"]), 0.5))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_cases(spark):
    rows, labels = corpus(1500)
    extra = [(9000, None, None, 0.5), (9001, "", "xx", 0.5), (9002, "w1 " * 60_000 + "vile", "en", 0.5), (9002, "w1", "en", 0.5)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, toxicity double")
    known = spark.createDataFrame(labels + [(9001, None)], "doc_id long, toxic int")
    model = learn(docs, known, spec=SMALL)
    out = {(r.doc_id, (r.text or "")[:3]): r for r in score(docs, model).withColumn("f", flagged(model)).collect()}
    assert len(out) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in out.values() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 9000]
    right = [(r.toxicity >= 0.3) == truth[r.doc_id] for r in held]
    assert len(held) > 200 and np.mean(right) > 0.9
    assert np.mean([r.f == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.toxicity <= 1 for r in out.values())
    assert out[9000, ""].toxicity == out[9001, ""].toxicity < 0.3
    assert out[9002, "w1 "].f and not out[9002, "w1"].f


def test_bounds_of_the_fit_leave_scores_and_thresholds(spark):
    """Far fewer positive and negative rows than there are, half of each: as with all rows, about a tenth of which are positive."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(6000):
        kind = rng.choices(["vile", "grey", "w0"], [5, 20, 75])[0]
        rows.append((i, " ".join([kind] + [f"w{rng.randrange(400)}" for _ in range(12)]), "en"))
        labels.append((i, int(rng.random() < {"vile": 0.9, "grey": 0.15, "w0": 0.02}[kind])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    means = []
    for spec in (SMALL, replace(SMALL, fit_positive=250, fit_negative=250)):
        model = learn(docs, known, spec=spec)
        out = score(docs, model).withColumn("f", flagged(model).cast("int")).withColumn("kind", F.split("text", " ")[0])
        means.append({r.kind: (r.s, r.f) for r in out.groupBy("kind").agg(F.avg("toxicity").alias("s"), F.avg("f").alias("f")).collect()})
    for kind, (mean, share) in means[0].items():
        assert means[1][kind] == pytest.approx((mean, share), abs=0.15)


def test_all_labelled_rows_are_fitted_on(spark, monkeypatch):
    """No bound unless it is asked for; shards whose replicas meet learn what one task learns."""
    from inkprobe.llm import toxicity

    assert CnnSpec().fit_positive is None and CnnSpec().fit_negative is None
    rows, labels = corpus(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, x double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    staged = {}
    real = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    model = learn(docs, known, spec=replace(SMALL, shard_rows=400))
    fitted = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    packs = staged["fit-rows"].agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("held").alias("held"), F.count("n").alias("shards")).first()
    assert (packs.n, packs.ones, packs.shards) == (len(fitted), sum(dict(labels)[i] for i in fitted), -(-len(fitted) // 400))
    # Calibration counts every row that was held back.
    assert staged["logits"].agg(F.sum("n")).first()[0] == packs.held > 0
    out = {r.doc_id: r for r in score(docs, model).withColumn("f", flagged(model)).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i].toxicity >= 0.3) == dict(labels)[i] for i in held]) > 0.9
    assert np.mean([out[i].f == dict(labels)[i] for i in held]) > 0.9


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 1), (2, "c", "en", 1)], "doc_id long, text string, lang string, toxic int")
    assert score(docs, fit(docs, spec=SMALL)).first().toxicity > 0.9
    assert score(docs, fit(docs.limit(0), spec=SMALL)).first().toxicity == pytest.approx(0.5)
    assert score(docs.limit(0), fit(docs, spec=SMALL)).count() == 0


def test_pooling_ignores_neighbours_in_the_batch():
    model = Cnn.fresh(SMALL)
    texts = ["one two three four", "", "a", "five six", "x y z " * 50]
    ids = [hashed_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), SMALL)[0] for t in texts]
    together = model.logits(np.concatenate(ids), np.array([len(i) for i in ids]))
    alone = [model.logits(i, np.array([len(i)]))[0] for i in ids]
    assert np.allclose(together, alone, atol=1e-5)


def test_pieces_of_long_texts(monkeypatch):
    from inkprobe.llm import toxicity

    model = Cnn.fresh(SMALL)
    texts = ["a b c " * 30, "d", "", "e f " * 9]
    ids = [hashed_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), SMALL)[0] for t in texts]
    counts = np.array([len(i) for i in ids])
    whole = model.logits(np.concatenate(ids), counts)
    monkeypatch.setattr(toxicity, "_ROWS", 7)
    assert np.allclose(model.logits(np.concatenate(ids), counts), whole, atol=1e-5)


def test_word_hashes():
    import pyarrow as pa

    texts = ["the cat", None, "", "cat the  ", "x" * 3000 + " cat", "thecat"]
    seen = {}
    for first, _, data, offsets in utf8_slices(pa.array(texts)):
        starts, ends, counts = words(data, offsets, NOT_BLANK)
        hashes, at = hash_runs(data, starts, ends), 0
        for i, n in enumerate(counts):
            own = (texts[first + i] or "").split()
            assert len(own) == n
            for word, h in zip(own, hashes[at : at + n]):
                assert seen.setdefault(word, h) == h
            at += n
    assert len(set(seen.values())) == len(seen) == 4


def test_learning_leaves_little_on_disk(spark):
    """What the replicas learned goes once the model has it."""
    from pyspark.sql import functions as F

    from inkprobe import session
    from inkprobe.llm import toxicity

    before = list(session._staged)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") % n) for n in (3, 5, 7, 11)]).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    toxicity.learn(docs, labels, spec=toxicity.CnnSpec(shard_rows=100))
    assert not [p for p in session._staged if p not in before and "/learned-" in p]
