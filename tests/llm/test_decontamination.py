import random
import re

from pyspark.sql import Row

from inkprobe.llm.decontamination import find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, size):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall(lowered(item_text))
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


def tables(spark):
    rng = random.Random(5)
    vocabulary = ["Ab", "cd", "é1", "x", "YZ", "9"]
    sentence = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 2, 4, 9]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (None, "x x x x")]
    texts = [sentence(rng.randrange(0, 60)) for _ in range(60)] + [None, "", "?", "  a", items[3][1] * 3]
    docs = [(i, t, i, "kept") for i, t in enumerate(texts)] + [(7, texts[7], 7, "kept")]
    return spark.createDataFrame(docs, "doc_id long, text string, n_hit int, note string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_same_as_brute_force(spark):
    frame, benchmark, docs, items = tables(spark)
    out = find_contamination(frame, benchmark, window=4).collect()
    assert len(out) == len(docs)
    for row in out:
        assert (row.n_words, row.n_hit, row["items"]) == brute(row.text, items, 4)
        assert row.note == "kept"
        inside = [w for s in row.spans for w in WORD.findall(lowered(row.text[s.start : s.end]))]
        assert len(inside) == row.n_hit


def test_blocks_give_the_same_rows(spark):
    frame, benchmark, _, _ = tables(spark)
    one = find_contamination(frame, benchmark, window=4)
    many = find_contamination(frame, benchmark, window=4, block_bytes=40)
    key = lambda r: (r.doc_id, r.n_hit, r["items"], r.spans)
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))


def test_empty_tables(spark):
    frame, benchmark, docs, _ = tables(spark)
    assert find_contamination(frame.limit(0), benchmark).count() == 0
    rows = find_contamination(frame, benchmark.limit(0)).collect()
    assert len(rows) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in rows)


def test_offsets_point_into_the_original(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="Ünï (Was IST, das?) né")])
    items = spark.createDataFrame([Row(item_id=4, text="was ist das")])
    row = find_contamination(docs, items).first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["Was IST, das"]
