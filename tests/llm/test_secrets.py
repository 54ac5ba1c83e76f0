import hashlib
import random
import re

from inkprobe.llm.secrets import ALPHABET, KINDS, MarkovPair, labelled_samples, ordinary_runs, scan, spans_text

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text, model, least=20, margin=12.0):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    added, n = [], len(ALPHABET)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        codes = [ALPHABET.index(c) for c in m[0]]
        score = sum(model.ratios[a * n + b] for a, b in zip(codes, codes[1:]))
        if len(m[0]) >= least and score >= margin and not any(s < m.end() and m.start() < e for s, _, e in base):
            added.append((m.start(), 3, m.end()))
    return sorted(base), sorted(added)


def texts():
    rng = random.Random(8)
    bits = ["password: hunter22", "Token=abc", "token: token: abcdefg", "API_KEY = 'A.b-c_d=e'", "apikey:'12345", "secret=\"xyzzyxyz\"", "AKIA" + "A1" * 8,
            "AKIAAKIA" + "Z9" * 8, "AKIA123", "deadbeef" * 3, "deadbeef", "é", "日本語", "𝒳𝒴", "\n", "some ordinary words here", "reading_list_of_items_total",
            "getCustomerAddressFromOrder", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzq8", "Zx9Kq2Lw7Bn4Vt6Yp3Rm8"]
    out = ["".join(rng.choice(bits) + rng.choice([" ", "", ", "]) for _ in range(rng.randrange(9))) for _ in range(300)]
    return [*out, None, "", " ", "x" * 100_000 + " password=abcdef " + "ab " * 20_000, "f" * 50_000]


def test_same_as_brute_force(spark):
    values = texts()
    rows = [(i, t, "b") for i, t in enumerate(values)] + [(0, values[0], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    plain = spark.createDataFrame([(i, "some ordinary words and customer addresses in a list of orders, or items " * 20) for i in range(9)], "doc_id long, text string")
    model = MarkovPair.train(labelled_samples(plain))
    out = scan(docs, model).withColumn("joined", spans_text("base")).collect()
    assert len(out) == len(rows)
    found = 0
    for row in out:
        base, added = brute(row.text or "", model)
        assert [tuple(s) for s in row.base] == base
        assert [tuple(s) for s in row.added] == added
        assert row.joined == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        found += len(added)
    assert found > 20


def test_random_strings_apart_from_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = MarkovPair.train(labelled_samples(docs))
    digest = lambda i: hashlib.sha256(str(i).encode())
    import base64

    secrets = [base64.b64encode(digest(i).digest())[:30].decode() for i in range(200)]
    words = [w for r in docs.filter("doc_id % 7 = 3").collect() for w in re.findall("[a-z]{4,}", r.text)][:6000]
    plain = ["_".join(words[i : i + 4]) for i in range(0, 4000, 4)] + ["".join(w.title() for w in words[i : i + 4]) for i in range(0, 4000, 4)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(secrets + plain)], "doc_id long, text string")
    hit = {r.doc_id for r in scan(rows, model).filter("size(added) > 0").collect()}
    assert sum(i < 200 for i in hit) >= 196
    assert sum(i >= 200 for i in hit) <= 20


def test_numbered_names_are_ordinary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = MarkovPair.train(labelled_samples(docs))
    names = ["invoice-2024-000123-4567", "order_2023_11_04_000017", "2024-01-15-backup-0001", "1234567890123456789012", "2024-01-15-2024-01-16-report"]
    keys = [hashlib.sha256(f"k{i}".encode()).hexdigest()[:23].upper() for i in range(20)] + ["Zx9Kq2Lw7Bn4Vt6Yp3Rm8", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzq8"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(names + keys)], "doc_id long, text string")
    hit = {r.doc_id for r in scan(rows, model).filter("size(added) > 0").collect()}
    assert not hit & set(range(len(names)))
    assert len(hit) >= len(keys) - 1


def test_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([(i, "zq9 zq9 token=abcdef") for i in range(700)] + [(None, "zq9")], "doc_id long, text string")
    assert [(r.text, r.n) for r in ordinary_runs(docs).collect()] == [("zq9", 1401)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = MarkovPair.train(labelled_samples(docs))
    assert scan(docs, model).count() == 0
