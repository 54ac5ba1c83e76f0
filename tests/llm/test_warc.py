import gzip
import hashlib
import io
import os

import pyarrow.fs as fs
import pytest

from inkprobe.llm.warc import archive_records, encode_record, read_records, read_warc, write_warc

BIG = "x" * 200
PAGES = [
    (5, "http://a/5", BIG, 1), (3, "http://a/3", BIG, 2), (9, None, BIG, 3), (None, "http://a/n", BIG, 4), (3, "http://a/3", BIG, 5),
    (1, "http://a/1\r\nX: y", "short", 6), (2, "http://a/2", "short", 7), (4, "http://a/4", None, 8), (6, "u", "", 9),
    (7, "http://é/7", "é" * 300 + "\r\n\r\nWARC/1.1\r\n", 10), (8, "v", "z" * 300_000, 11), (11, "v", "z" * 300_000, 12),
]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int").repartition(3)
    write_warc(archive_records(pages), str(tmp_path / "w"), roll_bytes=400)
    return str(tmp_path / "w")


def test_round_trip(spark, archive):
    rows = read_warc(spark, archive).collect()
    assert len(rows) == len(PAGES)
    html = {p[0]: (p[2] or "") for p in PAGES}
    seen = {}
    for r in rows:
        row_id = int(r.fields["x-row-id"]) if "x-row-id" in r.fields else None
        full = html[row_id].encode()
        assert r.payload_bytes == len(full)
        assert r.payload_digest == "sha256:" + hashlib.sha256(full).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == full
        seen.setdefault(row_id, []).append((r.record_type, r.fields.get("x-refers-to-row-id")))
    revisit = ("revisit", "3")
    assert seen == {
        5: [revisit], 3: [("response", None)] * 2, 9: [revisit], None: [revisit], 8: [("response", None)], 11: [("revisit", "8")],
        **{i: [("response", None)] for i in (1, 2, 4, 6, 7)},
    }
    assert len(os.listdir(archive)) > 5  # rolled
    refers = {r.refers_to for r in rows if r.record_type == "revisit"}
    assert refers <= {r.record_id for r in rows if r.record_type == "response"}


def test_predicates_reach_the_reader(spark, archive):
    df = read_warc(spark, archive, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'http://a/5%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan
    assert [r.target_uri for r in df.collect()] == ["http://a/5"]
    assert read_warc(spark, archive, fields={"X-Row-Id": "7"}).count() == 1
    assert read_warc(spark, archive).filter("refers_to IS NULL").count() == 8
    assert read_warc(spark, archive, payload=False).filter("payload IS NULL").count() == len(PAGES)


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got, self.n = 0, len(data)

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data

    def size(self):
        return self.n


def test_unwanted_blocks_are_skipped_and_members_are_plain_gzip():
    random = os.urandom(3_000_000)
    rows = [{"record_type": t, "record_id": str(i), "payload": random, "target_uri": None} for i, t in enumerate(["response", "metadata"])]
    first, second = (encode_record(r, "2000-01-01T00:00:00Z") for r in rows)
    data = first + second
    for variant in (data, gzip.decompress(data), gzip.compress(gzip.decompress(first)) + second):
        file = Counting(variant)
        got = list(read_records(file, lambda f: f["warc-type"] == "metadata", False))
        assert [f["warc-record-id"] for f, _ in got] == ["1"]
    file = Counting(data)
    assert len(list(read_records(file, lambda f: False, True))) == 0
    assert file.got < 500_000
    whole = list(read_records(Counting(gzip.decompress(data)), lambda f: True, True))
    assert [p for _, p in whole] == [random, random]


def test_manifest_hides_leftovers_and_empty_tables(spark, archive, tmp_path):
    n = read_warc(spark, archive).count()
    record = encode_record({"record_type": "response", "record_id": "left"}, "d")
    with fs.LocalFileSystem().open_output_stream(f"{archive}/left.warc.gz", compression=None) as f:
        f.write(record)
    assert read_warc(spark, archive).count() == n
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(archive_records(empty), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).count() == 0
    assert read_warc(spark, f"{archive}/left.warc.gz").first().record_id == "left"


def test_two_writes_and_members_of_several_records(spark, tmp_path):
    import gzip

    pages = lambda ids: spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 30) for i in ids], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    write_warc(archive_records(pages([1, 2])), folder)
    write_warc(archive_records(pages([3])), folder)
    assert sorted(r.target_uri for r in read_warc(spark, folder).collect()) == ["http://a/1", "http://a/2", "http://a/3"]

    whole = b""
    for path in (tmp_path / "w").glob("*.warc.gz"):
        whole += gzip.decompress(path.read_bytes())
    one = tmp_path / "one.warc.gz"
    one.write_bytes(gzip.compress(whole) + gzip.compress(whole))
    rows = read_warc(spark, str(one))
    assert rows.count() == 6 and rows.filter("record_type = 'response'").count() == 6
    assert sorted({bytes(r.payload).decode()[:6] for r in rows.collect()}) == ["page 1", "page 2", "page 3"]
    assert read_warc(spark, str(one), fields={"WARC-Target-URI": "http://a/2"}).count() == 2
