"""WARC archives as a Spark data source: a writer with revisit records, and a reader that parses headers first."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from inkprobe.session import stage

MANIFEST = "_committed"
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, "
    "fields map<string,string>, payload_bytes long, payload binary"
)
# WARC field behind each column that a pushed predicate may name.
_FIELD_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
# Extension field: length of the full payload, also of a revisit, whose own block has none.
_LENGTH = "X-Payload-Length"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Identifier of the gzip extra subfield that holds the compressed length of a record's member.
_SKIP = b"SL"
_CHUNK = 1 << 16


def _filesystem(path: str):
    """File system and path within it; plain paths are local or on a shared mount."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# ---- one record


def _safe(value: str) -> str:
    """A field value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def encode_record(row: dict, date: str) -> bytes:
    """One record as a gzip member that states its own length, so that readers can seek past it."""
    kind, payload = row["record_type"], row.get("payload") or b""
    body = b"" if kind == "revisit" else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", date),
        ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Payload-Digest", row.get("payload_digest")),
        ("WARC-Profile", _REVISIT if kind == "revisit" else None),
        ("WARC-Refers-To", row.get("refers_to")),
        (_LENGTH, str(len(payload))),
        *sorted((dict(row.get("fields") or {})).items()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    plain = b"".join([head.encode(), http, body, b"\r\n\r\n"])
    packer = zlib.compressobj(5, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    extra = _SKIP + struct.pack("<HQ", 8, len(packed) + 8)
    return b"".join([
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", len(extra)), extra, packed,
        struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF),
    ])


def parse_fields(head: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Plain:
    """Forward reader of a file of uncompressed records."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def more(self) -> bool:
        data = self.file.read(_CHUNK)
        self.held += data
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        if have < n:
            parts.append(self.file.read(n - have))
        return b"".join(parts)

    def skip(self, n: int) -> None:
        have = min(n, len(self.held))
        self.held = self.held[have:]
        if have < n:
            self.file.seek(self.file.tell() + n - have)


class _Member(_Plain):
    """Forward reader of one gzip member; ``close`` leaves the file behind it."""

    def __init__(self, file):
        self.file, self.held, self.start = file, b"", file.tell()
        first = file.read(12)
        self.length = None
        at = self.start
        if len(first) == 12 and first[3] & 4:
            size = struct.unpack("<H", first[10:12])[0]
            extra = file.read(size)
            at = self.start + 12 + size
            if extra[:2] == _SKIP and first[3] == 4:
                self.length = struct.unpack("<Q", extra[4:12])[0]
        self.end = at + self.length if self.length is not None else None
        file.seek(self.start)
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.file.read(_CHUNK if self.end is None else min(_CHUNK, self.end - self.file.tell()))
        self.held += self.inflate.decompress(data)
        return bool(data)

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.more():
                return
        self.held = self.held[n:]

    def close(self) -> None:
        if self.end is not None:
            self.file.seek(self.end)  # nothing in between is read or inflated
            return
        while not self.inflate.eof and self.more():
            self.held = b""
        self.file.seek(self.file.tell() - len(self.inflate.unused_data))


def read_records(file, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """``fields, payload`` of the records whose fields ``wanted`` accepts; other blocks are skipped unread."""
    zipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    size = file.size()
    source = None if zipped else _Plain(file)
    while True:
        if source is None:
            if file.tell() >= size:
                return
            source = _Member(file)
        while (cut := source.held.find(b"\r\n\r\n")) < 0 and source.more():
            pass
        if cut < 0:
            if source.held.strip():
                raise ValueError("a record header has no end")
            if not zipped:
                return
            source.close()
            source = None
            continue
        fields = parse_fields(source.take(cut + 4).lstrip())
        length = int(fields.get("content-length", "0"))
        use = wanted(fields)
        if use and with_payload and fields.get("warc-type") != "revisit":
            block = source.take(length)
            if fields.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield fields, block
            length = 0
        elif use:
            yield fields, None
        if zipped and source.end is not None:  # a member of one record, whose end is known
            source.close()
            source = None
        else:  # a member may hold several records
            source.skip(length + 4)


# ---- the data source


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcDataSource(DataSource):
    """Format ``warc``. Options: ``path``; reading ``payload`` ("false" leaves payloads unread) and ``field.<Name>``
    (only records with that field value); writing ``roll_bytes`` and ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = [
            (k[len("field.") :].lower(), "in", [v]) for k, v in options.items() if k.lower().startswith("field.")
        ]

    def pushFilters(self, filters: list[Filter]):
        """Take predicates on columns that header fields give; leave the others to Spark."""
        for f in filters:
            field = _FIELD_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if field and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((field, "in", [f.value]))
            elif field and isinstance(f, In):
                self.tests.append((field, "in", [v for v in f.value if v is not None]))
            elif field and isinstance(f, StringStartsWith):
                self.tests.append((field, "starts", f.value))
            elif field and isinstance(f, IsNotNull):
                self.tests.append((field, "there", True))
            elif field and isinstance(f, IsNull):
                self.tests.append((field, "there", False))
            else:
                yield f

    def partitions(self) -> list[_File]:
        """One partition a file, of all writes to the folder. Files that a failed task left are not in the manifest, so not read."""
        from pyarrow import fs

        system, root = _filesystem(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [_File("")]
        found = [i.base_name for i in system.get_file_info(fs.FileSelector(root))]
        names = []
        for manifest in (n for n in found if n.startswith(MANIFEST)):
            with system.open_input_stream(f"{root}/{manifest}") as f:
                names += json.loads(f.read())
        if not any(n.startswith(MANIFEST) for n in found):
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        names.sort()
        return [_File(n) for n in names]

    def wanted(self, fields: dict[str, str]) -> bool:
        for field, kind, value in self.tests:
            have = fields.get(field)
            if kind == "there":
                ok = (have is not None) == value
            else:
                ok = have is not None and (have in value if kind == "in" else have.startswith(value))
            if not ok:
                return False
        return True

    def read(self, partition: _File) -> Iterator[tuple]:
        if not isinstance(partition, _File):  # what Spark reads where there is no partition
            return
        system, root = _filesystem(self.path)
        with system.open_input_file(f"{root}/{partition.path}" if partition.path else root) as file:
            for fields, payload in read_records(file, self.wanted, self.with_payload):
                named = tuple(fields.get(f) for f in _FIELD_OF.values())
                stated = fields.get(_LENGTH.lower())
                size = len(payload) if payload is not None else int(stated) if stated is not None else None
                rest = {k: v for k, v in fields.items() if k not in _FIELD_OF.values()}
                yield (*named, rest, size, payload)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll_bytes = int(options.get("roll_bytes", 256 * 1024 * 1024))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        file = None
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if file is None or file.tell() >= self.roll_bytes:
                    if file is not None:
                        file.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    file = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                file.write(encode_record(row, self.date))
        if file is not None:
            file.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.files):
            system.delete_file(f"{root}/{name}")


# ---- operators


def archive_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100
) -> DataFrame:
    """Rows for the writer: a response for each distinct payload, revisits for the others.

    Of rows with equal payloads (by SHA-256) of at least ``least_bytes`` bytes, the one with the smallest id is the
    response and the others revisit it; smaller payloads are responses all. A null payload is empty. Null ids
    come last in that order; rows that repeat the smallest id are responses too, and without any id all are.
    The ids travel as extension fields ``X-Row-Id`` and ``X-Refers-To-Row-Id``. Extra columns are ignored.

    Payloads are not shuffled if the repeated digests fit a broadcast join; beyond that, the join splits hot digests.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    repeated = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    rows = rows.join(stage(repeated.drop("n"), "repeated-payloads"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws("|", c.cast("string"), F.col("digest")), 256))
    own = F.when(F.col("id").isNotNull(), F.create_map(F.lit("X-Row-Id"), F.col("id").cast("string")))
    first = F.when(revisit, F.create_map(F.lit("X-Refers-To-Row-Id"), F.col("first").cast("string")))
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("id")).alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.map_concat(F.coalesce(own, none), F.coalesce(first, none)).alias("fields"),
        "payload",
    )


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Write records as ``.warc.gz`` files below ``path``, a folder that all executors share."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, fields: dict[str, str] | None = None) -> DataFrame:
    """Records of a ``.warc`` or ``.warc.gz`` file, or of a folder of them.

    Filters on the columns that header fields give reach the reader, which parses headers first and skips
    the blocks of other records; Spark's switch for that is turned on here. ``fields`` keeps records with these
    values of any field. Without ``payload``, no payload is read. ``payload_bytes`` is that of the full
    payload, also of a revisit, where the writer stated it.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {f"field.{k}": v for k, v in (fields or {}).items()}
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)
