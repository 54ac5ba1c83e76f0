"""Exact removal of repeated passages: every byte inside a long string that occurs earlier in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from inkprobe.llm.arrow import utf8_slices, without
from inkprobe.llm.frames import packed
from inkprobe.llm.suffixes import repeated_starts
from inkprobe.llm.wordhash import hash_runs
from inkprobe.session import stage

# Bytes of an anchor. A repeated string of ``length`` bytes has length - ANCHOR + 1 of them; the one of least hash stands for it.
ANCHOR = 32
# Bytes that one suffix array holds, but for a single larger group.
_CHUNK = 2 * 1024 * 1024
# Contexts of one anchor beyond which its strings are compared one by one by digest.
_CONTEXTS = 10_000
_SPANS = "array<struct<start:long,end:long>>"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first start, last start, place of the anchor, hash of the anchor.

    The anchor of the ``length`` bytes from a start is the leftmost of those with the least hash, so it depends on these bytes alone.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    span = length - ANCHOR + 1
    if len(data) < length:
        return none
    places = np.arange(len(data) - ANCHOR + 1)
    hashes = hash_runs(data, places, places + ANCHOR)
    least, width = hashes, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # Starts whose string lies inside a text.
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length <= ends
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    new = np.r_[True, (np.diff(starts) > 1) | (least[starts[1:]] != least[starts[:-1]]) | (ends[starts[1:]] != ends[starts[:-1]])]
    first = starts[new]
    last = starts[np.r_[np.flatnonzero(new)[1:], len(starts)] - 1]
    value = least[first]
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    windows = np.lib.stride_tricks.sliding_window_view(hashes, span)
    for _ in range(32):
        place = first + np.argmin(windows[first], axis=1)
        rows.append((first, np.minimum(last, place), place))
        more = last > place  # the same least hash occurs again behind the anchor
        first, last, value = place[more] + 1, last[more], value[more]
        if not len(first):
            break
    for a, b, v in zip(first, last, value):  # periodic texts: all places of the run at once
        ties = a + np.flatnonzero(hashes[a : b + span] == v)
        ties = ties[: np.searchsorted(ties, b) + 1]
        rows.append((np.r_[a, ties[:-1] + 1], np.minimum(ties, b), ties))
    begin, end, place = (np.concatenate(c) for c in zip(*rows))
    return begin, end, place, hashes[place]


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """``anchor, context, doc, packed``: hashes of each anchor and of all bytes of its strings, document, and start, number and offset.

    A text that the task has seen in an earlier document is left out: copies are found by digest. Of equal contexts in a batch,
    all but the first are ``settled``: whatever others hold, these repeat. They needn't meet, so their ``key`` spreads them, and a
    passage that most texts share sends one row per batch to its anchor.
    """
    names = ["anchor", "context", "doc", "packed", "settled", "key"]

    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            docs = batch.column(0).to_numpy()
            digests = batch.column(2).to_pylist()
            for digest, doc in zip(digests, docs):
                seen[digest] = min(doc, seen.get(digest, doc))
            found = []
            for first, end, data, offsets in utf8_slices(batch.column(1)):
                begin, last, place, value = anchors(data, offsets, length)
                text = np.searchsorted(offsets, begin, side="right") - 1
                doc = docs[first:end][text] if len(text) else np.zeros(0, np.int64)
                use = np.array([seen[digests[first + i]] == docs[first + i] for i in range(end - first)])[text] if len(text) else np.zeros(0, bool)
                begin, last, place, value, text, doc = (c[use] for c in (begin, last, place, value, text, doc))
                context = hash_runs(data, begin, last + length)
                packed = ((begin - offsets[text]) << 16) | ((last - begin) << 8) | (place - begin)
                found.append((value.view(np.int64), context.view(np.int64), doc.astype(np.int64), packed.astype(np.int64)))
            if found:
                value, context, doc, packed = (np.concatenate(c) for c in zip(*found))
                by = np.lexsort((packed, doc, context, value))
                value, context, doc, packed = value[by], context[by], doc[by], packed[by]
                settled = np.r_[False, (value[1:] == value[:-1]) & (context[1:] == context[:-1]) & ((doc[1:] != doc[:-1]) | (packed[1:] != packed[:-1]))][: len(value)]
                key = np.where(settled, value ^ (doc * 1_000_003 + packed), value)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (value, context, doc, packed, settled, key)], names=names)

    return rows.mapInArrow(run, "anchor long, context long, doc long, packed long, settled boolean, key long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context, document and start: all but the first of a context (``open`` false: repeated
    whole), and the first of each context of an anchor that has several (``open``: to be compared)."""
    last, pending, several = None, None, False
    names = ["anchor", "doc", "packed", "open"]
    for batch in batches:
        table = np.stack([c.to_numpy() for c in batch.columns[:4]])
        settled = batch.column(4).to_numpy(zero_copy_only=False)
        if settled.any():
            done = table[:, settled]
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[2]), pa.array(done[3]), pa.array(np.zeros(done.shape[1], bool))], names=names)
            table = table[:, ~settled]
        if not table.shape[1]:
            continue
        before = np.concatenate([table[:, :1] - 1 if last is None else last, table[:, :-1]], axis=1)
        anchor, context = table[0], table[1]
        new_anchor = anchor != before[0]
        if last is None:
            new_anchor[0] = True
        new = new_anchor | (context != before[1])
        same_place = ~new & (table[2] == before[2]) & (table[3] == before[3])
        again = table[:, ~new & ~same_place]
        firsts = table[:, new]
        out = [again]
        flags = [np.zeros(again.shape[1], bool)]
        own = firsts[0]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(own)])
        going_on = bool(len(own)) and last is not None and own[0] == last[0, 0]
        multiple = sizes > 1
        if going_on:
            multiple[0] = True
            if pending is not None:
                out.append(pending)
                flags.append(np.ones(1, bool))
        chosen = firsts[:, np.repeat(multiple, sizes)]
        out.append(chosen)
        flags.append(np.ones(chosen.shape[1], bool))
        if len(own) and not (going_on and len(starts) == 1):
            several = bool(multiple[-1])
            pending = None if several else firsts[:, -1:]
        elif going_on:
            several, pending = True, None
        last = table[:, -1:]
        found, open_ = np.concatenate(out, axis=1), np.concatenate(flags)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[2]), pa.array(found[3]), pa.array(open_)], names=names)


def _contexts(text_rows: DataFrame, length: int) -> DataFrame:
    """``anchor, doc, start, bytes`` from ``text, doc, parts`` (anchors with packed starts)."""

    def run(batches):
        for batch in batches:
            anchor, doc, start, value = [], [], [], []
            for text, own, parts in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                for part in parts.as_py():
                    begin, more = part["packed"] >> 16, (part["packed"] >> 8) & 255
                    anchor.append(part["anchor"])
                    doc.append(own.as_py())
                    start.append(begin)
                    value.append(data[begin : begin + more + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(value, pa.binary())],
                names=["anchor", "doc", "start", "bytes"],
            )

    return text_rows.mapInArrow(run, "anchor long, doc long, start long, bytes binary")


def _sort_chunks(length: int):
    """Suffix arrays over whole groups of rows sorted by anchor: spans of strings that begin at a smaller place too."""

    def spans(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        doc, begin, end = [], [], []
        for (own, start, _), hits in zip(rows, repeated_starts([r[2] for r in rows], [(r[0], r[1]) for r in rows], length)):
            if len(hits):
                cut = np.flatnonzero(np.r_[True, np.diff(hits) > 1])
                stop = np.r_[cut[1:], len(hits)] - 1
                doc += [own] * len(cut)
                begin += (start + hits[cut]).tolist()
                end += (start + hits[stop] + length).tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["doc", "start", "end"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, doc, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and size >= _CHUNK:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append((doc, start, value))
                size += len(value)
                last = anchor
        if rows:
            yield spans(rows)

    return run


def _one_by_one(contexts: DataFrame, length: int) -> DataFrame:
    """Spans for anchors with very many contexts: each string of ``length`` bytes by its digest, minima before the shuffle."""
    strings = contexts.select("doc", "start", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("i"))
    keyed = strings.select("doc", (F.col("start") + F.col("i")).alias("start"), F.md5(F.expr(f"substring(bytes, i + 1, {length})")).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = keyed.join(first, "key").filter(F.struct("doc", "start") > F.col("first"))
    return later.select("doc", "start", (F.col("start") + length).alias("end"))


ADDED = ["spans", "kept"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Add ``spans`` (byte runs ``start, end`` to remove, maximal, in order) and ``kept`` (the remaining bytes) to ``docs``.

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document of smaller id, or earlier in the same
    document. Strings overlap freely, may cut characters, never cross documents and are judged on the input.

    1. Each string is represented by one 32-byte anchor inside it, chosen by its bytes alone. Neighbouring strings share
    anchors, so a text gives about one row per 35 bytes. Rows meet by anchor.
    2. Where all bytes around an anchor are equal, all but the first occurrence repeat it whole; that settles copied passages.
    3. The different contexts of an anchor, first occurrences only, go into suffix arrays, chunk by chunk. Adjacent common prefixes
    give the strings that occur earlier. An anchor with very many contexts is settled string by string instead.
    Copies of whole texts are found by digest, so they add no rows.

    Null texts are empty; texts shorter than ``length`` stay. Rows without id are documents of their own, after all ids below 2^62 and in the order of their texts' hashes. Rows that repeat id and text are one document
    and get the same result; an id with different texts raises. Clashing columns are replaced; ``keep`` names those to return.
    """
    docs = without(docs, ADDED)
    kept = docs.columns if keep is None else keep
    if not ANCHOR <= length <= ANCHOR + 254:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + 254}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Rows without id come after all others, in the order of their texts' hashes.
    unnamed = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), unnamed)
    rows = docs.select(doc.alias("doc"), text.alias("text"))
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    long_rows = rows.filter(F.octet_length("text") >= length).withColumn("digest", digest)

    texts = stage(long_rows.select("doc", "digest", F.octet_length("text").cast("long").alias("n")).distinct(), "texts")
    if not rows.select("doc", digest.alias("digest")).distinct().groupBy("doc").count().filter("count > 1").isEmpty():
        raise ValueError(f"{id_col} has several texts")
    firsts = texts.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = texts.join(firsts, "digest").filter("doc > first").select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))

    met = _anchor_rows(long_rows.select("doc", "text", "digest"), length).repartition("key").drop("key")
    met = met.sortWithinPartitions("anchor", "context", "doc", "packed")
    found = stage(met.mapInArrow(_repeated, "anchor long, doc long, packed long, open boolean"), "repeated")
    begin, more = F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(F.lit(255))
    whole = found.filter("NOT open").select("doc", begin.alias("start"), (begin + more + length).alias("end"))

    parts = found.filter("open").groupBy("doc").agg(F.collect_list(F.struct("anchor", "packed")).alias("parts"))
    texts_of = rows.filter(F.octet_length("text") >= length).join(parts, "doc").select("text", "doc", "parts")
    contexts = stage(_contexts(texts_of, length), "contexts")
    many = stage(contexts.groupBy("anchor").count().filter(F.col("count") > _CONTEXTS).select("anchor"), "many-contexts")
    few = contexts.join(many, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    compared = few.mapInArrow(_sort_chunks(length), "doc long, start long, end long")
    if not many.isEmpty():
        compared = compared.unionByName(_one_by_one(contexts.join(many, "anchor", "left_semi"), length))

    spans = copies.unionByName(whole).unionByName(compared).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = stage(spans, "spans")
    ready = docs.select(packed(docs, kept).alias("carried"), text.alias("text"), doc.alias("doc")).join(spans, "doc", "left")
    ready = ready.select(*[F.col("carried").getField(c).alias(f"c{i}") for i, c in enumerate(kept)], "text", "spans")
    n = len(kept)
    schema = StructType([docs.schema[c] for c in kept] + [StructType.fromDDL(f"spans {_SPANS}").fields[0], StructField("kept", BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            all_spans, all_kept = [], []
            for value, own in zip(batch.column(n), batch.column(n + 1)):
                data, merged = value.as_py().encode(), []
                for s in sorted((s["start"], s["end"]) for s in own.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                edges = [0, *(e for s in merged for e in s), len(data)]
                all_spans.append([{"start": a, "end": b} for a, b in merged])
                all_kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else data)
            added = [pa.array(all_spans, span_type), pa.array(all_kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + added, names=schema.names)

    return ready.mapInArrow(cut, schema)
