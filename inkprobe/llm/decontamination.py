"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from inkprobe.llm.arrow import without

# Byte table of the normal form: A-Z in lower case; digits, letters and bytes from 0x80 on are word bytes, the rest blanks.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Normalised bytes that the automaton scans at once; pieces overlap by the longest pattern.
_PIECE = 4 * 1024 * 1024

ADDED = ["n_words", "n_hit", "items", "spans"]
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(_SPAN)),
]

_automata: dict[str, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8 bytes."""
    return (text or "").encode().translate(_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words; a shorter text that has words is one run."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """Finds the windows of test items in texts."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        """``items``: id and windows of each test item."""
        import ahocorasick

        holders: dict[bytes, set] = {}
        for item, windows in items:
            for window in windows:
                holders.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        self.longest = 0
        for window, ids in holders.items():
            # Blanks at both ends make matches begin and end with words; latin-1 keeps one character per byte.
            pattern = f" {window.decode('latin-1')} "
            self.longest = max(self.longest, len(pattern))
            self.automaton.add_word(pattern, (len(pattern), window.count(b" ") + 1, sorted(i for i in ids if i is not None)))
        self.empty = not holders
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, list[str], list[dict]]:
        """Words, words hit, ids of items found, and the hit runs as character spans of the text."""
        raw = np.frombuffer(text.translate(_TABLE), np.uint8)
        is_word = np.zeros(len(raw) + 2, bool)
        is_word[1:-1] = raw != 32
        starts = np.flatnonzero(is_word[1:] & ~is_word[:-1])
        if self.empty or not len(starts):
            return len(starts), 0, [], []
        # A blank after a word stays, any other goes: words are joined by one blank.
        body = raw[(is_word[1:-1] | is_word[:-2])[: len(raw)]]
        flat = b" " + body.tobytes() + b" "
        found, hit, at = set(), None, None
        for begin in range(0, len(flat), _PIECE):
            piece = flat[begin : begin + _PIECE + self.longest].decode("latin-1")
            for end, (length, n, ids) in self.automaton.iter(piece):
                if hit is None:
                    hit = np.zeros(len(starts) + 1, bool)
                    blank = np.frombuffer(flat, np.uint8) == 32
                    at = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
                first = int(np.searchsorted(at, begin + end - length + 2))
                hit[first : first + n] = True
                found.update(ids)
        if hit is None:
            return len(starts), 0, [], []
        ends = np.flatnonzero(is_word[:-1] & ~is_word[1:])
        char_at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8)])))
        spans = [
            {"start": int(char_at[starts[a]]), "end": int(char_at[ends[b - 1]])} for a, b in zip(edges[::2], edges[1::2])
        ]
        return len(starts), int(hit.sum()), sorted(found), spans


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """Add ``n_words, n_hit, items, spans`` to ``docs``: what each text shares with test items.

    A window is ``window`` consecutive words of an item; a shorter item is one window. A word of a text is
    hit if it lies inside an occurrence of a window. ``items`` are the ids of items with an occurring
    window, sorted as strings; ``spans`` are the runs of hit words as character offsets of the original text.

    The items are normalised, put into blocks of about ``block_bytes`` and broadcast block by block as one
    automaton each, so no broadcast outgrows a block; usual test sets are one block. Texts are never shuffled.

    Null and empty texts have no words. An item without words has no window; an item without id can hit but
    isn't listed. Repeated rows each get their own result. Columns of ``docs`` named like an added one are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = without(docs, ADDED)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).distinct().collect()
        patterns = spark.sparkContext.broadcast([(r.item, windows_of(normal_words(r.text), window)) for r in rows])
        out = _scan(out, text_col, patterns, f"{uuid.uuid4().hex}", first=block == 0)
    return out


def _scan(docs: DataFrame, text_col: str, patterns, key: str, first: bool) -> DataFrame:
    at = docs.columns.index(text_col)
    old = [f for f in docs.schema.fields if f.name not in ADDED or first]
    schema = StructType(old + _FIELDS)
    kept = len(old)

    def run(batches):
        if key not in _automata:
            _automata.clear()
            _automata[key] = (Scanner(patterns.value),)
        scanner = _automata[key][0]
        for batch in batches:
            results = [scanner.scan((t.as_py() or "").encode()) for t in batch.column(at)]
            if not first:  # merge with what earlier blocks found
                results = [_merged(t, r, e) for t, r, e in zip(batch.column(at), results, batch.to_pylist())]
            added = [pa.array([r[i] for r in results], type=t) for i, t in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays(batch.columns[:kept] + added, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _merged(text, new: tuple, row: dict) -> tuple:
    """Union of the hits of two scans of the same text."""
    spans = sorted([*new[3], *row["spans"]], key=lambda s: s["start"])
    joined: list[dict] = []
    value = text.as_py() or ""
    for span in spans:
        # Spans that only blanks separate are one run of words.
        if joined and not normal_words(value[joined[-1]["end"] : span["start"]]):
            joined[-1]["end"] = max(joined[-1]["end"], span["end"])
        else:
            joined.append(dict(span))
    hit = sum(len(normal_words(value[s["start"] : s["end"]])) for s in joined)
    return new[0], hit, sorted({*new[2], *row["items"]}), joined
