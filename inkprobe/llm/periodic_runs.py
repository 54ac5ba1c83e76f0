"""Periodic runs of words: tiles for each octave of periods, solved apart, stitched by document and period."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkprobe.llm.arrow import utf8_slices
from inkprobe.llm.bloom import BloomFilter
from inkprobe.llm.frames import kept_columns, packed, unpacked
from inkprobe.llm.periods import octaves, solve_tiles
from inkprobe.llm.wordhash import NOT_BLANK, hash_runs, words
from inkprobe.session import stage

BLANKS = r"[\x20\x09-\x0D]+"
# Words up to which a text is one tile for all octaves; a longer one is cut and its tiles are dealt out to all tasks.
SPAN = 1 << 16
# Words of the tiles that are solved together.
_TOGETHER = 1 << 18
ADDED = ["runs", "collapsed"]
_RUNS = "array<struct<start:long,period:long,length:long>>"
_TILE = "key binary, low int, high int, at long, own_from long, own_to long, n long, words binary"


def _cuts(n: int, span: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Tiles of a text of ``n`` words: octaves, words, and boundaries they answer for."""
    top = octaves(n)
    if n <= span:
        yield 0, top - 1, 0, n, 0, n
        return
    shared = max(span.bit_length() - 4, 1)  # octaves whose margins are small next to a span share its tiles
    groups = [(0, min(shared, top) - 1, span)] + [(k, k, 8 << k) for k in range(shared, top)]
    for low, high, step in groups:
        margin = 2 << high
        for own in range(0, n, step):
            yield low, high, max(own - margin, 0), min(own + step + 2 * margin, n), own, min(own + step, n)


def explode_tiles(rows: DataFrame, span: int) -> DataFrame:
    """A row for each tile of each text of ``key, text`` that is long enough for a run, with the hashes of its words."""

    def run(batches):
        for batch in batches:
            for first, _, data, offsets in utf8_slices(batch.column(1)):
                starts, ends, counts = words(data, offsets, NOT_BLANK)
                hashes = hash_runs(data, starts, ends)
                place = np.r_[0, np.cumsum(counts)]
                tiles = [(i, *cut) for i in np.flatnonzero(counts >= 6) for cut in _cuts(int(counts[i]), span)]
                if not tiles:
                    continue
                doc, low, high, begin, end, own_from, own_to = (np.array(c, np.int64) for c in zip(*tiles))
                values = [hashes[a:b].tobytes() for a, b in zip(place[doc] + begin, place[doc] + end)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + first)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                        pa.array(begin), pa.array(own_from), pa.array(own_to), pa.array(counts[doc].astype(np.int64)), pa.array(values, pa.binary()),
                    ],
                    names=["key", "low", "high", "at", "own_from", "own_to", "n", "words"],
                )

    return rows.mapInArrow(run, _TILE)


def solve(tiles: DataFrame) -> DataFrame:
    """``key, period, start, stop``: stretches whose words recur one period later, clipped to each tile."""

    def run(batches):
        for batch in batches:
            numbers = [c.to_numpy().astype(np.int64) for c in batch.columns[1:7]]
            values = batch.column(7).cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
            ends = (ends - ends[0]) // 8
            first = 0
            while first < len(values):
                last = max(int(np.searchsorted(ends, ends[first] + _TOGETHER, side="right")) - 1, first + 1)
                part = ends[first : last + 1]
                tile, period, start, stop = solve_tiles(data[part[0] : part[-1]], part - part[0], *(c[first:last] for c in numbers))
                if len(tile):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(tile + first)), *(pa.array(c.astype(np.int64)) for c in (period, start, stop))],
                        names=["key", "period", "start", "stop"],
                    )
                first = last

    return tiles.mapInArrow(run, "key binary, period long, start long, stop long")


def stitch(fragments: DataFrame) -> DataFrame:
    """``key, runs``: fragments of a text and period that overlap or touch are one; a stretch counts with its smallest period."""
    before = Window.partitionBy("key", "period").orderBy("start", "stop")
    reached = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.distinct().withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = opened.withColumn("part", F.sum("new").over(before))
    whole = numbered.groupBy("key", "period", "part").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length"))
    whole = whole.filter(F.col("length") >= F.greatest(F.lit(6), 4 * F.col("period"))).repartition("key")
    smallest = whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return smallest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapse(rows: DataFrame, carried: StructField) -> DataFrame:
    """``carried, text, runs`` to ``carried, runs, collapsed``: the words that no run repeats, joined by one space."""

    def run(batches):
        for batch in batches:
            out = []
            for first, end, data, offsets in utf8_slices(batch.column(1)):
                starts, ends, counts = words(data, offsets, NOT_BLANK)
                place = np.r_[0, np.cumsum(counts)]
                raw = data.tobytes()
                for i in range(end - first):
                    change = np.zeros(counts[i] + 1, np.int64)
                    for r in batch.column(2)[first + i].as_py():
                        change[r["start"] + r["period"]] += 1
                        change[r["start"] + r["length"]] -= 1
                    stay = place[i] + np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    out.append(b" ".join(raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["carried", *ADDED])

    schema = StructType([carried, StructType.fromDDL(f"runs {_RUNS}").fields[0], StructField("collapsed", StringType())])
    return rows.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, span: int = SPAN) -> DataFrame:
    """Add ``runs`` and ``collapsed`` to ``docs``: all maximal periodic stretches of words, and the text without what they repeat.

    Words are what blanks part. A run is a stretch with smallest period q of at least 6 and 4 q words that no neighbouring word extends. ``runs`` are ordered
    by start, then period; ``collapsed`` has the words that no run holds after its first q ones, joined by one space.

    1. Each text is exploded into tiles, overlapping by what the periods of an octave need. A text of up to ``span`` words is one tile for all octaves,
    solved where it was read. A longer one is cut, octave by octave, and its tiles are dealt out, so that no task holds more of it than the octave asks for
    (the largest period is a quarter of the text, and its tile is all of it).
    2. Tiles are solved apart, with the Z values of their boundaries, in about n/2 comparisons an octave.
    3. Fragments are shuffled by document and period and stitched. They are few: a fragment is periodic over two periods.
    4. A bounded Bloom filter of the texts with runs lets the others pass straight through; only the former are shuffled to meet their runs.

    A null text is empty and has no runs. Rows that repeat id and text get the same result. Words are compared by 64-bit hashes. Columns that clash with the
    added ones are replaced; ``keep`` names those to return. An empty table gives an empty result.
    """
    kept = kept_columns(docs, keep, ADDED)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(packed(docs, kept).alias("carried"), F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce("id", F.lit("-")), F.lit("|"), F.col("text"))))).drop("id")
    short = F.octet_length("text") <= 2 * span  # n words take 2 n - 1 bytes at least
    few = explode_tiles(rows.filter(short).select("key", "text"), span)
    cut = explode_tiles(rows.filter(~short).select("key", "text"), span).repartition("key", "low", "at")
    runs = stage(stitch(solve(few.unionByName(cut))), "runs").withColumn("hash", F.xxhash64("key"))

    marked = BloomFilter(runs, "hash", runs.count()).mark(rows.withColumn("hash", F.xxhash64("key")), "hash", "maybe")
    plain = F.trim(F.regexp_replace("text", BLANKS, " "))
    alone = marked.filter("NOT maybe").select("carried", F.array().cast(_RUNS).alias("runs"), plain.alias("collapsed"))
    met = marked.filter("maybe").select("carried", "text", "key").join(runs.select("key", "runs"), "key", "left")
    met = met.select("carried", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    return unpacked(alone.unionByName(_collapse(met, rows.schema["carried"])), "carried", kept, ADDED)
