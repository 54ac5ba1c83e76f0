"""Collocations: phrases whose words stand together more often than their parts would."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from inkprobe.llm.arrow import utf8_slices
from inkprobe.llm.misra_gries import Summary, pack, summed, unpack
from inkprobe.llm.wordhash import LOWER, hash_runs, mix64, words
from inkprobe.operators.lookup import skew_safe_join
from inkprobe.session import stage

# Bytes that end a piece, and bytes that part words.
_ENDS = np.array([b in b".,;:!?" or 10 <= b <= 13 for b in range(256)])
_WORD = np.array([not (b in b" \t.,;:!?" or 10 <= b <= 13) for b in range(256)])
# Occurrences that a task sums up before it sends a summary.
_TOGETHER = 1 << 21
# Counters that a summary of one hash partition should have.
_COUNTERS = 200_000
# Bits of the filter of the second pass for each survivor, and at most: 64 MB.
_BITS_PER_KEY, _MOST_BITS = 32, 1 << 29
_BLOCK = 32_768  # bits of a bitmap that ``bitmap_construct_agg`` builds
# Phrases whose texts a task of the second pass holds.
_PHRASES = 300_000
# Parts of a group that are ranked apart before the first ones of all meet.
_PARTS = 64


def _occurrences(groups: pa.Array, texts: pa.Array, longest: int) -> Iterator[tuple]:
    """Of each slice: bytes in lower case, starts and ends of words, group of each word, and ``hash, first word`` of the phrases of each length."""
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 3, 1 << 64)) for k in range(longest)]
    names = groups.dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in names.dictionary.to_pylist()], np.uint64)
    codes = names.indices.to_numpy()
    for first, end, data, offsets in utf8_slices(texts):
        low = LOWER[data]
        starts, ends, counts = words(data, offsets, _WORD)
        if not len(starts):
            continue
        hashes = hash_runs(low, starts, ends)
        group = np.repeat(codes[first:end], counts)
        piece = np.cumsum(_ENDS[data])[starts] + np.repeat(np.arange(end - first), counts)  # both grow: equal only within a piece
        total, phrases = seeds[group], []
        for k in range(longest):
            if len(hashes) <= k:
                break
            total = total[: len(hashes) - k] + hashes[k:] * factors[k]
            inside = np.flatnonzero(piece[k:] == piece[: len(piece) - k])
            phrases.append((mix64(total[inside] ^ np.uint64(k)), inside))
        yield low, starts, ends, group, names.dictionary, phrases


def _summaries(rows: DataFrame, longest: int, parts: int) -> DataFrame:
    """Summaries of what each task has seen, a row for each hash partition, and before all of them its masses."""

    def run(batches):
        waiting, held = [], 0

        def send():
            hashes = np.concatenate(waiting)
            part = (hashes >> np.uint64(32)) % np.uint64(parts)
            values, counts = summed((part << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
            own = (values >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            stops = np.r_[at[1:], len(own)]
            short = values.astype(np.uint32)
            mass = np.add.reduceat(counts, at)
            n = len(at)
            for data, size, more in (([None] * n, np.zeros(n, np.int64), mass), ([pack(short[a:b], counts[a:b]) for a, b in zip(at, stops)], stops - at, mass * 0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at].astype(np.int32)), pa.array(size), pa.array(more), pa.array(data, pa.binary())], names=["part", "size", "mass", "data"]
                )

        for batch in batches:
            for *_, phrases in _occurrences(batch.column(0), batch.column(1), longest):
                waiting += [h for h, _ in phrases]
                held += sum(len(h) for h, _ in phrases)
                if held >= _TOGETHER:
                    yield from send()
                    waiting, held = [], 0
        if held:
            yield from send()

    return rows.mapInArrow(run, "part int, size long, mass long, data binary")


def _survivors(summaries: DataFrame, threshold: int) -> DataFrame:
    """``part, value`` of all hashes that may have ``threshold`` occurrences."""

    def run(batches):
        part, mass, summary = None, 0, None

        def done():
            if summary is not None:
                values = summary.heavy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), part, np.int32)), pa.array(values)], names=["part", "value"])

        for batch in batches:
            for own, size, more, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if own != part:
                    yield from done()
                    part, mass, summary = own, 0, None
                if size == 0:
                    mass += more
                else:
                    summary = summary or Summary(mass, threshold)
                    summary.add(*unpack(data.as_py(), size))
        yield from done()

    return summaries.mapInArrow(run, "part int, value long")


def _filter_bits(heavy: DataFrame, parts: int, longest: int) -> np.ndarray:
    """One bit for each survivor in at most 64 MB, which goes through the driver to all tasks."""
    count = heavy.count()
    bits = min(_MOST_BITS, max(_BLOCK, 1 << max(count * _BITS_PER_KEY - 1, 0).bit_length()))
    place = F.col("value") * parts + F.col("part")
    blocks = heavy.select(F.pmod(place, F.lit(bits)).alias("place"))
    blocks = blocks.groupBy(F.floor(F.col("place") / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(_BLOCK))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _counts(rows: DataFrame, longest: int, parts: int, bits: np.ndarray) -> DataFrame:
    """``group, phrase, count`` of the phrases that pass the filter; the empty phrase counts all words."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        filter_ = shared.value
        known, counts, texts, groups = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object)
        totals: dict[str, int] = {}

        def batch_of(groups, phrases, counts):
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], names=["grp", "phrase", "count"])

        for batch in batches:
            for low, starts, ends, group, names, phrases in _occurrences(batch.column(0), batch.column(1), longest):
                raw, all_names = low.tobytes(), names.to_pylist()
                for code, n in zip(*np.unique(group, return_counts=True)):
                    totals[all_names[code]] = totals.get(all_names[code], 0) + int(n)
                hits, first, last = [], [], []
                for k, (hashes, at) in enumerate(phrases):
                    place = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(parts) + (hashes >> np.uint64(32)) % np.uint64(parts)) % np.uint64(8 * len(filter_))
                    use = np.flatnonzero((filter_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                    hits.append(hashes[use])
                    first.append(at[use])
                    last.append(at[use] + k)
                hits, first, last = (np.concatenate(c) for c in (hits, first, last))
                by = np.argsort(hits, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(hits[by]) != 0]) if len(by) else by
                own, one, n = hits[by][cut], by[cut], np.diff(np.r_[cut, len(by)])
                spot = np.searchsorted(known, own)
                old = spot < len(known)
                old[old] = known[spot[old]] == own[old]
                counts[spot[old]] += n[old]
                one = one[~old]
                a, b = first[one], last[one]
                text = [raw[s:e].decode() for s, e in zip(starts[a].tolist(), ends[b].tolist())]
                # Words with anything but one space between them are joined anew.
                inner = np.r_[0, np.cumsum(ends - starts)]
                odd = np.flatnonzero((ends[b] - starts[a] != inner[b + 1] - inner[a] + b - a))
                for i in odd.tolist():
                    text[i] = " ".join(raw[starts[w] : ends[w]].decode() for w in range(a[i], b[i] + 1))
                text = [t.replace("\t", " ") for t in text]
                new = np.array(all_names, object)[group[a]]
                merged = np.r_[known, own[~old]]
                order = np.argsort(merged, kind="stable")
                known, counts = merged[order], np.r_[counts, n[~old]][order]
                texts = np.concatenate([texts, np.array(text, object)])[order]
                groups = np.concatenate([groups, new])[order]
                if len(known) > _PHRASES:
                    yield batch_of(groups, texts, counts)
                    known, counts, texts, groups = known[:0], counts[:0], texts[:0], groups[:0]
        if len(known):
            yield batch_of(groups, texts, counts)
        if totals:
            yield batch_of(list(totals), [""] * len(totals), list(totals.values()))

    return rows.mapInArrow(run, "grp string, phrase string, count long")


def frequent_phrases(docs: DataFrame, group_col: str = "lang", text_col: str = "text", threshold: int = 100, longest: int = 5) -> DataFrame:
    """``grp, phrase, f``: every phrase of up to ``longest`` words with ``threshold`` occurrences or more, and the empty phrase with the number of all words.

    First pass: phrases are hashed into hash partitions, and each of these gets one Misra-Gries summary, merged from those of all tasks.
    Its capacity exceeds the partition's mass divided by the threshold, so every frequent phrase survives. Second pass: occurrences that a bounded filter of
    the survivors lets through are counted exactly, by their texts. The number of hash partitions grows with the input, so a summary stays small.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * tasks, -(-size * longest // (2 * threshold * _COUNTERS)))
    met = _summaries(rows, longest, parts).repartition(F.col("part")).sortWithinPartitions("part", "size")
    heavy = stage(_survivors(met, threshold), "survivors")
    bits = _filter_bits(heavy, parts, longest)
    counted = _counts(rows, longest, parts, bits).groupBy("grp", "phrase").agg(F.sum("count").alias("f"))
    return counted.filter((F.col("f") >= threshold) | (F.col("phrase") == ""))


def collocations(
    docs: DataFrame, group_col: str = "lang", text_col: str = "text", threshold: int = 100, longest: int = 5, contained: int = 100
) -> DataFrame:
    """``grp, phrase, a, l, r, n, score`` of the phrases of 2 to ``longest`` words with ``threshold`` occurrences or more in a group of texts.

    A-Z are lower-cased; ``.,;:!?`` and line ends part pieces, blanks part words, and phrases lie within pieces. ``a`` counts the phrase, ``n`` all words of the
    group; a cut gives ``l`` and ``r``, the counts of both sides, and floor(1000 a n / (l r)), in exact decimals. The cut of the lowest score stands, at a tie the
    one of the shortest first side. Phrases inside a longer one that has at least ``contained`` per cent of their occurrences go.

    A null group is ``und``, a null text is empty. Repeated rows count each time. Texts of any length are counted whole; words are told
    apart by 64-bit hashes within a task and by their texts across tasks. An empty table gives no rows.
    """
    found = stage(frequent_phrases(docs, group_col, text_col, threshold, longest), "phrases")
    totals = found.filter("phrase = ''").select("grp", F.col("f").alias("n"))
    found = found.filter("phrase <> ''")
    ready = found.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).filter("k >= 2")

    cuts = ready.select("grp", "phrase", F.explode(F.expr("transform(sequence(1, k - 1), c -> struct(c, array_join(slice(words, 1, c), ' ') AS l, array_join(slice(words, c + 1, k - c), ' ') AS r))")).alias("cut"))
    sides = stage(
        cuts.select("grp", "phrase", F.col("cut.c").alias("cut"), F.explode(F.expr("array(struct(true AS left, cut.l AS part), struct(false AS left, cut.r AS part))")).alias("side"))
        .select("grp", "phrase", "cut", "side.left", "side.part"),
        "sides",
    )
    uses = sides.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("uses"))
    keyed = stage(found.withColumnRenamed("phrase", "part").join(uses, ["grp", "part"]), "parts")
    both = skew_safe_join(sides, keyed, ["grp", "part"]).groupBy("grp", "phrase", "cut").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    counted = stage(both.join(ready.select("grp", "phrase", F.col("f").alias("a")), ["grp", "phrase"]), "cuts")
    sizes = totals.join(counted.groupBy("grp").agg(F.count(F.lit(1)).alias("uses")), "grp")
    number = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        skew_safe_join(counted, stage(sizes, "totals"), ["grp"])
        .withColumns({"above": number("a") * 1000 * number("n"), "below": number("l") * number("r")})
        .withColumn("score", F.expr("above DIV below"))
    )
    lowest = scored.groupBy("grp", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))

    inner = ready.filter("k >= 3").select("grp", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"))
    around = inner.groupBy("grp", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(around, ["grp", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("x.a")))
    return kept.select("grp", "phrase", *[F.col(f"x.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best phrases of each group with their ``rank``: by score and count from the top, then by phrase.

    Parts of a group are ranked apart first, so the task that ranks a group gets ``most`` rows of each part.
    """
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    parted = parted.withColumn("place", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*best))).filter(F.col("place") <= most)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= most).drop("part", "place")
