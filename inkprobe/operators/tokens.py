"""Tokens, vocabulary, positions, masking draws.

Token ids: 0 is ``<unk>``; 1..V-1 are the tokens by falling frequency; V, V+1 and V+2 are the
text start, the text end and the mask. V counts the predictable tokens only. Text start and
end are null neighbours until they are encoded: no string stands for them, as any string may
occur in a text.

Where only equality counts, as in the count models, a token is its 64-bit hash instead: no
dictionary is joined. ``distinct_tokens`` counts the hashes and raises if two tokens share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from inkprobe.functions.keys import DRAW_DIGITS, DRAWS_PER_DIGEST, draw_digest, draw_number, share_bound
from inkprobe.functions.text import words
from inkprobe.operators.sampling import number_in_ranges
from inkprobe.session import stage

UNKNOWN = 0
# Neighbour id that stands for "not looked at" (marginalised out).
ANY = -1

# Of a vocabulary, the most frequent tokens are shipped to every task: as rows of a join, or as 12 bytes each (48 MB at most) of a
# sorted table. All others are joined by shuffle.
BROADCAST_TOKENS = 300_000
ENCODED_TOKENS = 4_000_000


# Hashed tokens: what stands for the ends of a text. Like UNKNOWN and ANY, no token may have such a hash.
START_HASH, END_HASH = -2, -3
_RESERVED = (UNKNOWN, ANY, START_HASH, END_HASH)


def start_id(vocab_size: int) -> int:
    return vocab_size


def end_id(vocab_size: int) -> int:
    return vocab_size + 1


def mask_id(vocab_size: int, has_mask: bool = True) -> int:
    """Id of the mask symbol; the last vocabulary id where a vocabulary has none."""
    return vocab_size + 2 if has_mask else vocab_size - 1


def tokenize(df: DataFrame, max_length: int | None = None, text_col: str = "text") -> DataFrame:
    """Add ``tokens array<string>``; a text is kept whole unless ``max_length`` cuts it."""
    tokens = words(F.col(text_col))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max_length)
    return df.withColumn("tokens", tokens)


def explode_tokens(tokenized: DataFrame, keep: list[str]) -> DataFrame:
    """Long table ``keep, pos, token`` (``pos`` from 0).

    The outer form with a filter after it, here and below: the plain form makes the
    optimizer test ``size(tokens) > 0`` at the scan, which tokenizes every text again.
    """
    flat = tokenized.select(*keep, F.posexplode_outer("tokens").alias("pos", "token"))
    return flat.filter(F.col("token").isNotNull())


def clamp_ids(column: Column, vocab_size: int) -> Column:
    """Ids forced into 0..V-1."""
    return F.greatest(F.lit(0), F.least(F.lit(vocab_size - 1), column))


def token_counts(tokenized: DataFrame) -> DataFrame:
    """Uses of each token, counted map-side before the shuffle."""
    flat = tokenized.select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokenized: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """``token, token_id`` of all tokens, or of the V-1 most frequent ones, by falling count (ties by token).

    The counts are numbered range by range, so no task sorts them all.
    """
    numbered = number_in_ranges(token_counts(tokenized), [F.desc("n"), F.col("token")], "token_id")
    ids = numbered.select("token", F.col("token_id").cast("int").alias("token_id"))
    return ids if vocab_size is None else ids.filter(F.col("token_id") < vocab_size)


def sized_vocabulary(tokenized: DataFrame, vocab_size: int | None = None) -> tuple[DataFrame, int]:
    """The staged vocabulary and V: its tokens and ``<unk>``."""
    vocab = stage(vocabulary(tokenized, vocab_size), "vocabulary")
    return vocab, vocab_size if vocab_size is not None else vocab.count() + 1


def encode(df: DataFrame, vocab: DataFrame, vocab_size: int, columns: list[str]) -> DataFrame:
    """Replace token columns by ``<column>_id`` columns; a null is the text start in ``left``, else the text end.

    Tokens are looked up by hash, all columns in one pass, in one sorted table of the most frequent tokens: 12 bytes each, of bounded size. Only
    where the vocabulary has others, rows that hold one are joined by shuffle, as numbers; a token of
    rank r holds at most 1/r of the counted tokens, so no key of that join is hot.
    """
    known = vocab.select(F.xxhash64("token").alias("hash"), "token_id")
    if not known.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a token hash stands for more than one token of the vocabulary")
    near = known.filter(F.col("token_id") <= ENCODED_TOKENS).toArrow()
    far = known.filter(F.col("token_id") > ENCODED_TOKENS)
    all_near = far.isEmpty()
    hashes, numbers = near["hash"].to_numpy(), near["token_id"].to_numpy()
    order = np.argsort(hashes)
    table = df.sparkSession.sparkContext.broadcast((hashes[order], numbers[order].astype(np.int32)))
    ends = {c: start_id(vocab_size) if c == "left" else end_id(vocab_size) for c in columns}
    others = [c for c in df.columns if c not in columns]

    def run(batches):
        hashes, numbers = table.value
        for batch in batches:
            out = [batch.column(c) for c in others]
            for c in columns:
                null = batch.column(c).is_null().to_numpy(zero_copy_only=False)
                token = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(hashes, token), max(len(hashes) - 1, 0))
                hit = hashes[at] == token if len(hashes) else np.zeros(len(token), bool)
                found = np.where(hit, numbers[at], UNKNOWN) if len(hashes) else np.full(len(token), UNKNOWN)
                out.append(pa.array(np.where(null, ends[c], found).astype(np.int32)))
                if not all_near:
                    out.append(pa.array(token, mask=null | hit))
            yield pa.RecordBatch.from_arrays(out, names=names)

    # ``<column>_far`` is the hash of a token that is not in the table.
    kinds = [*((f"{c}_id", "int") for c in columns)] if all_near else [f for c in columns for f in ((f"{c}_id", "int"), (f"{c}_far", "bigint"))]
    names = [*others, *(n for n, _ in kinds)]
    schema = StructType([*(df.schema[c] for c in others), *(StructField(n, LongType() if t == "bigint" else IntegerType()) for n, t in kinds)])
    hash_of = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in columns]
    coded = df.select(*others, *hash_of).mapInArrow(run, schema)
    if all_near:
        return coded
    # Both branches read the staged numbers, so the texts are tokenized once.
    coded = stage(coded, "encoded")
    settled = reduce(lambda a, b: a & b, [F.col(f"{c}_far").isNull() for c in columns])
    rest = coded.filter(~settled)
    for c in columns:
        # Where this column is settled, any number spreads the rows.
        rest = rest.withColumn("_key", F.coalesce(F.col(f"{c}_far"), F.monotonically_increasing_id()))
        rest = rest.join(far.select(F.col("hash").alias("_key"), F.col("token_id").alias("_id")), "_key", "left")
        rest = rest.withColumn(f"{c}_id", F.when(F.col(f"{c}_far").isNotNull(), F.coalesce("_id", F.lit(UNKNOWN))).otherwise(F.col(f"{c}_id"))).drop("_key", "_id")
    kept = [*others, *(f"{c}_id" for c in columns)]
    return coded.filter(settled).select(*kept).unionByName(rest.select(*kept))


def hashed(tokenized: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, tokens array<bigint>, checks array<int>``: the hash of every token, and a second one to tell collisions."""
    return tokenized.select(
        *keep, F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), F.transform("tokens", lambda t: F.hash(t)).alias("checks")
    )


def distinct_tokens(hashes: DataFrame) -> tuple[int, int]:
    """Numbers of different tokens and of all tokens of ``tokens, checks``; raises if two tokens share a hash, or one has a reserved value."""
    both = hashes.select(F.explode_outer(F.arrays_zip("tokens", "checks")).alias("at")).filter(F.col("at.tokens").isNotNull())
    each = both.groupBy(F.col("at.tokens").alias("token")).agg(F.min("at.checks").alias("low"), F.max("at.checks").alias("high"), F.count(F.lit(1)).alias("uses"))
    clash = (F.col("low") != F.col("high")) | F.col("token").isin(*_RESERVED)
    n, total, clashes = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("uses"), F.lit(0)), F.count_if(clash)).first()
    if clashes:
        raise ValueError(f"{clashes} token hashes stand for more than one token")
    return n, total


def known_hashes(vocab: DataFrame) -> DataFrame:
    """``token`` (a hash) and ``token_id`` of a vocabulary."""
    return vocab.select(F.xxhash64("token").alias("token"), "token_id")


def hide_unknown(df: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Hashes that are not among ``known`` become ``UNKNOWN``; reserved values stay.

    The most frequent tokens are looked up map-side in a table of bounded size, and only what is not among them is shuffled to the rest.
    """
    near = known.filter(F.col("token_id") <= BROADCAST_TOKENS)
    far = known.filter(F.col("token_id") > BROADCAST_TOKENS)
    all_near = far.isEmpty()
    for column in columns:
        named = lambda table, c=column: table.select(F.col("token").alias(c), F.lit(True).alias("_known"))
        found = df.join(F.broadcast(named(near)), column, "left")
        settled = F.col("_known").isNotNull() | F.col(column).isin(*_RESERVED)
        if not all_near:
            rest = found.filter(~settled).drop("_known").join(named(far), column, "left")
            found = found.filter(settled).unionByName(rest)
        df = found.withColumn(column, F.when(settled, F.col(column)).otherwise(F.lit(UNKNOWN).cast("bigint"))).drop("_known")
    return df


def _shifted(items: Column, before, after) -> tuple[Column, Column]:
    """The array moved by one place to either side, its open end filled."""
    rest = F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))
    of = items if before is None else items.cast("array<bigint>")
    kind = "array<string>" if before is None else "array<bigint>"
    return F.concat(F.array(F.lit(before)).cast(kind), of), F.concat(rest.cast(kind), F.array(F.lit(after)).cast(kind))


def spots(tokenized: DataFrame, keep: list[str], arrays: dict[str, Column]) -> DataFrame:
    """One row per token: ``keep, size, pos`` and one column per array."""
    size = F.size("tokens")
    zipped = F.slice(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()]), 1, F.greatest(size, F.lit(1)))
    flat = tokenized.withColumn("size", size).select(
        *keep, "size", F.posexplode_outer(F.when(size > 0, zipped)).alias("pos", "at")
    )
    return flat.filter(F.col("pos").isNotNull()).select(*keep, "size", "pos", *[f"at.{n}" for n in arrays])


def neighbours(tokenized: DataFrame, keep: list[str], ends: tuple = (None, None)) -> DataFrame:
    """One row per token with its neighbours: ``keep, size, pos, left, token, right``; ``ends`` stand before and after a text.

    Neighbours come from shifted copies of the array inside the row: no window, no
    shuffle, and the order of tokens never depends on the order of rows.
    """
    left, right = _shifted(F.col("tokens"), *ends)
    return spots(tokenized, keep, {"left": left, "token": F.col("tokens"), "right": right})


def shift_targets(positions: DataFrame) -> DataFrame:
    """Next-token view: rows from the second token on, predicted from ``left``."""
    return positions.filter(F.col("pos") >= 1)


# ---- Monte Carlo masking. All draws of a text are made inside its row.

def draw_digests(seed: int, num_samples: int, text_key: str = "text_id") -> Column:
    """Array with the random numbers of every position of the text."""
    size = F.size("tokens")
    digest = lambda pos: draw_digest(seed, num_samples, F.col(text_key), pos)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), digest)).otherwise(
        F.array().cast("array<string>")
    )


def _raised_bounds(digests: Column, bound: str, draws: range) -> Column:
    """Per draw the bound, raised to the smallest number of the text where it masks nothing."""

    def of(draw: int) -> Column:
        number = lambda digest: draw_number(digest, draw)
        smallest = F.concat(F.array_min(F.transform(digests, number)), F.lit("0"))
        return F.when(F.exists(digests, lambda d: number(d) < bound), F.lit(bound)).otherwise(smallest)

    return F.array(*[of(draw) for draw in draws])


# Draws per mask word: one bit each in a bigint.
_WORD = 60


def _words(num_samples: int) -> list[range]:
    return [range(first, min(first + _WORD, num_samples)) for first in range(0, num_samples, _WORD)]


def with_mask_bits(drawn: DataFrame, name: str, mask_ratio: float, draws: range) -> DataFrame:
    """Add array ``name``: for each position a bigint whose bit i says "masked in draw i".

    Each draw masks at least one position of a text: where the plain bound masks none, the
    position with the smallest number is taken.
    """
    digests, bound = F.col("digests"), share_bound(mask_ratio)
    full = F.lit(2 ** len(draws) - 1).cast("bigint")

    def bits(limit) -> Column:
        def of(digest: Column) -> Column:
            word = F.lit(0).cast("bigint")
            for i, draw in enumerate(draws):
                hit = draw_number(digest, draw) < limit(i)
                word = word + F.when(hit, F.lit(2**i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            return word

        return F.transform(digests, of)

    plain, raised = f"{name}_plain", f"{name}_raised"
    covered = F.aggregate(plain, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)) == full
    return (
        drawn.withColumn(plain, bits(lambda _: F.lit(bound)))
        .withColumn(raised, F.when(~covered, _raised_bounds(digests, bound, draws)))
        .withColumn(name, F.when(F.col(raised).isNull(), F.col(plain)).otherwise(bits(lambda i: F.get(F.col(raised), i))))
        .drop(plain, raised)
    )


def mask_draws(
    tokenized: DataFrame, mask_ratio: float, num_samples: int, seed: int, text_key: str = "text_id"
) -> DataFrame:
    """``text, pos, draw, token, left_masked, right_masked`` of every masked position.

    Each draw masks a position with probability ``mask_ratio``, and at least one position
    of a text that has any. The choice is a pure function of (seed, draw, text, position),
    so a retried task repeats it, and no row leaves its partition.
    """
    drawn = tokenized.withColumn("digests", draw_digests(seed, num_samples, text_key))
    parts = []
    for draws in _words(num_samples):
        before, after = _shifted(F.col("bits"), 0, 0)
        arrays = {"token": F.col("tokens"), "own": F.col("bits"), "before": before, "after": after}
        places = spots(with_mask_bits(drawn, "bits", mask_ratio, draws), [text_key], arrays)
        bit = lambda side: F.expr(f"shiftright({side}, i)").bitwiseAND(F.lit(1).cast("bigint")) == 1
        each = places.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(draws) - 1)))).filter(bit("own"))
        parts.append(
            each.select(
                text_key, "pos", (F.col("i") + draws[0]).alias("draw"), "token",
                bit("before").alias("left_masked"), bit("after").alias("right_masked"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def folded_draws(
    tokenized: DataFrame, grid: list[tuple[float, int]], seed: int, keep: list[str], text_key: str = "text_id", ends: tuple = (None, None)
) -> DataFrame:
    """The draws of all settings, folded to the contexts they show: one row per position that any draw masks.

    However many draws there are, a position is only ever seen with its left neighbour
    masked or not and its right neighbour masked or not: four variants at most. Each
    is an element of ``variants`` with one weight per (mask_ratio, num_samples) setting, ``w0, w1, ...``:
    the sum of ``1 / (num_samples * masked positions of the draw)`` over the draws showing
    it. The mean over draws of each draw's mean is then one weighted sum per text.
    """
    drawn = tokenized.withColumn("digests", draw_digests(seed, max(samples for _, samples in grid), text_key))
    left, right = _shifted(F.col("tokens"), *ends)
    arrays = {"left": left, "token": F.col("tokens"), "right": right}
    words: list[tuple[int, range, str]] = []
    for s, (ratio, samples) in enumerate(grid):
        for draws in _words(samples):
            name = f"bits{s}_{draws[0]}"
            drawn = with_mask_bits(drawn, name, ratio, draws)
            words.append((s, draws, name))
            bits = F.col(name)

            def share(i: int, samples: int = samples, bits: Column = bits) -> Column:
                set_bit = lambda b: F.shiftright(b, i).bitwiseAND(F.lit(1).cast("bigint"))
                masked = F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, b: n + set_bit(b))
                return F.lit(1.0) / (masked * samples)

            drawn = drawn.withColumn(f"share_{name}", F.when(F.size(bits) > 0, F.array(*[share(i) for i in range(len(draws))])))
            before, after = _shifted(bits, 0, 0)
            arrays |= {name: bits, f"before_{name}": before, f"after_{name}": after}
    places = spots(drawn, [text_key, *keep, *[f"share_{name}" for _, _, name in words]], arrays)

    def shown(code: int, name: str) -> Column:
        """Mask bits of the draws that show the position in this variant."""
        side = lambda n, on: F.col(n) if on else F.bitwise_not(F.col(n))
        return F.col(name).bitwiseAND(side(f"before_{name}", code & 1)).bitwiseAND(side(f"after_{name}", code & 2)).alias(name)

    def weight(variant: Column, s: int) -> Column:
        total = F.lit(0.0)
        for setting, draws, name in words:
            if setting == s:
                for i in range(len(draws)):
                    on = F.shiftright(variant[name], i).bitwiseAND(F.lit(1).cast("bigint"))
                    total = total + on * F.get(F.col(f"share_{name}"), F.lit(i))
        return total.alias(f"w{s}")

    names = [name for _, _, name in words]
    places = places.filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names]))
    four = F.array(*[F.struct(F.lit(code).alias("code"), *[shown(code, n) for n in names]) for code in range(4)])
    there = F.filter(four, lambda v: reduce(lambda a, b: a | b, [v[n] != 0 for n in names]))
    # Inside the lambda the weights stand once; written out for all variants, many settings would make a method too long to be compiled.
    masked = lambda v, bit: v["code"].bitwiseAND(F.lit(bit)) == bit
    variants = F.transform(
        there, lambda v: F.struct(masked(v, 1).alias("left_masked"), masked(v, 2).alias("right_masked"), *[weight(v, s) for s in range(len(grid))])
    )
    return places.select(text_key, *keep, "left", "token", "right", variants.alias("variants"))


def draw_weights(keys: Sequence[str | None], lengths: np.ndarray, grid: Sequence[tuple[float, int]], seed: int) -> np.ndarray:
    """The weights of :func:`folded_draws` for the positions of some texts, as an array (variant, position, setting).

    ``keys`` are the ids of the texts as strings and ``lengths`` their numbers of tokens. Bit 0 of the variant says that the left neighbour is
    masked, bit 1 the right one; a variant that no draw shows has no weight.
    """
    samples = max(n for _, n in grid)
    blocks = -(-samples // DRAWS_PER_DIGEST)
    places = [str(i).encode() for i in range(max(lengths, default=0))]
    digests = []
    for key, length in zip(keys, lengths):
        # Like ``concat_ws``, which leaves out nulls.
        begun = [hashlib.md5("|".join([str(seed), str(b), *([] if key is None else [key]), ""]).encode()) for b in range(blocks)]
        for place in places[:length]:
            for block in begun:
                digest = block.copy()
                digest.update(place)
                digests.append(digest.digest())
    width = DRAW_DIGITS // 2
    drawn = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, blocks, 16)[:, :, : DRAWS_PER_DIGEST * width].reshape(-1, blocks * DRAWS_PER_DIGEST, width)
    n = len(drawn)
    out = np.zeros((4, n, len(grid)))
    if not n:
        return out
    ends = np.cumsum(lengths)
    some = lengths > 0
    first, last = (ends - lengths)[some], ends[some] - 1
    sizes = lengths[some]
    for draw in range(samples):
        number = reduce(lambda a, k: a * 256 + drawn[:, draw, k].astype(np.int32), range(width), np.zeros(n, np.int32))
        smallest = np.repeat(np.minimum.reduceat(number, first), sizes)
        for s, (ratio, count) in enumerate(grid):
            if draw >= count:
                continue
            bound = share_bound(ratio)
            hit = number < (int(bound, 16) if bound != "g" else 16**DRAW_DIGITS)
            masked = np.add.reduceat(hit.astype(np.int64), first)
            # Where the plain bound masks none, the positions with the smallest number are taken.
            hit |= np.repeat(masked == 0, sizes) & (number == smallest)
            share = 1.0 / (np.repeat(np.add.reduceat(hit.astype(np.int64), first), sizes) * count)
            code = np.zeros(n, np.int64)
            code[1:] += hit[:-1]
            code[first] = 0
            after = np.zeros(n, np.int64)
            after[:-1] = hit[1:]
            after[last] = 0
            code += 2 * after
            at = np.flatnonzero(hit)
            out[code[at], at, s] += share[at]
    return out


def mask_variants(
    tokenized: DataFrame, grid: list[tuple[float, int]], seed: int, keep: list[str], text_key: str = "text_id"
) -> DataFrame:
    """``folded_draws`` with a row for each variant: ``left_masked, right_masked, w0, w1, ...``."""
    rows = folded_draws(tokenized, grid, seed, keep, text_key).withColumn("v", F.explode("variants"))
    return rows.select(text_key, *keep, "left", "token", "right", "v.*")


def corrupt(token_id: Column, masked: Column, mask: Column | int) -> Column:
    """The mask id where masked, the token id elsewhere."""
    return F.when(masked, mask if isinstance(mask, Column) else F.lit(mask)).otherwise(token_id)
