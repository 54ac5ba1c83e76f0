"""A Bloom filter of bounded size in DataFrame functions: blocks of 32,768 bits, each key in one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkprobe.session import stage

# Bits of a block, as ``bitmap_construct_agg`` builds them, and bits that a key sets in its block.
BLOCK_BITS = 32_768
PROBES = 3
# Bits a key up to the bound on blocks; beyond it the filter gets fuller and lets more through, never less.
BITS_PER_KEY = 16
MOST_BLOCKS = 16_384  # 64 MB


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def _places(key: Column) -> list[Column]:
    mixed = F.xxhash64(F.lit("place"), key)
    return [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


class BloomFilter:
    """The distinct values of ``key`` (a long column) of ``keys``. No value of theirs is ever missed.

    At most ``MOST_BLOCKS`` blocks of 4 KB, so that broadcasting it is bounded whatever the number of keys.
    """

    def __init__(self, keys: DataFrame, key: str, count: int):
        self.blocks = max(1, min(MOST_BLOCKS, -(-count * BITS_PER_KEY // BLOCK_BITS)))
        value = F.col(key)
        bits = keys.select(_block(value, self.blocks).alias("block"), F.explode(F.array(*_places(value))).alias("place"))
        self.table = stage(bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), "bloom")

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Add the boolean ``name``: the value of ``key`` may be one of the keys. Moves no row."""
        value = F.col(key)

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("bloom.bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
            return F.getbit(byte.cast("int"), place.bitwiseAND(F.lit(7)).cast("int")) == 1

        found = rows.alias("rows").join(F.broadcast(self.table.alias("bloom")), _block(value, self.blocks) == F.col("bloom.block"), "left")
        there = is_set(_places(value)[0])
        for place in _places(value)[1:]:
            there = there & is_set(place)
        return found.select("rows.*", F.coalesce(there, F.lit(False)).alias(name))
