"""Bloom filter of the hashes that occur more than once, from built-in functions only.

Each hash falls into one block of 32,768 bits and sets ``PROBES`` positions in it. The filter
is a table (block, bits) of at most ``MAX_BLOCKS`` rows of 4 KB: its size has a fixed bound,
so it may be broadcast. With more hashes than that bound was made for, more rows are called
possibly repeated; none that is repeated is ever missed.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
PROBES = 2
#: 128 MB of bitmaps.
MAX_BLOCKS = 32_768
BITS_PER_HASH = 16


def blocks_for(n: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, ceil(n * BITS_PER_HASH / BLOCK_BITS)))


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks)).cast("int")


def positions_of(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def repeated_filter(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """First pass: count how often each bit is hit, pre-aggregated in every task, and pack the bits hit twice or more."""
    hits = hashes.select(block_of(F.col(h), blocks).alias("__block"), F.explode(F.array(*positions_of(F.col(h)))).alias("__bit"))
    twice = hits.groupBy("__block", "__bit").count().where("count > 1")
    return twice.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits"))


def present_filter(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """An ordinary Bloom filter: every hash of ``hashes`` sets its bits."""
    hits = hashes.select(block_of(F.col(h), blocks).alias("__block"), F.explode(F.array(*positions_of(F.col(h)))).alias("__bit"))
    return hits.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits"))


def flagged(df: DataFrame, h: str, bits: DataFrame, blocks: int, flag: str = "__maybe") -> DataFrame:
    """Second pass: ``flag`` is true where all bits of the hash are set; the filter is at most ``blocks`` rows."""

    def is_set(pos: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__bits", F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(pos, F.lit(8))).bitwiseAND(F.lit(1)) == 1

    test = F.lit(True)
    for pos in positions_of(F.col(h)):
        test = test & is_set(pos)
    probed = df.withColumn("__block", block_of(F.col(h), blocks)).join(F.broadcast(bits), "__block", "left")
    return probed.withColumn(flag, F.coalesce(test, F.lit(False))).drop("__block", "__bits")
