"""Blocked Bloom filters as tables: a row for each block of 256 bits, eight 32-bit words of which a key sets one bit each.

A key that the filter does not pass is not in the list; one that it passes may be, which a join with the list decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Blocks of 64 bytes (as columns) up to which a filter is broadcast: 4 MB.
MAX_BLOCKS = 1 << 16
#: Bits for each key.
BITS = 16


def blocks_for(keys: int, bits: int = BITS) -> int:
    """Blocks of a filter of so many keys: a power of two."""
    return 1 << (max(1, keys * bits // 256) - 1).bit_length()


def _masks(key: Column) -> list[Column]:
    """The bit of each of the eight words."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(8)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, m0..m7) of the keys in listed."""
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block")
    masks = listed.select(block, *(m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))))
    return masks.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(8)))


def passes(filled: str, key: Column) -> Column:
    """Whether the block in the struct filled (null: an empty one) has all bits of key."""
    return F.coalesce(reduce(Column.__and__, [F.col(f"{filled}.m{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(key))]), F.lit(False))


def possible(rows: DataFrame, listed: DataFrame, on: list[str], flag: str, max_blocks: int = MAX_BLOCKS, bits: int = BITS) -> DataFrame:
    """rows plus the column flag: false if no row of listed has the same values in the columns `on`, true if one may.

    Rows that are false need no join with listed, so what a wide row holds is not shuffled for it.  listed is read twice.  The filter
    is broadcast and has `max_blocks` at most: a longer list (beyond a million keys at 16 bits) passes more rows, and no result depends on that.
    Values of rows are cast to the types of listed, as equal numbers of other types have other hashes.
    """
    block, filled, key = (fresh(c, rows) for c in ("block", "filled", "key"))
    hashed = F.xxhash64(*(F.col(c).cast(listed.schema[c].dataType) for c in on))
    blocks = min(max_blocks, blocks_for(listed.count(), bits))
    table = bloom(listed.select(hashed.alias("key")), "key", blocks)
    table = table.select(F.col("block").alias(block), F.struct(*(f"m{i}" for i in range(8))).alias(filled))
    keyed = rows.withColumn(key, hashed).withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)))
    return keyed.join(F.broadcast(table), block, "left").select(*rows.columns, passes(filled, F.col(key)).alias(flag))
