"""A blocked Bloom filter as a table, built, joined and probed with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter block: four words of 64, one bit set in each.
WORDS, BLOCK_BITS = 4, 256
#: Blocks of a filter that may be broadcast (some 3 MB).
BROADCAST_BLOCKS = 65_536


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int") for i in range(WORDS)]


def blocks_for(n_keys: int, bits_per_key: int = 16) -> int:
    return max(1, -(-n_keys * bits_per_key // BLOCK_BITS))


def build(keys: DataFrame, column: str, n_keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3) of the blocks that have a bit set, and its number of blocks: bits_per_key bits for each key."""
    n = blocks_for(n_keys, bits_per_key)
    key = F.col(column)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{i}") for i, b in enumerate(_bits(key))]
    return keys.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(*words), n


def probe(df: DataFrame, key: Column, bloom: tuple[DataFrame, int]) -> DataFrame:
    """(row, key, possible): df's rows as structs, their keys, and false where a key is surely not in the filter. Up to
    BROADCAST_BLOCKS blocks the filter goes to every task; a larger one meets the rows by block."""
    table, n = bloom
    rows = df.select(F.struct("*").alias("row"), key.alias("key"))
    hit = F.col("block").isNotNull()
    for i, b in enumerate(_bits(F.col("key"))):
        hit &= F.call_function("shiftrightunsigned", F.col(f"w{i}"), b).bitwiseAND(1) == 1
    side = F.broadcast(table) if n <= BROADCAST_BLOCKS else table.hint("merge")
    joined = rows.join(side, F.pmod(F.xxhash64("key"), F.lit(n)) == F.col("block"), "left")
    return joined.select("row", "key", F.coalesce(hit, F.lit(False)).alias("possible"))


def marked(df: DataFrame, key: Column, listed: DataFrame, column: str) -> DataFrame:
    """(row, found): df's rows as structs and the struct of the listed row of their key, null where it is not listed. listed
    has one row for each key. Only rows that pass the filter meet in the exact join; where the filter is too large to
    broadcast, all do, as meeting the filter by block would move the rows once more."""
    n = listed.count()
    named = listed.select(F.col(column).alias("listed"), F.struct("*").alias("found")).hint("merge")
    if blocks_for(n) > BROADCAST_BLOCKS:
        rows = df.select(F.struct("*").alias("row"), key.alias("key"))
        return rows.join(named, F.col("key") == F.col("listed"), "left").select("row", "found")
    probed = probe(df, key, build(listed, column, n))
    exact = probed.filter("possible").join(named, F.col("key") == F.col("listed"), "left").select("row", "found")
    return exact.unionByName(probed.filter("NOT possible").select("row", F.lit(None).alias("found")))


def semi(df: DataFrame, key: Column, listed: DataFrame, column: str, keep: bool) -> DataFrame:
    """The rows of df whose key is listed (keep) or is not (not keep); see marked()."""
    found = marked(df, key, listed.select(column).distinct(), column)
    return found.filter(F.col("found").isNotNull() if keep else F.col("found").isNull()).select("row.*")
