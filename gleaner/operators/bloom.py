"""Bloom filters of long lists, to keep rows from a shuffle that their keys cannot survive.

A filter is a table of blocks of 512 bits.  A key sets a few bits of one block, so that the filter is
built by an aggregation with partial sums (bitwise or), and tested by a broadcast join on
the block and a few bit tests, all in the JVM.  Its size is bounded: a list too long for it has
no filter.  A filter lets every listed key pass, and some others: an exact join follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.once import free_name

BLOCK_BITS, WORD_BITS, INDEX_BITS = 512, 64, 9
PROBES = 6
BITS_PER_KEY = 12
#: Under so many bits a key the filter would let too much pass to be worth its broadcast.
LEAST_BITS_PER_KEY = 5
#: 32 MB of bits, some 80 MB as a broadcast table: 22 million keys at full, 53 million at least precision.
MOST_BLOCKS = 1 << 19
#: A block as a row of a broadcast table.
BLOCK_BYTES = 160


def blocks_for(n_keys: int, bits_per_key: int = BITS_PER_KEY, most_blocks: int = MOST_BLOCKS) -> int:
    """Number of blocks of a filter of so many keys; 0 if there is none."""
    if n_keys * LEAST_BITS_PER_KEY > most_blocks * BLOCK_BITS:
        return 0
    return min(most_blocks, max(1, -(-n_keys * bits_per_key // BLOCK_BITS)))


def _hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in on])


def _block(hash: Column, n_blocks: int) -> Column:
    return F.pmod(hash, F.lit(n_blocks))


def _probes(hash: Column) -> list[Column]:
    """The places in its block that a key sets."""
    bits = F.xxhash64(hash, F.lit(1))
    return [F.shiftrightunsigned(bits, p * INDEX_BITS).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for p in range(PROBES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(WORD_BITS - 1)))


def _word(place: Column) -> Column:
    return F.shiftright(place, 6)


def bloom_table(keys: DataFrame, on: Sequence[str], n_blocks: int) -> DataFrame:
    """``block, words`` of the keys: blocks that hold one, as eight words of 64 bits."""
    hashed = keys.select(*[F.col(f"`{c}`") for c in on]).dropna().select(_hash(on).alias("hash"))
    zero, probes = F.lit(0).cast("bigint"), _probes(F.col("hash"))
    words = []
    for w in range(BLOCK_BITS // WORD_BITS):
        value = zero
        for place in probes:
            value = value.bitwiseOR(F.when(_word(place) == w, _bit(place)).otherwise(zero))
        words.append(F.bit_or(value).alias(f"w{w}"))
    found = hashed.groupBy(_block(F.col("hash"), n_blocks).alias("block")).agg(*words)
    return found.select("block", F.array(*[f"w{w}" for w in range(len(words))]).alias("words"))


def may_hold(big: DataFrame, table: DataFrame, on: Sequence[str], n_blocks: int) -> DataFrame:
    """Rows of ``big`` whose key may be listed: all that are, and few others."""
    hash, block, words = (free_name(n, big) for n in ("_hash", "_block", "_words"))
    hashed = big.withColumn(hash, _hash(on)).withColumn(block, _block(F.col(hash), n_blocks))
    joined = hashed.join(F.broadcast(table.toDF(block, words)), block)
    passed = F.lit(True)
    for place in _probes(F.col(hash)):
        passed = passed & (F.get(words, _word(place)).bitwiseAND(_bit(place)) != 0)
    return joined.where(passed).select(*[F.col(f"`{c}`") for c in big.columns])


def pruned(big: DataFrame, keys: DataFrame, on: Sequence[str], n_keys: int, max_bytes: int = MOST_BLOCKS * BLOCK_BYTES) -> DataFrame:
    """``big`` without rows that an inner or semi join with ``keys`` would drop, as far as a filter of ``max_bytes`` can tell.

    The two sides' key columns must have the same types; else, and for a list that is too long,
    ``big`` comes back as it is.
    """
    kinds = dict(big.dtypes)
    n_blocks = blocks_for(n_keys, most_blocks=min(MOST_BLOCKS, max_bytes // BLOCK_BYTES))
    if not n_blocks or any(kinds[c] != kind for c, kind in keys.select(*on).dtypes):
        return big
    return may_hold(big, bloom_table(keys, on, n_blocks), on, n_blocks)
