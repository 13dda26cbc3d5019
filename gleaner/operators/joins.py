"""Joins of a large table with a list.

A list is broadcast only after its size has been measured.  A longer one is joined by a
shuffle on the keys, in which adaptive execution splits the tasks of frequent keys; a bounded
Bloom filter of the list keeps most rows that would not survive the join out of that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import bloom

BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 32


def measured(df: DataFrame) -> tuple[int, int]:
    """Rough size of ``df`` in memory and its rows: one distributed aggregate, one row to the driver."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    row_width = sum(widths, F.lit(ROW_OVERHEAD))
    sums = df.agg(F.coalesce(F.sum(row_width), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    return sums["bytes"], sums["rows"]


def measured_bytes(df: DataFrame) -> int:
    return measured(df)[0]


def join_list(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    prune: bool = True,
) -> DataFrame:
    """``big`` joined with ``small`` on equal columns; ``how`` is inner, left or left_semi.

    ``small`` is read twice (measured, then joined; a third time for the filter of a long list):
    hand over a stored table or the result of ``cut_lineage`` if it is costly.
    """
    keys = list(on)
    if how in ("left_semi", "left_anti"):
        small = small.select(*keys)
        distinct = small.distinct()
    else:
        distinct = small
    size, rows = measured(distinct)
    if size <= max_bytes:
        return big.join(F.broadcast(distinct), keys, how)
    if prune and how in ("inner", "left_semi"):
        big = bloom.pruned(big, small, keys, rows, max_bytes)  # no larger than a list may be
    # not made distinct first: tasks of frequent keys are only split right behind a shuffle
    return big.join(small.hint("merge"), keys, how)
