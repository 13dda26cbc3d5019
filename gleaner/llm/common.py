"""Helpers of the training-data operators: words, text batches, state of a Python worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as the body of a character class.
SPACES = " \\t\\n\\x0B\\f\\r"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator works on; others, whatever they are called, do not reach it."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def word_array(text: Column) -> Column:
    """Words of a text; none for null."""
    split = F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+")
    return F.filter(split, lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES):
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        lengths = pa.compute.binary_length(text)
        sizes[:] = lengths.fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            # copied: some string kernels read a sliced array from its start
            yield batch.take(pa.array(np.arange(start, end))) if len(cuts) else batch


def kept_in_worker(name: str, make):
    """A value built once per Python worker process and used again by its later tasks."""
    import pyspark

    state = pyspark.__dict__.setdefault("_gleaner_worker_state", {})
    if name not in state:
        state[name] = make()
    return state[name]
