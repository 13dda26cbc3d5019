"""Sinks.  The default mode refuses to touch an existing path."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage
from gleaner.sources.records import ESCAPES, NULL


def arranged(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Rows clustered by ``keys`` into key-sorted files.

    Ranges, not hashes: give a fine-grained key last (``domain_id, url``) and the
    rows of one frequent first key spread over several files.  Ranges are found by
    sampling, so ``df`` is stored first and not computed twice.
    """
    df = cut_lineage(df)
    columns = [F.col(k) for k in keys]
    spread = (
        df.repartitionByRange(num_partitions, *columns)
        if num_partitions
        else df.repartitionByRange(*columns)
    )
    return spread.sortWithinPartitions(*columns)


def _packed(df: DataFrame, escape: bool) -> DataFrame:
    def field(name):
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if escape:
            for plain, written in ESCAPES:
                value = F.replace(value, F.lit(plain), F.lit(written))
            return F.when(F.col(name).isNull(), NULL).otherwise(value)
        error = F.concat(F.lit(f"{name} holds a tab or line break, write with escape=True: "), value)
        return F.when(value.rlike("[\t\n\r]"), F.raise_error(error).cast("string")).otherwise(value)

    return df.select(F.concat_ws("\t", *[field(c) for c in df.columns]).alias("value"))


def write_tsv(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    keys: Sequence[str] = (),
    num_partitions: int | None = None,
    escape: bool = False,
) -> None:
    """Uncompressed ``key \\t value`` lines.

    A value with a tab or line break raises; a null is written like an empty text.  With
    ``escape`` such values are written with backslashes and a null as ``\\N``, which
    ``scan_tsv(.., escaped=True)`` undoes.
    """
    if keys:
        df = arranged(df, keys, num_partitions)
    elif num_partitions:
        df = df.repartition(num_partitions)
    _packed(df, escape).write.mode(mode).text(path)


def write_pages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, the default for pages and everything that holds HTML."""
    df.write.mode(mode).parquet(path)


def write_seq(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Two string columns as a SequenceFile of (Text, Text), for readers outside Spark.

    ``mode`` is ``errorifexists``, ``overwrite`` or ``ignore``; the format cannot be appended to.  With
    ``overwrite`` the old files go only after the new ones are written.  Rows pass a Python worker one by one: this is
    for handing results over, once, and never a stage inside a chain.
    """
    if mode not in ("error", "errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(target)
    if there and mode == "ignore":
        return
    key, value = df.columns
    rows = df.select(F.col(f"`{key}`").cast("string"), F.col(f"`{value}`").cast("string")).rdd.map(tuple)
    if not (there and mode == "overwrite"):
        rows.saveAsSequenceFile(path)
        return
    written = f"{path.rstrip('/')}-{uuid.uuid4()}"
    rows.saveAsSequenceFile(written)
    files.delete(target, True)
    files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written), target)
