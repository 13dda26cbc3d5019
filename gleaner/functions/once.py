"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column as the single element of an exploded array.

    A later filter on the column then stops above it.  On a plain column the optimizer
    would move the filter below and copy the whole expression into it, and again into
    each expression built on it: costly parsing would run twice, and long chains outgrow
    generated code.
    """
    return df.drop(name).select("*", F.explode(F.array(column)).alias(name))


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores added until no table has a column of that name, in any letter case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
