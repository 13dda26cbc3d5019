"""Keyword counting as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_count(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of ``keyword`` in ``text``; 0 for an empty keyword."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, keyword, F.lit("")))
    count = F.try_divide(removed, F.octet_length(keyword)).cast("int")
    return F.coalesce(count, F.when(text.isNotNull(), F.lit(0)))


def matches(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords found in ``text`` with their counts, in keyword order.

    Row-local: pages never meet keywords in a join, and a keyword that does not
    occur costs one substring test and never becomes a row.
    """
    used = F.array(*[F.lit(k) for k in sorted({k for k in keywords if k})]).cast("array<string>")
    found = F.filter(used, lambda k: F.contains(text, k))
    return F.transform(
        found,
        lambda k: F.struct(k.alias("keyword"), keyword_count(text, k).alias("freq")),
    )


def matches_text(found: Column) -> Column:
    """``kw,freq,kw,freq,`` for the output of :func:`matches`."""
    parts = F.transform(found, lambda m: F.concat(m["keyword"], F.lit(","), m["freq"], F.lit(",")))
    return F.array_join(parts, "")
