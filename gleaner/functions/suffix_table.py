"""Public suffix rules as a table, for full rule lists of any length.

A rule is a name with a mark: exact, wildcard (every label below it), or exception.  A host's tails of one,
two, .. labels are each looked up by a join with the table, which is broadcast after it has been
measured: no expression grows with the rules, and a list of ten thousand costs what a short
one does.  Rules may be spelled in Unicode or in ASCII (Punycode); both spellings match hosts.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.once import free_name

EXACT, WILDCARD, EXCEPTION = 1, 2, 4


class SuffixTable(NamedTuple):
    """``rules (name, kinds)``, one row a name, with the most labels a name has; ``small`` says it may be broadcast."""

    rules: DataFrame
    depth: int
    small: bool


@F.pandas_udf(StringType())
def _ascii_name(names: pd.Series) -> pd.Series:
    """Labels that are not ASCII in their ASCII spelling (RFC 3492)."""

    def label(text):
        return text if text.isascii() else "xn--" + text.encode("punycode").decode("ascii")

    return names.map(lambda name: ".".join(map(label, name.split("."))), na_action="ignore")


def suffix_table(lines: DataFrame, max_bytes: int = 64 << 20) -> SuffixTable:
    """Rules from a table's first column: lines such as ``co.uk``, ``*.ck``, ``!www.ck``; ``//`` starts a comment.

    The table is stored and measured when this is called.
    """
    from gleaner.operators.joins import measured_bytes
    from gleaner.session import cut_lineage

    rule = F.lower(F.trim(F.substring_index(F.col(f"`{lines.columns[0]}`").cast("string"), "//", 1)))
    marked = lines.select(rule.alias("rule")).where("rule <> ''")
    kind = F.when(F.startswith("rule", F.lit("*.")), WILDCARD).when(F.startswith("rule", F.lit("!")), EXCEPTION).otherwise(EXACT)
    named = marked.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("name"), kind.alias("kind"))
    foreign = named.where(F.col("name").rlike(r"[^\x00-\x7F]")).withColumn("name", _ascii_name("name"))
    rules = cut_lineage(named.unionByName(foreign).groupBy("name").agg(F.bit_or("kind").alias("kinds")))
    depth = rules.agg(F.max(F.size(F.split("name", r"\.")))).first()[0] or 0
    return SuffixTable(rules, depth, measured_bytes(rules) <= max_bytes)


def read_suffix_table(spark: SparkSession, path: str) -> SuffixTable:
    return suffix_table(spark.read.text(path))


def with_site(df: DataFrame, name: str, site: str, rules: SuffixTable, strict: bool = False) -> DataFrame:
    """``df`` with ``site``: public suffix plus one label of the domain name in column ``name``; null if there is none.

    An exception prevails, then the longest rule; a suffix without a rule counts as one label, or gives null if ``strict``.
    """
    tail = lambda k: F.substring_index(name, ".", -k)
    labels = F.size(F.split(name, r"\."))
    columns, exceptions, longest = df.columns, F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in range(1, rules.depth + 1):
        key, kinds = free_name(f"_tail{k}", df), free_name(f"_kinds{k}", df)
        listed = rules.rules.select(F.col("name").alias(key), F.col("kinds").alias(kinds))
        known = df.withColumn(key, F.when(labels >= k, tail(k)))
        df = known.join(F.broadcast(listed) if rules.small else listed.hint("merge"), key, "left")
        has = lambda kind, kinds=kinds: F.col(kinds).bitwiseAND(F.lit(kind)) != 0
        exceptions = F.coalesce(exceptions, F.when(has(EXCEPTION), k - 1))
        longest = F.greatest(longest, F.when(has(EXACT), k), F.when(has(WILDCARD) & (labels > k), k + 1))
    suffix = F.coalesce(exceptions, longest, F.lit(None if strict else 1).cast("int"))
    parts = F.split(name, r"\.")
    found = F.when(labels > suffix, F.array_join(F.slice(parts, labels - suffix, suffix + 1), "."))
    return df.select(*[F.col(f"`{c}`") for c in columns], found.alias(site))

