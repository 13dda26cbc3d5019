"""Keyword search over page text, and the cleaning of its matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.text import matches, matches_text
from gleaner.functions.urls import with_domains
from gleaner.operators.automaton import with_found

DOCUMENTED, AS_CODED = "documented", "as_coded"
#: Longer lists are searched for by an automaton: it costs the same for any number of keywords.
MOST_COLUMNS = 10
Keywords = Sequence[str] | DataFrame


def _listed(pages: DataFrame, keywords: Keywords) -> DataFrame:
    if isinstance(keywords, DataFrame):
        return keywords.select(F.col(f"`{keywords.columns[0]}`").cast("string").alias("word"))
    return pages.sparkSession.createDataFrame([(k,) for k in keywords], "word string")


def _with_matches(
    pages: DataFrame, keywords: Keywords, mode: str, rules: SuffixRules, strict: bool
) -> DataFrame:
    """``domain_id, url, found`` per page of a valid site."""
    if mode not in (DOCUMENTED, AS_CODED):
        raise ValueError(f"unknown mode {mode!r}")
    df = with_domains(pages, rules=rules, strict=strict).where("domain_id IS NOT NULL")
    df = df.select("domain_id", "url", F.lower("text").alias("_text"))
    if isinstance(keywords, DataFrame) or len(keywords) > MOST_COLUMNS:
        words = _listed(pages, keywords)
        return with_found(df, "_text", words.select(F.lower("word")) if mode == DOCUMENTED else words)
    if mode == DOCUMENTED:
        keywords = [k.lower() for k in keywords]
    return with_once(df, "found", matches(F.col("_text"), keywords)).drop("_text")


def _one_row_each(df: DataFrame) -> DataFrame:
    return df.select("domain_id", "url", F.inline("found"))


def keyword_matches(
    pages: DataFrame,
    keywords: Keywords,
    mode: str = DOCUMENTED,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """``domain_id, url, keyword, freq`` for each keyword a page's lower-cased text holds.

    The documented mode folds the keywords as well; ``as_coded`` leaves them as given.
    ``keywords`` is a list, or a table's first column, of any length.
    """
    return _one_row_each(_with_matches(pages, keywords, mode, rules, strict))


def keyword_matches_concat(
    pages: DataFrame,
    keywords: Keywords,
    mode: str = DOCUMENTED,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """``domain_id, url, matches``: all matches of a page in one text, by keyword.

    Built inside the row, so it needs no grouping however often a URL occurs.
    """
    df = _with_matches(pages, keywords, mode, rules, strict).where(F.size("found") > 0)
    return df.select("domain_id", "url", matches_text(F.col("found")).alias("matches"))


def vacancy_candidates(
    pages: DataFrame,
    keywords: Keywords,
    min_keywords: int = 2,
    mode: str = DOCUMENTED,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """Matches of the pages that hold at least ``min_keywords`` different keywords.

    ``as_coded`` tests the length of the keyword list instead, so that any match counts
    once the list has that many distinct entries.
    """
    df = _with_matches(pages, keywords, mode, rules, strict)
    if mode == AS_CODED:
        if _listed(pages, keywords).distinct().limit(min_keywords).count() < min_keywords:
            df = df.where(F.lit(False))
        return _one_row_each(df)
    return _one_row_each(df.where(F.size("found") >= min_keywords))


def packed_key(df: DataFrame) -> DataFrame:
    """``key, val`` as ``domain,url`` and ``keyword,freq`` text."""
    return df.select(
        F.concat_ws(",", "domain_id", "url").alias("key"),
        F.concat_ws(",", "keyword", F.col("freq").cast("string")).alias("val"),
    )


def split_key(key: Column) -> list[Column]:
    """``domain_id`` and ``url`` of a packed key; commas in the URL stay."""
    parts = F.split(key, ",", 2)
    return [F.get(parts, F.lit(0)).alias("domain_id"), F.get(parts, F.lit(1)).alias("url")]


def candidate_urls(matches: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct ``domain_id, url``, in the order of the domain.

    The URL takes part in the order so that a frequent domain is sorted by many tasks.
    """
    distinct = matches.select("domain_id", "url").dropDuplicates()
    return distinct.orderBy("domain_id", "url") if ordered else distinct


def candidate_count_per_domain(candidates: DataFrame) -> DataFrame:
    """``domain_id, n``: different URLs per domain.

    URLs are made distinct on (domain, URL) first, which spreads a frequent domain.
    """
    return (
        candidates.dropna(subset=["domain_id", "url"])
        .groupBy("domain_id")
        .agg(F.count_distinct("url").alias("n"))
    )
