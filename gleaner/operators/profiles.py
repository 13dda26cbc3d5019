"""Countries of profile pages on three social sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.html import joined, select_texts
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.urls import with_domains
from gleaner.operators.joins import join_list
from gleaner.operators.pages import PROFILE_PATH
from gleaner.session import cut_lineage

# The sites, and the elements that hold a profile's fields.
LINKEDIN, VIADEO, XING = "linkedin.com", "viadeo.com", "xing.com"
SELECTORS = {
    "full_name": ("span", "full-name"),
    "span_country": ("span", "country-name"),
    "locality": ("span", "locality"),
    "abbr_country": ("abbr", "country-name"),
    "li_country": ("li", "country-name"),
}


def may_be_profile() -> Column:
    """By site and address alone, before anything is decoded."""
    site, is_profile = F.col("host_domain"), F.col("url").contains(PROFILE_PATH)
    return (site == LINKEDIN) | (site.isin(VIADEO, XING) & is_profile)


def _parsed(pages: DataFrame, rules: SuffixRules, strict: bool) -> DataFrame:
    """Profile pages with the texts of their elements; the HTML of other pages never leaves the JVM."""
    if "host_domain" not in pages.columns:
        pages = with_domains(pages, rules=rules, strict=strict)
    df = pages.where(may_be_profile())
    return df.withColumn("_t", select_texts(F.col("html"), SELECTORS))


def profile_status(pages: DataFrame, rules: SuffixRules = SHIPPED_RULES, strict: bool = False) -> DataFrame:
    """``url, status`` of each profile page: OK, NO_NAME or UNPARSABLE (null pages too)."""
    df = _parsed(pages, rules, strict)
    named = (F.col("host_domain") != LINKEDIN) | F.exists(F.col("_t.full_name"), lambda t: t != "")
    status = F.when(F.col("_t.full_name").isNull(), "UNPARSABLE").when(~named, "NO_NAME").otherwise("OK")
    return df.select("url", status.alias("status"))


def profile_status_counts(pages: DataFrame, rules: SuffixRules = SHIPPED_RULES, strict: bool = False) -> DataFrame:
    """How many profile pages came to what: ``status, n``."""
    return profile_status(pages, rules, strict).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _with_country(pages: DataFrame, rules: SuffixRules, strict: bool) -> DataFrame:
    """Profile pages with ``country``."""
    df = _parsed(pages, rules, strict)
    site = F.col("host_domain")

    def text(name):
        return F.lower(joined(F.col(f"_t.{name}")))

    def present(name):
        return F.size(f"_t.{name}") > 0

    parts = F.split(F.regexp_replace(text("locality"), r"(,\s)+$", ""), r",\s")
    country = (
        F.when(site == LINKEDIN, F.when(present("span_country"), text("span_country")).otherwise(
            F.element_at(parts, -1)))
        .when(site == VIADEO, F.when(present("span_country"), text("span_country")).otherwise(
            text("abbr_country")))
        .otherwise(text("li_country"))
    )
    named = F.exists(F.col("_t.full_name"), lambda t: t != "")
    return (
        df.where(F.col("_t.full_name").isNotNull() & ((site != LINKEDIN) | named))
        .withColumn("country", country)
        .select("url", "html", "country")
    )


def profile_country(
    pages: DataFrame,
    ordered: bool = False,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """``url, country`` per profile page; ``ordered`` sorts by URL.

    The country may be empty.  A professional-network page without a full name gives no row.
    Rows are stored before they are sorted: a sort samples its input first, and would have
    every page parsed twice.
    """
    df = _with_country(pages, rules, strict).select("url", "country")
    return cut_lineage(df).orderBy("url") if ordered else df


def profiles_in_countries(
    pages: DataFrame,
    countries: Sequence[str] | DataFrame,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """``url, html`` of profile pages whose lower-case country is in the list, or in the table's
    first column, as given.

    An empty list item selects pages without a country.
    """
    df = _with_country(pages, rules, strict)
    if isinstance(countries, DataFrame):
        listed = countries.select(F.col(countries.columns[0]).alias("country"))
        return join_list(df, listed, ["country"], "left_semi").select("url", "html")
    return df.where(F.col("country").isin(list(countries))).select("url", "html")
