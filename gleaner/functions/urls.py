"""URL parts as Spark columns.  Everything here stays inside the JVM and never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.functions.suffix_table import SuffixTable, with_site
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules

MAX_NAME_LENGTH = 253
MAX_LABEL_LENGTH = 63


def url_host(url: Column) -> Column:
    """Host of a URL as written; null if the URL is malformed or names no host."""
    return F.try_parse_url(url, F.lit("HOST"))


def is_malformed(url: Column) -> Column:
    """True if the URL cannot be parsed at all (a host-less one such as mailto: can)."""
    parts = [F.try_parse_url(url, F.lit(part)) for part in ("PROTOCOL", "AUTHORITY", "FILE")]
    return F.coalesce(*parts).isNull()


def _tail(name: Column, labels: int) -> Column:
    return F.substring_index(name, ".", -labels)


def dns_name(host: Column) -> Column:
    """The host in lower case, without the dot that may end it."""
    return F.rtrim(F.lower(host), F.lit("."))


def is_site_name(name: Column) -> Column:
    """False for addresses (the last label starts with a digit, or brackets) and over-long names."""
    lead = F.substring(_tail(name, 1), 1, 1)
    long_label = name.rlike(r"[^.]{%d}" % (MAX_LABEL_LENGTH + 1))
    too_long = (F.length(name) > MAX_NAME_LENGTH) | long_label
    return ~(lead.between("0", "9") | name.startswith("[")) & (
        (F.octet_length(name) <= MAX_LABEL_LENGTH) | ~too_long
    )


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + name.replace("\\", "").replace("'", "\\'") + "'" for name in names)


def site_of(name: str, rules: SuffixRules = SHIPPED_RULES, strict: bool = False) -> Column:
    """Public suffix plus one label of the domain name in column ``name``; null if there is none.

    A suffix without a rule counts as one label, or gives null if ``strict``.
    Each candidate tail is looked up in a literal hash set, so no join is needed.
    The sets go to Spark as one SQL text: a literal each would cost a call each.
    """

    def tail(labels):
        return f"substring_index(`{name}`, '.', -{labels})"

    def one_more(labels):
        return f"nullif({tail(labels + 1)}, {tail(labels)})"

    branches = []
    for k in range(rules.depth, 0, -1):
        for names, subject, site in (
            (rules.exact.get(k), tail(k), one_more(k)),
            (rules.exception.get(k), tail(k), tail(k)),
            (rules.wildcard.get(k - 1), tail(k - 1), one_more(k)),
        ):
            if names:
                branches.append(f"WHEN {subject} IN ({_quoted(names)}) THEN {site}")
    unknown = "NULL" if strict else one_more(1)
    found = F.expr(f"CASE {' '.join(branches)} ELSE {unknown} END" if branches else unknown)
    return F.when(is_site_name(F.col(name)), found)


def last_label(name: Column) -> Column:
    return _tail(name, 1)


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``."""
    return with_once(df, "host", url_host(F.col(url)))


def with_domains(
    df: DataFrame,
    url: str = "url",
    rules: SuffixRules | SuffixTable = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """Add ``host``, ``host_domain`` (the site) and ``domain_id`` (its last label).

    Rules are a short set, looked up inside the row, or a table of any length, which is joined.
    """
    df = with_host(df, url).withColumn("_name", dns_name(F.col("host")))
    if isinstance(rules, SuffixTable):
        named = df.drop("host_domain").withColumn("_name", F.when(is_site_name(F.col("_name")), F.col("_name")))
        df = with_once(with_site(named, "_name", "_site", rules, strict), "host_domain", F.col("_site")).drop("_site")
    else:
        df = with_once(df, "host_domain", site_of("_name", rules, strict))
    return df.withColumn("domain_id", last_label(F.col("host_domain"))).drop("_name")
