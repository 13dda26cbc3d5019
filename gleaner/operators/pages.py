"""Choosing pages: by host, by URL list, by size, by address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.http import is_html_response, with_html, with_http
from gleaner.functions.once import free_name
from gleaner.functions.suffixes import SHIPPED_RULES, SuffixRules
from gleaner.functions.urls import with_domains
from gleaner.operators.joins import BROADCAST_BYTES, join_list
from gleaner.sources.records import plain_path

# The usual size limit of a page, and the mark of profile addresses.
MAX_HTML_BYTES = 5 * 1024 * 1024
PROFILE_PATH = "/profile/"


def is_small_html(max_bytes: int = MAX_HTML_BYTES) -> Column:
    """The header says HTML, in lower case, and a length below the limit."""
    return F.col("content_type").contains("html") & (F.col("content_length") < max_bytes)


def filter_html_size(records: DataFrame, max_bytes: int = MAX_HTML_BYTES) -> DataFrame:
    return records.where(is_small_html(max_bytes))


def arc_html(records: DataFrame, sniff: bool = False) -> DataFrame:
    """The archive records that hold an HTTP response with HTML, with ``html`` added; ``sniff`` as in ``with_html``."""
    return with_html(with_http(records).where(is_html_response()), sniff)


# What became of a record, from the first test it fails; a readable record has a sound header.
EXCEPTIONS, INVALID_URIS, NOT_LISTED, NOT_HTML, NO_HTTP, OK = (
    "EXCEPTIONS", "INVALID_URIS", "NOT_LISTED", "NOT_HTML", "NO_HTTP", "OK"
)


def _outcome(records: DataFrame, refused: Column, max_bytes: int) -> DataFrame:
    """``records`` with ``outcome``; ``refused`` is null for a record that is wanted."""
    readable = F.col("status").isin("OK", "TRUNCATED") & F.col("url").isNotNull()
    with_head = with_http(records).drop("http_status", "http_headers")
    outcome = (
        F.when(~readable, EXCEPTIONS)
        .when(refused.isNotNull(), refused)
        .when(~F.coalesce(is_small_html(max_bytes), F.lit(False)), NOT_HTML)
        .when(F.col("body").isNull(), NO_HTTP)
        .otherwise(OK)
    )
    return with_head.withColumn("outcome", outcome).drop("body")


def host_page_status(
    records: DataFrame,
    hosts: Sequence[str] | DataFrame,
    max_bytes: int = MAX_HTML_BYTES,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """All ``records``, damaged ones too, with ``outcome``: what :func:`pages_for_hosts` makes of each."""
    df = with_domains(records, rules=rules, strict=strict)
    if not isinstance(hosts, DataFrame):
        hosts = records.sparkSession.createDataFrame([(h,) for h in hosts], "host string")
    mark = free_name("_listed", df)
    listed = hosts.select(F.col(f"`{hosts.columns[0]}`").alias("host_domain")).dropna().distinct().withColumn(mark, F.lit(True))
    df = join_list(df, listed, ["host_domain"], "left")
    refused = F.when(F.col("host").isNull(), INVALID_URIS).when(F.col(mark).isNull(), NOT_LISTED)
    return _outcome(df, refused, max_bytes).drop(mark, "host", "host_domain", "domain_id")


def listed_page_status(
    records: DataFrame,
    wanted: DataFrame,
    max_bytes: int = MAX_HTML_BYTES,
    max_list_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All ``records``, damaged ones too, with ``outcome``: what :func:`html_for_urls` makes of each, matching path and URL."""
    path, mark = free_name("_path", records, wanted), free_name("_listed", records, wanted)
    keys = [path, "url"]
    listed = _with_plain_path(wanted, path).select(*keys).dropna().distinct().withColumn(mark, F.lit(True))
    df = join_list(_with_plain_path(records, path), listed, keys, "left", max_list_bytes)
    refused = F.when(F.col(mark).isNull(), NOT_LISTED)
    return _outcome(df, refused, max_bytes).drop(path, mark)


def on_hosts(
    df: DataFrame,
    hosts: Sequence[str] | DataFrame,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
) -> DataFrame:
    """Rows whose site is exactly one of ``hosts``, a list or a table's first column; it is not
    folded or trimmed.  Rows that have ``host_domain`` keep it."""
    if "host_domain" not in df.columns:
        df = with_domains(df, rules=rules, strict=strict)
    if isinstance(hosts, DataFrame):
        listed = hosts.select(F.col(hosts.columns[0]).alias("host_domain"))
        return join_list(df, listed, ["host_domain"], "left_semi")
    return df.where(F.col("host_domain").isin(list(hosts)))


def pages_for_hosts(
    records: DataFrame,
    hosts: Sequence[str] | DataFrame,
    max_bytes: int = MAX_HTML_BYTES,
    rules: SuffixRules = SHIPPED_RULES,
    strict: bool = False,
    with_host: bool = False,
) -> DataFrame:
    """``url, html`` (and ``host_domain``) of archive records on the given sites.

    No shuffle for a list; bodies are cut last.
    """
    kept = filter_html_size(on_hosts(records, hosts, rules, strict), max_bytes)
    return arc_html(kept.where("url IS NOT NULL")).select("url", "html", *["host_domain"] * with_host)


def _with_plain_path(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, plain_path(F.col("arc_path")))


def archive_prune(
    records: DataFrame, archives: DataFrame, max_list_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows from listed archives, whatever form either path has.  To skip the other files
    altogether, scan with ``sources.archives.scan_listed_arc``."""
    path = free_name("_path", records, archives)
    wanted = _with_plain_path(archives.where("arc_path IS NOT NULL"), path)
    return join_list(_with_plain_path(records, path), wanted, [path], "left_semi", max_list_bytes).drop(path)


def by_segment(records: DataFrame) -> DataFrame:
    """``records`` with ``segment``, the folder that holds a record's archive: the column to lay records out by."""
    return records.withColumn("segment", F.element_at(F.split(plain_path(F.col("arc_path")), "/"), -2))


def archive_prune_by_segment(
    records: DataFrame, archives: DataFrame, max_list_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """:func:`archive_prune` of records stored in folders by ``segment`` (:func:`by_segment`).

    A list short enough to broadcast also prunes, when the query runs, the folders that are read: those of
    segments without a listed archive are not opened.
    """
    path = free_name("_path", records, archives)
    wanted = _with_plain_path(by_segment(archives.where("arc_path IS NOT NULL")), path)
    # the condition holds for every row; without one Spark does not take the list for a filter of folders
    wanted = wanted.select("segment", path).where("segment >= ''").distinct()
    return join_list(_with_plain_path(records, path), wanted, ["segment", path], "left_semi", max_list_bytes).drop(path)


def html_for_urls(
    records: DataFrame,
    wanted: DataFrame,
    pairwise: bool = True,
    max_bytes: int = MAX_HTML_BYTES,
    max_list_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``url, html`` of archive records listed in ``wanted (arc_path, url)``.

    Pairwise, a record must match path and URL of one row.  Otherwise its path must be
    in one column and its URL in the other, each on its own.  A list too long to broadcast
    is joined by a shuffle: a Bloom filter of the list leaves most other records out of it, and
    ``scan_listed_arc`` does not even unpack them.
    """
    kept = filter_html_size(records, max_bytes)
    if pairwise:
        path = free_name("_path", records, wanted)
        kept, listed = _with_plain_path(kept, path), _with_plain_path(wanted, path)
        kept = join_list(kept, listed, [path, "url"], "left_semi", max_list_bytes)
    else:
        kept = archive_prune(kept, wanted, max_list_bytes)
        urls = wanted.where("url IS NOT NULL")
        kept = join_list(kept, urls, ["url"], "left_semi", max_list_bytes)
    return arc_html(kept).select("url", "html")


def profile_pages(pages: DataFrame) -> DataFrame:
    """Pages whose URL holds ``/profile/``."""
    return pages.where(F.col("url").contains(PROFILE_PATH))
