"""Not-modified revisits of WARC captures, resolved to the latest earlier full response.

An as-of join by canonical URL: all captures are sorted by URL and time over ranges, so that the
captures of one URL, however many, spread over as many tasks as they fill.  Inside a range a
window carries the last full response forward; what a URL brings into its next range is one row per
range.  No payload moves, only what identifies it.

A revisit names validators.  An entity tag must equal the response's (weakly compared); without
one the time of last modification must; without either the revisit stays unchecked but is
resolved.  The headers of a resolved revisit are the response's, with those that a not-modified
answer may update taken from the revisit.

Defined cases: a response at the same second is not earlier; of responses at one second the
greatest ``record_id`` counts; a null or foreign URL stands for itself as it is, a null one
matches nothing; repeated rows each have theirs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import only
from gleaner.operators.joins import join_list
from gleaner.session import store

#: What a 304 answer may update (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$"
COLUMNS = ("record_id", "url", "ts", "kind", "etag", "last_modified", "headers", "digest", "length")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no empty query, a path at least."""
    part = lambda k: F.regexp_extract(url, URL, k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(
        F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    )
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.when(url.rlike(URL), F.concat(scheme, F.lit("://"), host, path, query)).otherwise(url)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[Ww]/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per revisit ``record_id, url, ts, status, refers_to, digest, length, headers``.

    ``records``: ``record_id`` long, ``url``, ``ts`` (seconds), ``kind`` (``response`` or
    ``revisit``), ``etag``, ``last_modified``, ``headers`` (a map, names in lower case),
    ``digest`` and ``length`` of the payload.  ``status`` is RESOLVED, UNCHECKED,
    VALIDATOR_MISMATCH or NO_EARLIER_RESPONSE; an unresolved revisit keeps its own headers.
    """
    rows = only(records, *COLUMNS).withColumn("url", canonical_url(F.col("url")))
    rows = rows.withColumn("_late", (F.col("kind") == "response").cast("int"))
    order = ["ts", "_late", "record_id"]
    dealt = rows.repartitionByRange("url", *order).withColumn("_range", F.spark_partition_id())
    dealt = store(dealt, "captures")
    full = F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest", "length")
    full = F.when((F.col("kind") == "response") & F.col("url").isNotNull(), full)
    within = Window.partitionBy("url", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("_near", F.last(full, ignorenulls=True).over(within))

    ends = dealt.groupBy("url").agg(F.min("_range").alias("lo"), F.max("_range").alias("hi"))
    spread = store(ends.where("lo < hi AND url IS NOT NULL").select("url"), "spread")
    last = F.max_by(full, F.struct("ts", "record_id"))
    heads = join_list(dealt, spread, ["url"], "left_semi").where("kind = 'response'")
    heads = heads.groupBy("url", "_range").agg(last.alias("_last"))
    ranges = join_list(dealt.select("url", "_range"), spread, ["url"], "left_semi").distinct()
    before = Window.partitionBy("url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(heads, ["url", "_range"], "left").withColumn("_far", F.last("_last", ignorenulls=True).over(before))
    carried = store(carried.where("_far IS NOT NULL").select(F.struct("url", "_range").alias("_at"), "_far"), "carried")

    revisits = seen.where("kind = 'revisit'").withColumn("_at", F.struct("url", "_range"))
    found = join_list(revisits, carried, ["_at"], "left").withColumn("_full", F.coalesce("_near", "_far"))
    tags = _weak(F.col("etag")) == _weak(F.col("_full.etag"))
    times = F.col("last_modified") == F.col("_full.last_modified")
    status = (
        F.when(F.col("_full").isNull(), "NO_EARLIER_RESPONSE")
        .when(F.col("etag").isNotNull(), F.when(tags, "RESOLVED").otherwise("VALIDATOR_MISMATCH"))
        .when(F.col("last_modified").isNotNull(), F.when(times, "RESOLVED").otherwise("VALIDATOR_MISMATCH"))
        .otherwise("UNCHECKED")
    )
    found = found.withColumn("status", status)
    good = F.col("status").isin("RESOLVED", "UNCHECKED")
    empty = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("_full.headers", empty), lambda k, v: ~F.map_contains_key(update, k))
    return found.select(
        "record_id", "url", "ts", "status",
        F.when(good, F.col("_full.record_id")).alias("refers_to"),
        F.when(good, F.col("_full.digest")).alias("digest"),
        F.when(good, F.col("_full.length")).alias("length"),
        F.when(good, F.map_concat(kept, update)).otherwise(F.coalesce("headers", empty)).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """A map of headers as sorted lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.sort_array(lines), "\n")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures by rule: a response per page and two revisits; a third of the pages share one URL.

    ``k`` = 0 is the response.  Revisits write the URL in other ways, come before the response if
    ``page_id % 9 = 0``, carry another tag if ``page_id % 4 = 0``, no tag but a time if
    ``page_id % 6 = 1``, and neither if ``page_id % 6 = 5``.
    """
    page = F.expr(
        """transform(sequence(0, 2), k -> named_struct(
          'record_id', page_id * 10 + k,
          'url', CASE WHEN k = 1 THEN concat(replace(u, 'http://', 'HTTP://'), '#again') WHEN k = 2 THEN concat(u, '') ELSE u END,
          'ts', 1700000000 + (page_id * 7919) % 100000 * 60 + CASE WHEN k = 0 THEN 0 WHEN page_id % 9 = 0 THEN -3600 ELSE k * 86400 END,
          'kind', CASE WHEN k = 0 THEN 'response' ELSE 'revisit' END,
          'etag', CASE WHEN page_id % 6 IN (1, 5) THEN NULL
                       WHEN k > 0 THEN concat('W/"', page_id % 2 + CASE WHEN page_id % 4 = 0 THEN 5 ELSE 0 END, '"')
                       ELSE concat('"', page_id % 2, '"') END,
          'last_modified', CASE WHEN page_id % 6 = 1 THEN concat('day ', page_id % 3 + CASE WHEN k = 2 THEN 1 ELSE 0 END) END,
          'headers', CASE WHEN k = 0 THEN map('content-type', 'text/html', 'content-length', cast(n AS string), 'date', concat('d', page_id), 'server', 'a')
                          ELSE map('content-length', '0', 'date', concat('d', page_id, '-', k), 'server', 'b', 'vary', '*') END,
          'digest', CASE WHEN k = 0 THEN digest END,
          'length', CASE WHEN k = 0 THEN n END))"""
    )
    base = pages.select(
        "page_id",
        F.expr("CASE WHEN page_id % 3 = 0 THEN 'http://popular.example.com/' ELSE url END").alias("u"),
        F.md5("html").alias("digest"), F.octet_length("html").cast("bigint").alias("n"),
    )
    return base.select(F.explode(page).alias("r")).select("r.*")


CAPTURES_SQL = """
    WITH base AS (
      SELECT page_id, md5(html) AS digest, octet_length(encode(html)) AS n,
        regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'http://popular.example.com/' ELSE url END, '#.*$', '') AS url
      FROM pages),
    full_responses AS (
      SELECT url, 1700000000 + (page_id * 7919) % 100000 * 60 AS ts, max(page_id) AS page_id FROM base GROUP BY ALL),
    responses AS (
      SELECT f.url, f.ts, b.page_id, digest, n,
        CASE WHEN b.page_id % 6 NOT IN (1, 5) THEN '"' || b.page_id % 2 || '"' END AS etag,
        CASE WHEN b.page_id % 6 = 1 THEN 'day ' || b.page_id % 3 END AS last_modified
      FROM full_responses f JOIN base b USING (page_id)),
    revisits AS (
      SELECT page_id, k, url,
        1700000000 + (page_id * 7919) % 100000 * 60 + CASE WHEN page_id % 9 = 0 THEN -3600 ELSE k * 86400 END AS ts,
        CASE WHEN page_id % 6 NOT IN (1, 5) THEN '"' || (page_id % 2 + CASE WHEN page_id % 4 = 0 THEN 5 ELSE 0 END) || '"' END AS etag,
        CASE WHEN page_id % 6 = 1 THEN 'day ' || (page_id % 3 + CASE WHEN k = 2 THEN 1 ELSE 0 END) END AS last_modified
      FROM base, (VALUES (1), (2)) AS v(k)),
    joined AS (
      SELECT r.*, f.page_id AS full_page, f.digest, f.n,
        CASE WHEN f.page_id IS NULL THEN 'NO_EARLIER_RESPONSE'
             WHEN r.etag IS NOT NULL THEN CASE WHEN r.etag = f.etag THEN 'RESOLVED' ELSE 'VALIDATOR_MISMATCH' END
             WHEN r.last_modified IS NOT NULL THEN CASE WHEN r.last_modified = f.last_modified THEN 'RESOLVED' ELSE 'VALIDATOR_MISMATCH' END
             ELSE 'UNCHECKED' END AS status
      FROM revisits r ASOF LEFT JOIN responses f ON r.url = f.url AND r.ts > f.ts)
    SELECT page_id * 10 + k AS record_id, url, ts, status,
      CASE WHEN good THEN full_page * 10 END AS refers_to, CASE WHEN good THEN digest END AS digest,
      CASE WHEN good THEN n::BIGINT END AS length,
      CASE WHEN good THEN 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: d' || page_id || '-' || k || chr(10) || 'server: a' || chr(10) || 'vary: *'
        ELSE 'content-length: 0' || chr(10) || 'date: d' || page_id || '-' || k || chr(10) || 'server: b' || chr(10) || 'vary: *' END AS headers
    FROM (SELECT *, status IN ('RESOLVED', 'UNCHECKED') AS good FROM joined)"""
