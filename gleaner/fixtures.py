"""Crawl inputs derived from general tables, for the registered queries, tests and bench.

The same rules are stated in SQL in ``__spark_entry__.py``.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_BASE = "/data/public/crawl/segment/"
KEYWORDS = ["the", "que", "und", "zzqx", "THE"]
RECORDS_PER_ARCHIVE = 50
OPENING = b"filedesc://archive 0.0.0.0 20120905000000 text/plain 0\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Number of the archive that holds a page, within its segment: four a segment for every so many
#: pages, so that archives stay near 100 MB and their number grows with the table.
PAGES_PER_ROUND = 240_000
ARCHIVE_NUMBER = f"(page_id % 4 + 4 * (page_id div {PAGES_PER_ROUND}))"

METADATA_JSON = f"""
to_json(named_struct(
  'http_result', CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 404 ELSE 200 END,
  'archiveInfo', CASE WHEN page_id % 11 = 0 THEN NULL ELSE named_struct(
    'arcSourceSegmentId', 1346823846036 + page_id % 3,
    'arcFileDate', 1346848925218,
    'arcFileParition', {ARCHIVE_NUMBER},
    'arcFileOffset', page_id * 1000) END))
"""


def metadata(pages: DataFrame) -> DataFrame:
    """``url, json``."""
    return pages.select("url", F.expr(METADATA_JSON).alias("json"))


URL_CASE = """
CASE page_id % 16
  WHEN 0 THEN concat('http://a', page_id, '.b', page_id % 5, '.co.uk/x')
  WHEN 1 THEN concat('HTTP://WWW.Shop', page_id % 9, '.COM:80/p')
  WHEN 4 THEN concat('http://my_host', page_id, '.example.com/')
  WHEN 5 THEN concat('mailto:u', page_id, '@b')
  WHEN 6 THEN concat('/rel/path', page_id)
  WHEN 7 THEN concat('http://bad host', page_id, '/')
  WHEN 8 THEN concat('http://ex.com/a b', page_id)
  WHEN 9 THEN concat('http://1.2.3.', page_id % 250, '/x')
  WHEN 10 THEN concat('http://localhost/', page_id)
  WHEN 11 THEN concat('http://co.uk/', page_id)
  ELSE url END
"""
JSON_CASE = """
CASE page_id % 16
  WHEN 2 THEN '{"http_result": 404}'
  WHEN 3 THEN '{"other": 1}'
  WHEN 12 THEN 'not json'
  WHEN 13 THEN '{"http_result": "abc"}'
  WHEN 14 THEN '{"http_result": null}'
  ELSE '{"http_result": 200}' END
"""


def url_cases(pages: DataFrame) -> DataFrame:
    """``page_id, url, json`` with sound, odd and broken URLs and JSON."""
    return pages.select("page_id", F.expr(URL_CASE).alias("url"), F.expr(JSON_CASE).alias("json"))


REGISTRY_SUFFIXES = (
    "com.uy co.rs gob.es com.ec co.ma com.mt co.zw com.ar co.at com.au com.bo com.br com.cn com.co co.cr com.cy "
    "com.do com.eg com.gh com.gr com.gt com.hk com.hn co.hu co.id co.il co.in co.jp co.ke co.kr com.kw com.lb com.lk "
    "com.mx com.my com.ng com.ni co.nz com.om com.pa com.pe com.ph com.pk com.pl com.pt com.py co.th co.uk co.za any.ck"
).split()


def registry_hosts(pages: DataFrame) -> DataFrame:
    """``url`` with a host below one registry or another, by ``page_id``."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in REGISTRY_SUFFIXES]), (F.col("page_id") % len(REGISTRY_SUFFIXES) + 1).cast("int"))
    host = F.concat(F.lit("http://www.shop"), F.col("page_id").cast("string"), F.lit("."), suffix, F.lit("/p"))
    return pages.select("page_id", host.alias("url"))


TEXT_URL = "concat('http://www.', source, '.example.', lang, '/', doc_id)"


def texts(documents: DataFrame) -> DataFrame:
    """``url, text``."""
    return documents.select(F.expr(TEXT_URL).alias("url"), "text")


PROFILE_URL = """
CASE c_custkey % 4
  WHEN 0 THEN concat('https://www.linkedin.com/in/', c_custkey)
  WHEN 1 THEN concat('http://www.viadeo.com/profile/', c_custkey)
  WHEN 2 THEN concat('https://www.xing.com/profile/', c_custkey)
  ELSE concat('https://www.xing.com/jobs/', c_custkey) END
"""
PROFILE_BODY = """
CASE c_custkey % 4
  WHEN 0 THEN concat(
    CASE WHEN c_custkey % 12 = 0 THEN '<span class="full-name"> </span>'
         ELSE concat('<span class="full-name">', c_name, '</span>') END,
    CASE WHEN c_custkey % 8 = 4
         THEN concat('<span class="locality">Town, ', n_name, '</span>')
         ELSE concat('<span class="country-name">', n_name, '</span>') END)
  WHEN 1 THEN CASE
    WHEN c_custkey % 7 = 0 THEN '<p>no country'
    WHEN c_custkey % 3 = 0 THEN concat('<abbr class="country-name">', n_name, '</abbr>')
    ELSE concat('<span class="country-name">', n_name, '</span>') END
  WHEN 2 THEN concat('<ul><li class="country-name">', n_name, '<li>other</ul>')
  ELSE concat('<li class="country-name">', n_name, '</li>') END
"""


#: Tasks a core that pages of customers are dealt over: the table is small, and what is made of a row is not.
TASKS_A_CORE = 4


def profiles(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """``c_custkey, url, html``: one page per customer."""
    customer = customer.select("c_custkey", "c_name", "c_nationkey")
    customer = customer.repartition(TASKS_A_CORE * customer.sparkSession.sparkContext.defaultParallelism)
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    html = F.concat(
        F.lit('<html><head><title>x</title></head><body><p class="country-name big">no</p>'),
        F.expr(PROFILE_BODY),
        F.lit("</body></html>"),
    )
    return rows.select("c_custkey", F.expr(PROFILE_URL).alias("url"), html.alias("html"))


RECORD_PARTS = {
    "arc_path": f"""concat('{ARCHIVE_BASE}', 1346823846036 + page_id % 3, '/1346848925218_',
        {ARCHIVE_NUMBER}, '.arc.gz')""",
    "ip": "concat('10.0.', page_id % 256, '.1')",
    "stamp": """concat('201209', lpad(1 + page_id % 28, 2, '0'), lpad(page_id % 24, 2, '0'),
        lpad(page_id % 60, 2, '0'), '00')""",
    "content_type": "CASE WHEN page_id % 10 = 0 THEN 'text/plain' ELSE 'text/html' END",
    "http_type": """CASE page_id % 10 WHEN 0 THEN 'text/plain' WHEN 5 THEN 'text/html'
        WHEN 6 THEN 'text/html; charset=ISO-8859-1'
        WHEN 7 THEN 'text/html; charset=windows-1252'
        ELSE 'text/html; charset=utf-8' END""",
    "body": r"""CASE
        WHEN page_id % 10 IN (5, 6) THEN
            encode(regexp_replace(html, '[^\\x01-\\x7F]', '?'), 'UTF-8') || X'E9'
        WHEN page_id % 10 = 7 THEN
            encode(regexp_replace(html, '[^\\x01-\\x7F]', '?'), 'UTF-8') || X'80'
        ELSE encode(html, 'UTF-8') END""",
}


def records(pages: DataFrame) -> DataFrame:
    """``arc_path, header, payload, damaged`` of one archive record per page.

    By ``page_id % 10``: 0 plain text, 1 a header of six fields, 2 more payload than
    declared, 3 less than declared, 4 no HTTP head, 5-7 other charsets.  One in fifty
    is a damaged gzip member.
    """
    df = pages
    for name, rule in RECORD_PARTS.items():
        df = df.withColumn(name, F.expr(rule))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), "http_type",
        F.lit("\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\n\r\n"),
    )
    payload = F.when(F.expr("page_id % 10 = 4"), F.col("body")).otherwise(
        F.concat(F.encode(head, "UTF-8"), F.col("body"))
    )
    df = df.withColumn("payload", payload)
    length = F.octet_length("payload") + F.expr("CASE WHEN page_id % 10 = 3 THEN 100 ELSE 0 END")
    header = F.concat_ws(
        " ", "url", "ip", "stamp", "content_type", length.cast("string"),
        F.when(F.expr("page_id % 10 = 1"), F.lit("extra")),
    )
    extra = F.expr("CASE WHEN page_id % 10 = 2 THEN X'78787878' ELSE X'' END")
    return df.select(
        "page_id",
        "arc_path",
        header.alias("header"),
        F.concat("payload", extra).alias("payload"),
        F.expr("page_id % 50 = 33").alias("damaged"),
    )


def _member(header: str, payload: bytes, damaged: bool) -> bytes:
    data = gzip.compress(header.encode() + b"\n" + payload, compresslevel=1, mtime=0)
    return data[:-6] if damaged else data


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a batch as a list of them all would take several times its size."""
    columns = [(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]
    for row in range(batch.num_rows):
        yield {name: column[row].as_py() for name, column in columns}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opening = gzip.compress(OPENING)

    def packed(path, members):
        content = opening + b"".join(members)
        return pa.record_batch([[path], pa.array([content], pa.binary())], ["arc_path", "content"])

    for batch in batches:
        open_: dict[str, list[bytes]] = {}
        for row in _rows(batch):
            members = open_.setdefault(row["arc_path"], [])
            members.append(_member(row["header"], row["payload"], row["damaged"]))
            if len(members) == RECORDS_PER_ARCHIVE:
                yield packed(row["arc_path"], open_.pop(row["arc_path"]))
        for path, members in open_.items():
            yield packed(path, members)


def archives(rows: DataFrame) -> DataFrame:
    """``arc_path, content`` as a scan of archive files gives it, packed from :func:`records`."""
    return rows.select("arc_path", "header", "payload", "damaged").mapInArrow(
        _pack, "arc_path string, content binary"
    )


def archive_folder(rows: DataFrame, folder: str) -> None:
    """The archives of :func:`records` as files below ``folder``, one per path, members by ``page_id``.

    Every task writes whole files to the shared folder, member by member.
    """

    def opened(path):
        from pyarrow import fs

        target = folder.removeprefix("file://").removeprefix("file:") + path
        system, name = fs.FileSystem.from_uri(target) if ":" in target.split("/")[0] else (fs.LocalFileSystem(), target)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        out = system.open_output_stream(name, compression=None)
        out.write(gzip.compress(OPENING))
        return out

    def write(batches):
        current, out = None, None
        try:
            for batch in batches:
                for row in _rows(batch):
                    if out is None or row["arc_path"] != current:
                        if out is not None:
                            out.close()
                        current = row["arc_path"]
                        out = opened(current)
                    out.write(_member(row["header"], row["payload"], row["damaged"]))
                yield pa.record_batch([pa.array([], pa.string())], ["arc_path"])
        finally:
            if out is not None:
                out.close()

    dealt = rows.select("page_id", "arc_path", "header", "payload", "damaged").repartition("arc_path")
    dealt.sortWithinPartitions("arc_path", "page_id").mapInArrow(write, "arc_path string").count()


def profile_records(profile_pages: DataFrame) -> DataFrame:
    """Profile pages as archive records."""
    body = F.encode("html", "UTF-8")
    payload = F.concat(
        F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8"),
        body,
    )
    header = F.concat_ws(
        " ", "url", F.lit("10.0.0.1"), F.lit("20120905120000"), F.lit("text/html"),
        F.octet_length(payload).cast("string"),
    )
    path = F.concat(F.lit(ARCHIVE_BASE), F.expr("c_custkey % 4"), F.lit(".arc.gz"))
    return profile_pages.select(
        path.alias("arc_path"), header.alias("header"), payload.alias("payload"),
        F.lit(False).alias("damaged"),
    )
